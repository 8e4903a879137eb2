"""Daily shares under the renewal model, as a fold inside the JVM.

A day needs the days before it, so the recursion cannot be a window; it runs inside one row and
the parallelism is over (series, candidate). The state keeps only the last lags; days that are done
lie in sealed blocks of about the root of their number.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.gamma import gamma_weights, weights_value
from tideshare.functions.numbers import array_sum, col, let
from tideshare.plans.series import spread

ID_COLUMNS = ["series_id", "candidate_id"]


def scaled_weights(c: Column | str, alpha: float, theta: float, length: int, division: int = 1) -> Column:
    """Lag weights per subject for its time-scale ratio, baseline (ratio 1) last."""
    subject = F.transform(col(c), lambda x: gamma_weights(alpha, theta, x, length, division))
    base = [F.lit(w) for w in weights_value(alpha, theta, length, division)]
    return F.array_append(subject, F.array(*base))


def close_day(raw: Column) -> Column:
    """Append the baseline share; subjects above 1 in sum are rescaled and the baseline is 0."""
    return let(
        array_sum(raw),
        lambda s: F.when(
            s > 1, F.concat(F.transform(raw, lambda x: x / s), F.array(F.lit(0.0)))
        ).otherwise(F.concat(raw, F.array(1.0 - s))),
    )


def trajectory_column(k: Column | str, qt: Column | str, intro: Column | str, n_days: Column | str,
                      weights: list[float] | Column, lags: int, division: int = 1) -> Column:
    """``array<array<double>>``: shares per day, subjects in order and the baseline last.

    ``weights`` holds ``lags`` values, or a column with ``lags`` values per category. With
    ``division`` steps per day the lags and the fold are finer and every ``division``-th step is
    read out.
    """
    k, qt, intro, n_days = col(k), col(qt), col(intro), col(n_days)
    subjects = F.size(k)
    block_days = F.ceil(F.sqrt(n_days)).cast("int")
    rates = F.concat(k, F.array(F.lit(1.0)))
    if isinstance(weights, Column):
        rates = F.zip_with(rates, weights, lambda r, g: F.transform(g, lambda x: x * r))
    first = close_day(F.zip_with(intro, qt, lambda d, q: F.when(d <= 0, q).otherwise(F.lit(0.0))))
    pins = F.zip_with(intro, qt, lambda d, q: F.struct(d.alias("d"), q.alias("q")))

    def lagged(past: Column, rate: Column) -> Column:
        # the lags are written out: a lambda call per lag would cost more than the product
        if isinstance(weights, Column):
            return reduce(add, [past[m] * rate[m] for m in range(lags)])
        return rate * reduce(add, [past[m] * float(w) for m, w in enumerate(weights)])

    def next_day(state: Column, i: Column, rate: Column, pins: Column) -> Column:
        pinned_day = i - 1 if division == 1 else F.floor(i / F.lit(division)).cast("int")
        new = F.zip_with(state["past"], rate, lagged)

        def shares(num: Column) -> Column:
            return let(
                array_sum(num),
                lambda total: F.zip_with(
                    F.slice(num, F.lit(1), subjects),
                    pins,
                    lambda x, p: F.when(p["d"] == pinned_day, p["q"]).otherwise(x / total),
                ),
            )

        def push(q: Column) -> Column:
            past = F.zip_with(
                state["past"], q,
                lambda h, x: F.concat(F.array(x), F.slice(h, F.lit(1), F.lit(lags - 1))),
            )

            def filed(block: Column) -> Column:
                # a full block is sealed, so a day copies one block and not all days before it
                full = F.size(block) >= block_days
                sealed = F.when(full, F.concat(state["sealed"], F.array(block))).otherwise(state["sealed"])
                rest = F.when(full, F.slice(block, F.lit(1), F.lit(0))).otherwise(block)
                return F.struct(past.alias("past"), sealed.alias("sealed"), rest.alias("block"))

            read_out = F.concat(state["block"], F.array(q))
            if division > 1:
                read_out = F.when((i - 1) % division == 0, read_out).otherwise(state["block"])
            return let(read_out, filed)

        return let(new, lambda num: let(shares(num), lambda raw: let(close_day(raw), push)))

    def run(args: Column) -> Column:
        q1, g, p = args["q1"], args["g"], args["p"]
        steps = (n_days - 1) * division + 1
        return F.when(n_days <= 1, F.array(q1)).otherwise(
            F.aggregate(
                F.sequence(F.lit(2), F.greatest(steps, F.lit(2))),
                F.struct(
                    F.transform(q1, lambda x: F.array_repeat(x, lags)).alias("past"),
                    F.slice(F.array(F.array(q1)), F.lit(1), F.lit(0)).alias("sealed"),
                    F.array(q1).alias("block"),
                ),
                lambda state, i: next_day(state, i, g, p),
                lambda state: F.flatten(F.concat(state["sealed"], F.array(state["block"]))),
            )
        )

    return let(F.struct(first.alias("q1"), rates.alias("g"), pins.alias("p")), run)


def with_trajectory(df: DataFrame, alpha: float, theta: float, length: int | None = None,
                    division: int = 1, future: int = 0, time_scale: bool = False) -> DataFrame:
    """Add ``traj`` to rows that hold ``k, qt, intro, n_days`` (and ``c`` for time scales).

    ``future`` continues the recursion past the last day.
    """
    g = weights_value(alpha, theta, length, division)
    weights = scaled_weights("c", alpha, theta, len(g) // division, division) if time_scale else g
    days = F.col("n_days") + future
    return df.withColumn(
        "traj", trajectory_column("k", "qt", "intro", days, weights, len(g), division)
    )


def explode_trajectory(df: DataFrame, means: bool = False) -> DataFrame:
    """Rows with ``traj`` to long ``(series_id[, candidate_id], date, variant, q)``.

    ``means`` adds the share-weighted mean time scale and rate of the day, taken from the arrays
    of the row before it is exploded. ``traj`` is never empty; the outer form keeps Spark from
    adding a filter that would run the fold a second time.
    """
    ids = [c for c in ID_COLUMNS if c in df.columns]
    extra = ["average_c", "average_k"] if means else []
    names = F.array_append(F.col("subjects"), F.col("baseline"))
    arrays = [F.concat(c, F.array(F.lit(1.0))).alias(f"{c}s") for c in ("c", "k")] if means else []
    days = df.select(*ids, "t_start", names.alias("names"), *arrays,
                     F.posexplode_outer("traj").alias("day", "row"))
    if means:
        days = days.withColumns({
            f"average_{c}": array_sum(F.zip_with("row", f"{c}s", lambda q, x: q * x)) for c in ("c", "k")
        })
    cells = days.select(
        *ids,
        F.date_add("t_start", F.col("day")).alias("date"),
        *extra,
        F.explode(F.arrays_zip(F.col("names"), F.col("row"))).alias("x"),
    )
    return cells.select(*ids, "date", F.col("x.names").alias("variant"), F.col("x.row").alias("q"), *extra)


def scenario_arrays(params: DataFrame, baseline: str, end: Column | None = None) -> DataFrame:
    """Parameter table ``(series_id, variant, date, c, k, qt)`` to model rows, dates included.

    The result is spread over tasks, ready for the fold.
    """
    span = params.groupBy("series_id").agg(
        F.min("date").alias("t_start"),
        (end if end is not None else F.max("date")).alias("t_end"),
        F.sort_array(F.collect_list(F.struct("variant", "date", "c", "k", "qt"))).alias("all_rows"),
    )
    subject = F.filter("all_rows", lambda r: r["variant"] != baseline)
    return spread(span.withColumn("rows", subject).select(
        "series_id",
        F.lit(baseline).alias("baseline"),
        "t_start",
        (F.datediff("t_end", "t_start") + 1).alias("n_days"),
        F.transform("rows", lambda r: r["variant"]).alias("subjects"),
        F.transform("rows", lambda r: F.datediff(r["date"], F.col("t_start"))).alias("intro"),
        F.transform("rows", lambda r: r["c"]).alias("c"),
        F.transform("rows", lambda r: r["k"]).alias("k"),
        F.transform("rows", lambda r: r["qt"]).alias("qt"),
    ))
