"""One row per series: the aligned arrays the model works on.

Raw rows are already reduced to one count per bin and category here, so a row holds
bins x categories numbers, however many raw rows the series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideshare.functions.numbers import array_sum, let, log_factorial
from tideshare.operators.counts import clip_window
from tideshare.sources.checks import MAX_TIME_SCALE_BIN


def series_arrays(counts: DataFrame, baseline: str, start: Column | None = None,
                  end: Column | None = None, undetected: bool = False) -> DataFrame:
    """``(series_id, baseline, t_start, n_days, subjects, intro, bins, ln_coef)``.

    ``subjects`` is sorted by name; in ``bins.n`` the baseline comes last. ``intro`` is the day
    offset of the first count (0 = present at the start). ``ln_coef`` is the part of the
    multinomial log-likelihood that no parameter changes. Fails on a missing baseline, on a bin
    that leaves the window and on a category that is never seen.
    """
    if start is not None:
        counts = clip_window(counts, start, F.lit("9999-12-31").cast("date"))
    if end is not None:
        counts = clip_window(counts, F.lit("0001-01-01").cast("date"), end)
    per_bin = counts.groupBy("series_id", "date_from", "date_till").agg(
        F.sort_array(F.collect_list(F.struct("variant", "n"))).alias("cells")
    )
    per_series = per_bin.groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("date_from", "date_till", "cells"))).alias("rows"),
        (start if start is not None else F.min("date_from")).alias("t_start"),
        (end if end is not None else F.max("date_till")).alias("t_end"),
    )
    names = F.array_distinct(
        F.flatten(F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["variant"])))
    )
    named = per_series.withColumn("names", F.array_sort(names)).select(
        "series_id",
        F.lit(baseline).alias("baseline"),
        "t_start",
        (F.datediff("t_end", "t_start") + 1).alias("n_days"),
        F.when(F.array_contains("names", baseline), F.array_remove("names", baseline))
        .otherwise(F.raise_error(F.lit(f"no counts of the baseline {baseline}")))
        .alias("subjects"),
        "rows",
    )

    def bin_row(r: Column) -> Column:
        d1 = F.datediff(r["date_from"], F.col("t_start")) + 1
        d2 = F.datediff(r["date_till"], F.col("t_start")) + 1
        inside = (d1 >= 1) & (d2 <= F.col("n_days"))
        counts_of = let(
            F.map_from_entries(r["cells"]),
            lambda m: F.transform(
                F.array_append(F.col("subjects"), F.col("baseline")),
                lambda v: F.coalesce(F.try_element_at(m, v), F.lit(0).cast("bigint")),
            ),
        )
        return F.struct(
            F.when(inside, d1).otherwise(F.raise_error(F.lit("a bin leaves the window"))).alias("d1"),
            d2.alias("d2"),
            counts_of.alias("n"),
        )

    binned = named.withColumn("bins", F.transform("rows", bin_row)).drop("rows")

    def offset(j: Column) -> Column:
        if undetected:
            return F.lit(0)
        seen = F.filter("bins", lambda b: F.element_at(b["n"], j) > 0)
        return F.coalesce(
            F.array_min(F.transform(seen, lambda b: b["d1"] - 1)),
            F.raise_error(F.lit("a category is never seen in the window")).cast("int"),
        )

    def coefficient(b: Column) -> Column:
        total = F.aggregate(b["n"], F.lit(0).cast("bigint"), lambda a, x: a + x)
        return log_factorial(total) - array_sum(F.transform(b["n"], log_factorial))

    return binned.withColumns({
        "intro": F.transform(F.sequence(F.lit(1), F.size("subjects")), offset),
        "ln_coef": array_sum(F.transform("bins", coefficient)),
    })


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``, or one below the warehouse, which is shared too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and read back: a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread_count(spark: SparkSession) -> int:
    """Tasks to spread small rows with heavy work over."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows to a fixed number of tasks, by ``keys`` if given.

    Model rows are small in bytes but slow to work on. Adaptive execution sizes tasks by bytes
    and would put them all into one; it leaves an explicit number of partitions alone.
    """
    return df.repartition(spread_count(df.sparkSession), *keys)


def narrow_bins(first: Column, last: Column) -> Column:
    """Time scales cannot be told from wide bins: whether all bins span at most seven days, else an error."""
    wide = F.exists(F.zip_with(first, last, lambda a, b: b - a), lambda days: days >= MAX_TIME_SCALE_BIN)
    return F.when(wide, F.raise_error(F.lit("a bin is too wide to estimate time scales")).cast("boolean")).otherwise(F.lit(True))


def attach_series(candidates: DataFrame, series: DataFrame, splits: int | None = None) -> DataFrame:
    """Join candidates to the arrays of their series.

    Candidates of one series go to ``splits`` keys (as many as there are tasks) and the one array
    row of the series is copied to each, so a series with most of the candidates keeps all tasks busy.
    """
    splits = splits or spread_count(candidates.sparkSession)
    salt = F.pmod(F.xxhash64(*candidates.columns), F.lit(splits)).cast("int")
    left = spread(candidates.withColumn("_salt", salt), "series_id", "_salt")
    copies = series.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    return left.join(spread(copies, "series_id", "_salt"), ["series_id", "_salt"]).drop("_salt")


def params_to_arrays(params: DataFrame, series: DataFrame, splits: int | None = None) -> DataFrame:
    """Long ``(series_id, candidate_id, variant, c, k, qt)`` to arrays in subject order."""
    splits = splits or spread_count(params.sparkSession)
    packed = params.groupBy("series_id", "candidate_id").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", F.struct("c", "k", "qt")))).alias("m")
    )
    # a map cannot be hashed for the salt, so only its key is
    salt = F.pmod(F.xxhash64("candidate_id"), F.lit(splits)).cast("int")
    copies = series.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    joined = spread(packed.withColumn("_salt", salt), "series_id", "_salt").join(
        spread(copies, "series_id", "_salt"), ["series_id", "_salt"]
    )

    def pick(field: str) -> Column:
        return F.transform("subjects", lambda v: F.element_at(F.col("m"), v)[field])

    return joined.withColumns({f: pick(f) for f in ("c", "k", "qt")}).drop("m", "_salt")
