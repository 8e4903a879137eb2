"""From raw rows or wide tables to long counts, and the basic aggregates on them.

Long counts are ``(series_id, date_from, date_till, variant, n)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.functions.numbers import col, day_calendar

BIN = ["series_id", "date_from", "date_till"]


def count_categories(rows: DataFrame, date: Column, variant: Column | str, series: Column | str,
                     grain: str = "day", dense: bool = True, weight: Column | str | None = None) -> DataFrame:
    """Count rows (or add up ``weight``) per series, time bin and category.

    Only this aggregate sees raw rows; partial aggregation keeps a hot series, day or category
    from reaching one task. All that follows works on one row per bin and category. Where the
    series comes from a join, count by the join key first and give the counts as ``weight``.
    ``grain`` is ``day``, ``week`` or ``month``; edge bins are clipped to the observed days.
    Rows without a date, category or series are not counted.
    """
    day = date.cast("date")
    named = rows.select(
        col(series).cast("string").alias("series_id"), day.alias("day"), col(variant).alias("variant"),
        *([] if weight is None else [col(weight).cast("bigint").alias("weight")]),
    ).filter("series_id is not null and day is not null and variant is not null")
    number = F.count(F.lit(1)) if weight is None else F.sum("weight")
    daily = named.groupBy("series_id", "day", "variant").agg(number.alias("n"))
    # No NULL keys and asking for n > 0 keep all uses of the daily counts alike, so that Spark
    # reuses the exchange and scans the raw rows once.
    counted = F.when(F.col("n") > 0, F.col("day"))
    spans = daily.groupBy("series_id").agg(
        F.min(counted).alias("lo"), F.max(counted).alias("hi"),
        F.collect_set("variant").alias("variants"),
    )
    if grain == "day":
        counts = daily.select("series_id", F.col("day").alias("date_from"),
                              F.col("day").alias("date_till"), "variant", "n")
    else:
        counts = clip_bins(daily, spans, grain)
    return dense_fill(counts, spans, grain) if dense else counts


def bin_edges(day: Column, grain: str) -> tuple[Column, Column]:
    lo = F.trunc(day, grain)
    hi = F.date_add(lo, 6) if grain == "week" else F.last_day(day)
    return lo, hi


def clip_bins(daily: DataFrame, spans: DataFrame, grain: str) -> DataFrame:
    """Daily counts to wider bins, cut at the first and last day of the series."""
    lo, hi = bin_edges(F.col("day"), grain)
    binned = daily.groupBy("series_id", lo.alias("b_lo"), hi.alias("b_hi"), "variant").agg(
        F.sum("n").alias("n")
    )
    return binned.join(spans.select("series_id", "lo", "hi"), "series_id").select(
        "series_id",
        F.greatest("b_lo", "lo").alias("date_from"),
        F.least("b_hi", "hi").alias("date_till"),
        "variant",
        "n",
    )


def dense_fill(counts: DataFrame, spans: DataFrame, grain: str = "day") -> DataFrame:
    """One row per bin and category of the series; missing counts become 0.

    ``spans`` is ``(series_id, lo, hi, variants)``; the grid grows out of that one row.
    """
    if grain == "day":
        bins = F.transform(day_calendar("lo", "hi"), lambda d: F.struct(d.alias("a"), d.alias("b")))
    else:
        def cut(d: Column) -> Column:
            a, b = bin_edges(d, grain)
            return F.struct(F.greatest(a, F.col("lo")).alias("a"), F.least(b, F.col("hi")).alias("b"))

        bins = F.array_distinct(F.transform(day_calendar("lo", "hi"), cut))
    grid = (
        spans.select("series_id", "variants", F.explode(bins).alias("bin"))
        .select("series_id", F.col("bin.a").alias("date_from"), F.col("bin.b").alias("date_till"),
                F.explode("variants").alias("variant"))
    )
    return grid.join(counts, [*BIN, "variant"], "left").select(
        *BIN, "variant", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def to_long(wide: DataFrame, series_col: str | None = None) -> DataFrame:
    """Category columns to rows; names with dots are quoted."""
    ids = ["date_from", "date_till"]
    names = [c for c in wide.columns if c not in ids and c != series_col]
    if series_col is None:
        wide = wide.withColumn("series_id", F.lit("all"))
    elif series_col != "series_id":
        wide = wide.withColumnRenamed(series_col, "series_id")
    quoted = [F.col(f"`{c}`").cast("bigint").alias(c) for c in names]
    return wide.select(*BIN, *quoted).unpivot(BIN, [F.col(f"`{c}`") for c in names], "variant", "n")


def to_wide(df: DataFrame, keys: list[str], values: dict[str, str], variants: list[str]) -> DataFrame:
    """One column per listed category and value, in one aggregate.

    ``values`` maps value columns to suffixes: ``{"q": "", "q_lb": "_lb"}`` gives ``x`` and ``x_lb``. A category
    that is not listed fails the job; ``keep_subjects`` drops categories on purpose.
    """
    unlisted = F.count_if(~F.col("variant").isin(variants))
    cells = [
        F.when(unlisted == 0, F.first(F.when(F.col("variant") == v, F.col(c)), ignorenulls=True))
        .otherwise(F.raise_error(F.lit("a category is not listed"))).alias(v + suffix)
        for c, suffix in values.items()
        for v in variants
    ]
    return df.groupBy(*keys).agg(*cells)


def category_names(counts: DataFrame) -> list[str]:
    """Names of all categories in order, for tables with one column per category."""
    return sorted(r[0] for r in counts.select("variant").distinct().collect())


def day_bins(df: DataFrame, date: str = "date") -> DataFrame:
    """Point dates to one-day bins."""
    return df.withColumn("date_from", F.col(date)).withColumn("date_till", F.col(date)).drop(date)


def keep_subjects(counts: DataFrame, subjects: list[str], baseline: str) -> DataFrame:
    """Listed subjects and the baseline; all other categories are dropped."""
    return counts.filter(F.col("variant").isin([*subjects, baseline]))


def drop_baseline(df: DataFrame, baseline: str) -> DataFrame:
    return df.filter(F.col("variant") != baseline)


def clip_window(counts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Keep bins that touch the window, uncut."""
    return counts.filter((F.col("date_till") >= start) & (F.col("date_from") <= end))


def date_bounds(counts: DataFrame) -> DataFrame:
    return counts.groupBy("series_id").agg(
        F.min("date_from").alias("t_start"), F.max("date_till").alias("t_end")
    )


def first_seen(counts: DataFrame, undetected: bool = False) -> DataFrame:
    """First bin with a count per category; NULL if never seen. ``undetected``: the start."""
    if not undetected:
        return counts.groupBy("series_id", "variant").agg(
            F.min(F.when(F.col("n") > 0, F.col("date_from"))).alias("first_date")
        )
    variants = counts.groupBy("series_id", "variant").agg(F.min("date_from").alias("lo"))
    start = F.min("lo").over(W.partitionBy("series_id"))
    return variants.select("series_id", "variant", start.alias("first_date"))


def bin_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*BIN).agg(F.sum("n").cast("bigint").alias("total"))


def nonempty_bins(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(W.partitionBy(*BIN))
    return counts.withColumn("total", total).filter("total > 0").drop("total")


def observed_share(counts: DataFrame) -> DataFrame:
    """Count over bin total; NULL in an empty bin."""
    total = F.sum("n").over(W.partitionBy(*BIN))
    return counts.withColumn("share", F.col("n") / F.nullif(total, F.lit(0)))


def start_share(counts: DataFrame, days: int = 7) -> DataFrame:
    """Pooled share over the first ``days`` days of each category: a start value for ``qt``."""
    bins = counts.withColumn("total", F.sum("n").over(W.partitionBy(*BIN)))
    own = W.partitionBy("series_id", "variant")
    first = F.min(F.when(F.col("n") > 0, F.col("date_from"))).over(own)
    early = F.col("date_from") < F.date_add(F.col("first"), days)
    return (
        bins.withColumn("first", first)
        .filter(early & (F.col("date_from") >= F.col("first")))
        .groupBy("series_id", "variant")
        .agg((F.sum("n") / F.sum("total")).alias("qt"))
    )


def with_variant_index(counts: DataFrame, baseline: str, baseline_first: bool = False) -> DataFrame:
    """Dimension ``(series_id, variant, idx)``: subjects by name, baseline last (or first)."""
    names = counts.select("series_id", "variant").distinct()
    is_base = (F.col("variant") == baseline).cast("int")
    order = -is_base if baseline_first else is_base
    w = W.partitionBy("series_id").orderBy(order, "variant")
    return names.withColumn("idx", (F.row_number().over(w) - (1 if baseline_first else 0)).cast("int"))


def lookup_index(df: DataFrame, index: DataFrame) -> DataFrame:
    """Attach the position of each category; Spark broadcasts the index if it is small."""
    return df.join(index, ["series_id", "variant"])


def first_appearance_id(df: DataFrame, value: str, pos: str, keys: list[str]) -> DataFrame:
    """Number the values 0, 1, .. by first position within ``keys``, then by value.

    The minimum per value is a partial aggregate, so the window only sees one row per value.
    """
    first = df.groupBy(*keys, value).agg(F.min(pos).alias("_first"))
    w = W.partitionBy(*keys).orderBy("_first", value)
    return first.withColumn("label", (F.row_number().over(w) - 1).cast("int")).drop("_first")
