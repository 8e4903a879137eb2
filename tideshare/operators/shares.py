"""Joins and aggregates on trajectories ``(series_id, candidate_id, date, variant, q)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.functions.numbers import col


def bin_share(counts: DataFrame, traj: DataFrame) -> DataFrame:
    """Mean daily share over each bin, floored at 0: an equi join on the days of the bin."""
    days = counts.withColumn("date", F.explode(F.sequence("date_from", "date_till")))
    keys = [c for c in traj.columns if c not in ("q", "day")]
    by = ["series_id", "date_from", "date_till", "variant", "n"]
    extra = [k for k in keys if k not in ("series_id", "date", "variant")]
    return (
        days.join(traj.select(*keys, "q"), ["series_id", "date", "variant"])
        .groupBy(*by, *extra)
        .agg(F.greatest(F.lit(0.0), F.avg("q")).alias("p"))
    )


def apply_blocks(blocks: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate per category from its block ``(series_id, block, k)``; block 0 has rate 1."""
    return blocks.join(rates, ["series_id", "block"], "left").withColumn(
        "k", F.when(F.col("block") == 0, F.lit(1.0)).otherwise(F.coalesce("k", F.lit(1.0)))
    )


def lag_sum(traj: DataFrame, weights: list[float], k: Column | str = "k") -> DataFrame:
    """Weighted sum over the earlier days of each category and its total per day.

    A lag counts calendar days: a day without a row adds nothing, and days before the first row count as
    the first. One window per (series, candidate, category) with a frame per lag; nothing is multiplied by
    the number of lags on the way through the shuffle.
    """
    group = [c for c in ("series_id", "candidate_id") if c in traj.columns]
    days = traj.withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    w = W.partitionBy(*group, "variant").orderBy("_day")
    start = w.rangeBetween(W.unboundedPreceding, W.currentRow)
    first, begin = F.first("q").over(start), F.first("_day").over(start)
    total = F.lit(0.0)
    for m, g in enumerate(weights, start=1):
        earlier = F.coalesce(F.first("q").over(w.rangeBetween(-m, -m)), F.lit(0.0))
        total = total + F.lit(g) * F.when(F.col("_day") - m < begin, first).otherwise(earlier)
    out = days.withColumn("num", col(k) * total).drop("_day")
    return out.withColumn("total", F.sum("num").over(W.partitionBy(*group, "date")))


def observed_vs_fitted(shares: DataFrame, traj: DataFrame) -> DataFrame:
    """Observed share next to fitted share on the first day of each bin."""
    return shares.withColumn("date", F.col("date_from")).join(
        traj.select("series_id", "date", "variant", "q"), ["series_id", "date", "variant"]
    )


def baseline_share(params: DataFrame, bounds: DataFrame, keys=("series_id",)) -> DataFrame:
    """1 minus the start shares of the subjects present at the start."""
    present = F.when(F.col("date") <= F.col("t_start"), F.col("qt")).otherwise(F.lit(0.0))
    return (
        params.join(bounds.select("series_id", "t_start"), "series_id")
        .groupBy(*keys)
        .agg((1.0 - F.sum(present)).alias("qt"))
    )


def param_range(replicates: DataFrame, value: str, keys=("series_id", "variant")) -> DataFrame:
    return replicates.groupBy(*keys).agg(
        F.min(value).alias(f"{value}_lb"), F.max(value).alias(f"{value}_ub")
    )


def baseline_range(replicates: DataFrame, bounds: DataFrame) -> DataFrame:
    """Range of the baseline share over interval solutions: sum per solution, then min and max."""
    per = baseline_share(replicates, bounds, ("series_id", "candidate_id"))
    return per.groupBy("series_id").agg(F.min("qt").alias("qt_lb"), F.max("qt").alias("qt_ub"))


def population_mean(traj: DataFrame, params: DataFrame) -> DataFrame:
    """Share-weighted mean rate and time scale per day; categories without parameters count as 1."""
    on = [c for c in ("series_id", "candidate_id", "variant") if c in params.columns and c in traj.columns]
    group = [c for c in ("series_id", "candidate_id", "date") if c in traj.columns]
    one = F.lit(1.0)
    return (
        traj.join(params.select(*on, "c", "k"), on, "left")
        .groupBy(*group)
        .agg(
            F.sum(F.col("q") * F.coalesce("c", one)).alias("average_c"),
            F.sum(F.col("q") * F.coalesce("k", one)).alias("average_k"),
        )
    )


def mean_by_block(params: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean earlier rate per block, matched by category name; block 0 has no rate."""
    joined = blocks.join(params.select("series_id", "variant", "k"), ["series_id", "variant"])
    return joined.filter("block > 0").groupBy("series_id", "block").agg(F.avg("k").alias("k"))


def concat_names(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Comma list of the category names per group, in table order."""
    names = F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col("variant").alias("name"))))
    return df.groupBy(*keys).agg(
        F.concat_ws(",", F.transform(names, lambda x: x["name"])).alias("variant")
    )
