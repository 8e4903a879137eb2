"""Beam, running minimum, ranking and level counts on score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.plans.series import materialise, spread_count


def beam(scores: DataFrame, width: int, keys=("series_id", "level")) -> DataFrame:
    """Rows up to the width-th smallest AIC per level, ties kept.

    Spark applies the rank limit before the shuffle too, so a task never sees a whole level.
    """
    w = W.partitionBy(*keys).orderBy("AIC")
    return scores.withColumn("_r", F.rank().over(w)).filter(F.col("_r") <= width).drop("_r")


def running_best(scores: DataFrame, tasks: int | None = None) -> DataFrame:
    """Lowest AIC among the rows before each row, in the order (level, rgs); NULL for the first.

    ``rgs`` is the label string. A scan in two passes: rows are range-partitioned in that order, which
    is written down so that both passes see the same runs; the minimum of each run is aggregated and
    carried to the runs after it, and the rows are windowed inside their run only. So no task holds a
    whole series or level, however alike its groupings begin.
    """
    tasks = tasks or spread_count(scores.sparkSession)
    placed = scores.repartitionByRange(tasks, "series_id", "level", "rgs").withColumn("_run", F.spark_partition_id())
    runs = materialise(placed)
    per_run = runs.groupBy("series_id", "_run").agg(F.min("AIC").alias("_low"))
    before = W.partitionBy("series_id").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    earlier = per_run.select("series_id", "_run", F.min("_low").over(before).alias("_earlier"))
    inside = W.partitionBy("series_id", "_run").orderBy("level", "rgs").rowsBetween(W.unboundedPreceding, -1)
    return (
        runs.withColumn("_in", F.min("AIC").over(inside))
        .join(earlier, ["series_id", "_run"])
        .withColumn("best_before", F.least("_in", "_earlier"))
        .drop("_in", "_earlier", "_run")
    )


def best_so_far(scores: DataFrame) -> DataFrame:
    return scores.groupBy("series_id").agg(F.min("AIC").alias("best_AIC"))


def rank_scores(scores: DataFrame) -> DataFrame:
    return scores.orderBy("series_id", "AIC", "rgs")


def best_partition(scores: DataFrame) -> DataFrame:
    """Grouping of lowest AIC per series, ties by label string."""
    return scores.groupBy("series_id").agg(
        F.min_by(F.struct("rgs", "AIC"), F.struct("AIC", "rgs")).alias("b")
    ).select("series_id", "b.rgs", "b.AIC")


def with_place(rows: DataFrame, *order: Column | str, keys=("series_id",)) -> DataFrame:
    """Position ``place`` from 1 in the given order. A window sees one row per category or grouping of its key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place.cast("bigint"))


def order_by_rate(estimates: DataFrame) -> DataFrame:
    """Highest rate first, with the position inside the series."""
    return with_place(estimates, F.desc("k"), "variant").orderBy(F.desc("k"), "variant")


def level_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("series_id", "level").agg(
        F.count(F.lit(1)).alias("analysed"), F.count_if("has_chance").alias("with_chance")
    )
