"""Count tables and label tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.functions.partitions import to_rgs
from tideshare.operators.counts import count_categories, start_share
from tideshare.operators.partitions import labels_to_partition
from tideshare.plans.likelihood import start_share_arrays
from tideshare.plans.series import series_arrays

ALPHA, THETA = 4.109, 0.73
BASELINE = "view"
RATES = [0.98, 0.99, 1.0, 1.01, 1.02]
COARSE_RATES = [0.98, 1.0, 1.02]
#: Without 1, at which a time scale has no effect.
UNEVEN_RATES = [0.985, 1.005, 1.02]
RATIOS = [0.8, 1.0, 1.25]
CONCENTRATIONS = [10.0, 100.0, 1000.0]
PRIORITY_BASELINE = "5-LOW"
TYPE_BASELINE = "STANDARD"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_segment(spark: SparkSession, sf: str, per_user: DataFrame) -> DataFrame:
    """Rows per user with the market segment of the user."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return per_user.join(customer, per_user.user_id == customer.c_custkey)


def segment_counts(spark: SparkSession, sf: str, grain: str = "day") -> DataFrame:
    """Events are counted per user and day before they meet the segments."""
    daily = table(spark, sf, "events").groupBy(
        "user_id", F.col("ts").cast("date").alias("day"), "event_type"
    ).agg(F.count(F.lit(1)).alias("events"))
    return count_categories(by_segment(spark, sf, daily), F.col("day"), "event_type", "c_mktsegment",
                            grain, weight="events")


def user_counts(spark: SparkSession, sf: str, grain: str = "day") -> DataFrame:
    """One series per user: categories enter on different days."""
    return count_categories(table(spark, sf, "events"), F.col("ts"), "event_type", "user_id", grain)


def all_counts(spark: SparkSession, sf: str, grain: str = "day") -> DataFrame:
    """A single series that holds every event."""
    return count_categories(table(spark, sf, "events"), F.col("ts"), "event_type", F.lit("all"), grain)


def region_counts(spark: SparkSession, sf: str, grain: str = "month") -> DataFrame:
    """Orders by priority in each region, counted per customer and day before the joins."""
    daily = table(spark, sf, "orders").groupBy(
        "o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority"
    ).agg(F.count(F.lit(1)).alias("orders"))
    rows = (
        daily.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
                   F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return count_categories(rows, F.col("day"), "o_orderpriority", "r_name", grain, weight="orders")


def part_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Shipped lines per part, day and flag with type and brand of the part."""
    daily = table(spark, sf, "lineitem").groupBy(
        "l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_returnflag"
    ).agg(F.count(F.lit(1)).alias("lines"))
    parts = table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    return daily.join(parts, F.col("l_partkey") == F.col("p_partkey"))


def part_counts(spark: SparkSession, sf: str, variant: str = "p_type", grain: str = "month") -> DataFrame:
    """Shipped lines by part type (or brand), one series per return flag."""
    return count_categories(part_rows(spark, sf), F.col("day"), variant, "l_returnflag", grain,
                            weight="lines")


def segment_series(spark: SparkSession, sf: str, grain: str = "day") -> DataFrame:
    return series_with_shares(segment_counts(spark, sf, grain), BASELINE)


def series_with_shares(counts: DataFrame, baseline: str, start: Column | None = None,
                       end: Column | None = None) -> DataFrame:
    """Series arrays with the observed start shares as ``qt``."""
    return start_share_arrays(series_arrays(counts, baseline, start, end), start_share(counts))


def segment_rates(spark: SparkSession, sf: str) -> DataFrame:
    """A rate per segment and event type: its mean value relative to that of the baseline."""
    sums = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.sum("value").alias("total"), F.count("value").alias("events"))
    means = by_segment(spark, sf, sums).groupBy(
        F.col("c_mktsegment").alias("series_id"), F.col("event_type").alias("variant")
    ).agg((F.sum("total") / F.sum("events")).alias("m"))
    base = F.max(F.when(F.col("variant") == BASELINE, F.col("m"))).over(W.partitionBy("series_id"))
    return means.select("series_id", "variant", (F.col("m") / base).alias("k"))


def segment_params(spark: SparkSession, sf: str, counts: DataFrame) -> DataFrame:
    """Long parameters of the subjects: rate from the values, start share from the counts."""
    rates = segment_rates(spark, sf).filter(F.col("variant") != BASELINE)
    return rates.join(start_share(counts), ["series_id", "variant"]).select(
        "series_id", F.lit(0).cast("bigint").alias("candidate_id"), "variant",
        F.lit(1.0).alias("c"), "k", "qt",
    )


def customer_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer and used order priority: number of orders and latest status.

    Orders are reduced to one row per (customer, priority) before any array is built.
    """
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return orders.groupBy(
        F.col("o_custkey").alias("series_id"), F.col("o_orderpriority").alias("variant")
    ).agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderstatus").alias("status"))


def customer_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer three partitions of the priorities: equal orders, equal status, both equal."""
    items = F.array_sort(F.collect_list(F.struct("variant", "orders", "status")))
    return customer_labels(spark, sf).groupBy("series_id").agg(items.alias("items")).select(
        "series_id",
        to_rgs(F.transform("items", lambda x: x["orders"])).alias("by_orders"),
        to_rgs(F.transform("items", lambda x: x["status"])).alias("by_status"),
        to_rgs(F.transform("items", lambda x: F.struct(x["orders"], x["status"]))).alias("by_both"),
    )


def order_partition(spark: SparkSession, sf: str) -> DataFrame:
    return labels_to_partition(customer_labels(spark, sf), "orders", "variant")
