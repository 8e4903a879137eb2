"""One query per operator (or small family), all on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideshare.functions import numbers as num
from tideshare.functions import partitions as part
from tideshare.functions.gamma import gamma_weights, normalised, truncation_days, truncation_length
from tideshare.operators import counts as ct
from tideshare.operators import partitions as pt
from tideshare.operators import ranking as rk
from tideshare.operators import shares as sh
from tideshare.plans import fit as ft
from tideshare.plans import likelihood as lk
from tideshare.plans import refine as rf
from tideshare.plans import reports as rp
from tideshare.plans import search as se
from tideshare.plans import trajectory as tr
from tideshare.plans.series import (
    attach_series,
    ensure_checkpoint_dir,
    materialise,
    params_to_arrays,
    series_arrays,
)
from tideshare.sources import checks as ck
from tideshare.sources import tables as tb
from tideshare.workload import bindings as b
from tideshare.workload.bindings import ALPHA, BASELINE, COARSE_RATES, CONCENTRATIONS, RATES, RATIOS, THETA

LAGS = truncation_length(ALPHA, THETA)
#: Categories of the reports and grids that are restricted to some.
LISTED = ["click", "purchase"]


def _values(spark, sf, name: str, column: str) -> int:
    """Number of distinct values: the size that enumerations of them need."""
    return b.table(spark, sf, name).agg(F.count_distinct(F.coalesce(column, F.lit("")))).first()[0]


def _types(spark, sf) -> int:
    return _values(spark, sf, "events", "event_type")


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(num.col(c), places)


def dated(df: DataFrame, *names: str) -> DataFrame:
    """Dates as ISO text."""
    return df.withColumns({n: num.iso(n) for n in names})


def work_path(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def rgs_text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: part.rgs_key(n) for n in names})


# --- counts ------------------------------------------------------------------------------

def daily_counts(spark, sf):
    return dated(b.segment_counts(spark, sf), "date_from", "date_till")


def weekly_counts(spark, sf):
    return dated(b.user_counts(spark, sf, "week"), "date_from", "date_till")


def monthly_counts(spark, sf):
    return dated(b.region_counts(spark, sf), "date_from", "date_till")


def day_bins(spark, sf):
    """Point dates of the raw rows to one-day bins with a total."""
    rows = b.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    daily = rows.groupBy("date").agg(F.count(F.lit(1)).alias("total"))
    return dated(ct.day_bins(daily), "date_from", "date_till")


def wide_counts(spark, sf):
    counts = b.segment_counts(spark, sf)
    return dated(ct.to_wide(counts, ct.BIN, {"n": ""}, ct.category_names(counts)), "date_from", "date_till")


def read_write_counts(spark, sf):
    """Wide table to CSV and Parquet and back to long counts, one series per format."""
    counts = b.all_counts(spark, sf)
    wide = ct.to_wide(counts, ["date_from", "date_till"], {"n": ""}, ct.category_names(counts))
    path, out = work_path(spark), []
    for fmt in ("csv", "parquet"):
        target = tb.write_table(wide, path, f"counts_{fmt}", fmt)
        back = tb.read_counts(spark, target, fmt)
        out.append(back.withColumn("series_id", F.lit(fmt)))
    return dated(out[0].unionByName(out[1]), "date_from", "date_till")


def read_write_reports(spark, sf):
    """Parameter, score and estimate tables through CSV and back."""
    counts = b.all_counts(spark, sf)
    shares = ct.start_share(counts).join(ct.first_seen(counts), ["series_id", "variant"])
    params = shares.select("variant", F.col("first_date").alias("date"), F.lit(1.0).alias("c"),
                           F.lit(1.0).alias("k"), "qt")
    totals = counts.groupBy("variant").agg(F.sum("n").alias("num_pars")).select(
        (F.col("num_pars") * -1.25).alias("maxll"), "num_pars",
        num.aic(F.col("num_pars") * -1.25, "num_pars").alias("AIC"))
    path = work_path(spark)
    p = tb.read_params(spark, tb.write_table(params, path, "parameters", "csv"))
    s = tb.read_scores(spark, tb.write_table(totals, path, "loglikelihood", "csv"))
    e = tb.read_estimates(spark, tb.write_table(params, path, "estimates", "csv"))
    rows = [p.select(F.lit("params").alias("source"), "variant", r6("qt").alias("value")),
            s.select(F.lit("scores").alias("source"), F.col("num_pars").cast("string").alias("variant"),
                     r6("AIC").alias("value")),
            e.select(F.lit("estimates").alias("source"), "variant", r6("qt").alias("value"))]
    return se.union(rows)


def variant_violations(spark, sf):
    """Part brands and types of each return flag, asked of the counts by part type: only brands are missing."""
    names = F.explode(F.array("p_brand", "p_type"))
    wanted = b.part_rows(spark, sf).select(F.col("l_returnflag").alias("series_id"), names.alias("variant")).distinct()
    return ck.variant_violations(b.part_counts(spark, sf), wanted)


def _window(spark, sf) -> tuple:
    """First and last day of the events: two values."""
    day = F.col("ts").cast("date")
    return tuple(b.table(spark, sf, "events").agg(F.min(day), F.max(day)).first())


def window_violations(spark, sf):
    """Users whose rows do not start and end with the window of the whole table."""
    first, last = _window(spark, sf)
    return ck.window_violations(b.user_counts(spark, sf), F.lit(first), F.lit(last))


def bin_width_violations(spark, sf):
    counts = b.segment_counts(spark, sf, "week").unionByName(b.region_counts(spark, sf))
    return ck.bin_width_violations(counts).withColumn("max_width", F.col("max_width").cast("bigint"))


def block_violations(spark, sf):
    """Order counts of a customer taken as labels as they are."""
    items = F.array_sort(F.collect_list(F.struct("variant", "orders")))
    raw = b.customer_labels(spark, sf).groupBy("series_id").agg(
        F.transform(items, lambda x: x["orders"].cast("int") - 1).alias("rgs"))
    return rgs_text(ck.block_violations(raw, 5), "rgs")


def keep_subjects(spark, sf):
    kept = ct.keep_subjects(b.segment_counts(spark, sf), LISTED, BASELINE)
    return dated(ct.drop_baseline(kept, BASELINE), "date_from", "date_till")


def clip_window(spark, sf):
    clipped = ct.clip_window(b.user_counts(spark, sf, "week"), F.lit("2024-01-10").cast("date"),
                             F.lit("2024-01-24").cast("date"))
    return dated(ct.nonempty_bins(clipped), "date_from", "date_till")


def variant_index(spark, sf):
    """Brand positions with the baseline last, looked up for every count."""
    counts = b.part_counts(spark, sf, "p_brand")
    index = ct.with_variant_index(counts, "Brand#1")
    out = ct.lookup_index(counts, index).withColumn("idx", F.col("idx").cast("bigint"))
    return dated(out, "date_from", "date_till")


def baseline_first_index(spark, sf):
    index = ct.with_variant_index(b.part_counts(spark, sf, "p_brand"), "Brand#1", baseline_first=True)
    return index.withColumn("idx", F.col("idx").cast("bigint"))


def date_bounds(spark, sf):
    return dated(ct.date_bounds(b.user_counts(spark, sf)), "t_start", "t_end")


def first_seen(spark, sf):
    counts = b.user_counts(spark, sf)
    both = ct.first_seen(counts).join(
        ct.first_seen(counts, undetected=True).withColumnRenamed("first_date", "assumed_date"),
        ["series_id", "variant"])
    return dated(both, "first_date", "assumed_date")


def bin_totals(spark, sf):
    return dated(ct.bin_totals(b.region_counts(spark, sf)), "date_from", "date_till")


def observed_share(spark, sf):
    out = ct.observed_share(b.region_counts(spark, sf)).withColumn("share", r6("share"))
    return dated(out, "date_from", "date_till")


def start_share(spark, sf):
    return ct.start_share(b.user_counts(spark, sf)).withColumn("qt", r6("qt"))


def first_appearance(spark, sf):
    """Event types of each user numbered by first appearance."""
    events = b.table(spark, sf, "events").select(F.col("user_id").alias("series_id"), "event_type", "ts")
    out = ct.first_appearance_id(events, "event_type", "ts", ["series_id"])
    return out.withColumn("label", F.col("label").cast("bigint"))


# --- numbers -----------------------------------------------------------------------------

def log_gamma_values(spark, sf):
    """Log-factorials of the daily counts and log-gamma of the shares."""
    counts = b.segment_counts(spark, sf)
    share = ct.observed_share(counts).filter("share > 0")
    return dated(share.select("series_id", "date_from", "variant",
                              r6(num.log_factorial("n")).alias("ln_factorial"),
                              r6(num.log_gamma("share")).alias("ln_gamma")), "date_from")


def day_numbers(spark, sf):
    """Day number, cut share, label and score arithmetic on the monthly counts."""
    counts = b.region_counts(spark, sf)
    rows = ct.observed_share(counts).join(ct.date_bounds(counts), "series_id")
    k = F.round("share", 6)
    lb = F.lit(0.5) / (F.col("n") + 1)
    return dated(rows.select(
        "series_id", "date_from", "variant",
        num.day_offset("date_from", "t_start").cast("bigint").alias("day"),
        num.floor3(k).alias("k"),
        num.interval_label(num.floor3(lb), num.floor3(k)).alias("label"),
        r6(num.aic(-F.col("n").cast("double"), F.lit(9))).alias("AIC"),
        r6(num.coarsening_bound(num.aic(-F.col("n").cast("double"), F.lit(9)), F.lit(4))).alias("bound"),
        num.num_parameters(F.lit(4), F.lit(5), True, True).alias("num_pars"),
    ), "date_from")


def generation_weights(spark, sf):
    """Lag weights per segment and event type, with its mean value ratio as time scale."""
    rates = b.segment_rates(spark, sf)
    w = gamma_weights(ALPHA, THETA, "k", LAGS)
    return rates.select("series_id", "variant", F.posexplode(w).alias("lag", "weight")).select(
        "series_id", "variant", (F.col("lag") + 1).cast("bigint").alias("lag"), r6("weight").alias("weight"))


def normalised_shares(spark, sf):
    """Mean values of a segment's event types as shares that sum to 1."""
    items = F.array_sort(F.collect_list(F.struct("variant", "k")))
    rates = b.segment_rates(spark, sf).groupBy("series_id").agg(items.alias("items"))
    shares = normalised(F.transform("items", lambda x: x["k"]))
    cells = rates.select("series_id", F.explode(F.arrays_zip("items", shares.alias("share"))).alias("x"))
    return cells.select("series_id", F.col("x.items.variant").alias("variant"), r6("x.share").alias("share"))


def truncation(spark, sf):
    """Days that hold 99 % of the generation time for those time scales, and for one 20 times as long."""
    rates = b.segment_rates(spark, sf)
    return rates.select("series_id", "variant",
                        truncation_days(ALPHA, F.col("k") * THETA).cast("bigint").alias("days"),
                        truncation_days(ALPHA, F.col("k") * (20 * THETA)).cast("bigint").alias("long_days"))


# --- partitions --------------------------------------------------------------------------

def labels_to_partition(spark, sf):
    out = b.order_partition(spark, sf)
    return out.select("series_id", "rgs_key", part.rgs_digest("rgs").alias("sha1"),
                      part.is_rgs("rgs").alias("ok"),
                      part.block_count("rgs").cast("bigint").alias("blocks"))


def labels_to_long(spark, sf):
    out = pt.labels_to_long(b.customer_labels(spark, sf), "orders", "variant")
    return out.select("series_id", "variant", F.col("label").cast("bigint").alias("label"))


def partition_predicates(spark, sf):
    p = b.customer_partitions(spark, sf)
    places = F.sequence(F.lit(1), F.size("by_orders"))
    return p.select(
        "series_id",
        part.is_rgs("by_both").alias("both_is_rgs"),
        part.is_rgs(F.transform("by_orders", lambda x: 1 - x)).alias("flipped_is_rgs"),
        part.is_coarsening("by_orders", "by_both").alias("orders_coarser"),
        part.is_coarsening("by_orders", "by_status").alias("orders_coarser_than_status"),
        part.is_refinement("by_status", "by_orders").alias("status_finer_than_orders"),
        part.is_partition(part.rgs_to_blocks("by_status"), places).alias("status_is_partition"),
        part.is_partition(part.rgs_to_blocks("by_status"), F.sequence(F.lit(1), F.lit(5))).alias("covers_five"),
        part.is_subset("by_status", "by_orders").alias("labels_subset"),
    )


def partition_blocks(spark, sf):
    """Blocks of each partition, in text, and back."""
    p = b.customer_partitions(spark, sf)
    blocks = part.rgs_to_blocks("by_both")
    text = lambda x: F.array_join(F.transform(x, lambda y: F.array_join(y, ",")), "|")
    mixed = F.reverse(F.transform(blocks, lambda x: F.reverse(x)))
    return p.select(
        "series_id",
        text(blocks).alias("blocks"),
        text(part.sort_partition(mixed)).alias("sorted_blocks"),
        part.rgs_key(part.ground_set(mixed)).alias("elements"),
        part.rgs_key(part.blocks_to_rgs(mixed)).alias("rgs"),
        part.rgs_key(part.parse_rgs(part.rgs_key("by_both"))).alias("parsed"),
    )


def distinct_groupings(spark, sf):
    """Distinct partitions with the number of customers: what the closures start from."""
    return b.customer_partitions(spark, sf).groupBy(F.col("by_both").alias("rgs")).agg(
        F.count(F.lit(1)).alias("customers"))


def merge_once(spark, sf):
    """One-step coarsenings per customer, as labels and as blocks."""
    p = b.customer_partitions(spark, sf).select("series_id", F.col("by_both").alias("rgs"))
    out = pt.merge_once(p)
    text = F.array_join(F.transform(part.rgs_to_blocks("child"), lambda y: F.array_join(y, ",")), "|")
    return rgs_text(out.select("series_id", "rgs", F.col("s").cast("bigint").alias("s"),
                               F.col("t").cast("bigint").alias("t"), "child", text.alias("blocks")),
                    "rgs", "child")


def all_coarsenings(spark, sf):
    """Every coarsening of every distinct partition, weighted by its customers."""
    out = pt.all_coarsenings(distinct_groupings(spark, sf))
    return rgs_text(out.groupBy("coarser").agg(F.sum("customers").alias("customers"),
                                               F.count(F.lit(1)).alias("finer")), "coarser")


def common_children(spark, sf):
    """Shared one-step coarsenings of the two partitions of a customer, at equal level."""
    p = b.customer_partitions(spark, sf).filter(
        F.array_max("by_orders") == F.array_max("by_status"))
    shared = part.common_children("by_orders", "by_status")
    return rgs_text(p.select("series_id", F.explode(shared).alias("child")), "child")


def finest_common(spark, sf):
    p = b.customer_partitions(spark, sf)
    return rgs_text(p.select("series_id", part.finest_common_coarsening("by_orders", "by_status").alias("rgs")),
                    "rgs")


def _used(spark, sf):
    return b.customer_labels(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))


def finest_common_long(spark, sf):
    """Finest common coarsening of three partitions of the order priorities of a customer, as memberships."""
    items = b.customer_labels(spark, sf).withColumn("half", F.col("orders") > 2)
    members = items.select("series_id", F.col("variant").alias("pos"), F.explode(F.create_map(
        F.lit("orders"), F.col("orders").cast("string"), F.lit("status"), F.col("status"), F.lit("half"), F.col("half").cast("string"),
    )).alias("source", "label"))
    return pt.common_coarsening(members)


def enumerate_all(spark, sf):
    """All partitions of the priorities each customer uses."""
    return rgs_text(pt.enumerate_partitions(_used(spark, sf), "n", position="place"), "rgs")


def enumerate_at_most(spark, sf):
    return rgs_text(pt.enumerate_partitions(_used(spark, sf), "n", position="place", at_most=F.lit(3)), "rgs")


def enumerate_exactly(spark, sf):
    return rgs_text(pt.enumerate_partitions(_used(spark, sf), "n", position="place", exactly=F.lit(2)), "rgs")


def enumerate_reverse(spark, sf):
    """Partitions of the used priorities by number of priorities, last one first."""
    sizes = _used(spark, sf).groupBy("n").agg(F.count(F.lit(1)).alias("customers"))
    return rgs_text(pt.enumerate_partitions(sizes, "n", position="place", reverse=True), "rgs")


def drop_dominated(spark, sf):
    """One-step coarsenings of ``by_both`` that do not coarsen ``by_orders``."""
    p = materialise(b.customer_partitions(spark, sf))
    children = pt.merge_once(p.select("series_id", F.col("by_both").alias("rgs"))).select(
        "series_id", F.col("child").alias("rgs"))
    pruned = p.select("series_id", F.col("by_orders").alias("rgs"))
    return rgs_text(pt.drop_dominated(pt.distinct_partitions(children), pruned), "rgs")


# --- trajectories ------------------------------------------------------------------------

def _segment_rows(spark, sf, time_scale: bool = False) -> DataFrame:
    """Model rows of the segments: rates from mean values, start shares from counts."""
    counts = b.segment_counts(spark, sf)
    params = b.segment_params(spark, sf, counts)
    if time_scale:
        params = params.withColumn("c", F.sqrt("k"))
    return params_to_arrays(params, series_arrays(counts, BASELINE))


def _long(df: DataFrame, *means: str) -> DataFrame:
    long = tr.explode_trajectory(df, bool(means))
    return dated(long.withColumns({c: r6(c) for c in ("q", *means)}), "date").drop("candidate_id")


def trajectory(spark, sf):
    return _long(tr.with_trajectory(_segment_rows(spark, sf), ALPHA, THETA))


def trajectory_late(spark, sf):
    """Users: event types enter on their first day and the baseline gives way."""
    series = b.series_with_shares(b.user_counts(spark, sf), BASELINE)
    k = F.transform("subjects", lambda v: 1.0 + F.length(v) / 100)
    rows = series.withColumn("k", k)
    return _long(tr.with_trajectory(rows, ALPHA, THETA))


def trajectory_substep(spark, sf):
    """Four steps per day, with late entries."""
    series = b.series_with_shares(b.user_counts(spark, sf), BASELINE)
    rows = series.withColumn("k", F.transform("subjects", lambda v: 1.0 + F.length(v) / 100))
    return _long(tr.with_trajectory(rows, ALPHA, THETA, division=4))


def trajectory_time_scale(spark, sf):
    return _long(tr.with_trajectory(_segment_rows(spark, sf, True), ALPHA, THETA, time_scale=True))


def forecast(spark, sf):
    """Shares of the segments 14 days past the end, and the population means."""
    rows = tr.with_trajectory(_segment_rows(spark, sf), ALPHA, THETA, future=14)
    return _long(rows, "average_c", "average_k")


def population_mean(spark, sf):
    """Mean rate per day by a join of trajectory and parameters."""
    counts = b.segment_counts(spark, sf)
    long = tr.explode_trajectory(tr.with_trajectory(_segment_rows(spark, sf), ALPHA, THETA))
    means = sh.population_mean(long, b.segment_params(spark, sf, counts))
    return dated(means.select("series_id", "date", r6("average_c").alias("average_c"),
                              r6("average_k").alias("average_k")), "date")


def scenario_trajectory(spark, sf):
    """Parameter tables (dates, rates and shares per user) run as scenarios, with expected counts."""
    counts = b.user_counts(spark, sf)
    params = ct.start_share(counts).join(ct.first_seen(counts), ["series_id", "variant"]).select(
        "series_id", "variant", F.col("first_date").alias("date"), F.lit(1.0).alias("c"),
        (1.0 + F.length("variant") / 100).alias("k"), "qt")
    rows = tr.with_trajectory(
        tr.scenario_arrays(params, BASELINE, F.lit(_window(spark, sf)[1])), ALPHA, THETA)
    long = tr.explode_trajectory(rows)
    return dated(long.select("series_id", "date", "variant", r6("q").alias("q"),
                             r6(1000 * F.col("q")).alias("expected")), "date")


def bin_share(spark, sf):
    """Monthly bins against daily trajectories of the regions."""
    counts = b.region_counts(spark, sf)
    series = b.series_with_shares(counts, b.PRIORITY_BASELINE)
    rows = series.withColumn("k", F.transform("subjects", lambda v: 1.0 + F.length(v) / 10000))
    traj = tr.explode_trajectory(tr.with_trajectory(rows, ALPHA, THETA))
    return dated(sh.bin_share(counts, traj).withColumn("p", r6("p")), "date_from", "date_till")


def lag_sum(spark, sf):
    """Lagged sums over the observed daily shares."""
    shares = ct.observed_share(b.all_counts(spark, sf)).select(
        "series_id", F.col("date_from").alias("date"), "variant", F.col("share").alias("q"))
    out = sh.lag_sum(shares, tr.weights_value(ALPHA, THETA), F.lit(1.05))
    return dated(out.select("series_id", "date", "variant", r6("num").alias("num"), r6("total").alias("total")),
                 "date")


def lag_sum_gaps(spark, sf):
    """The same on a calendar that lacks Sundays and Wednesdays."""
    shares = ct.observed_share(b.all_counts(spark, sf)).filter(~F.dayofweek("date_from").isin(1, 4)).select(
        "series_id", F.col("date_from").alias("date"), "variant", F.col("share").alias("q"))
    out = sh.lag_sum(shares, tr.weights_value(ALPHA, THETA), F.lit(1.05))
    return dated(out.select("series_id", "date", "variant", r6("num").alias("num"), r6("total").alias("total")), "date")


def chart_table(spark, sf):
    """Observed next to fitted shares, per segment and day."""
    counts = b.segment_counts(spark, sf)
    traj = tr.explode_trajectory(tr.with_trajectory(_segment_rows(spark, sf), ALPHA, THETA))
    out = rp.chart_table(counts, traj.drop("candidate_id"))
    return dated(out.withColumn("observed", r6("observed")).withColumn("fitted", r6("fitted")), "date")


# --- likelihood and grid -----------------------------------------------------------------

def loglik_multinomial(spark, sf):
    """Weekly bins of the segments under constant rates, array form and relational form."""
    series = b.segment_series(spark, sf, "week")
    rows = tr.with_trajectory(
        series.withColumn("k", F.transform("subjects", lambda v: 1.0 + F.length(v) / 1000)), ALPHA, THETA)
    inside = lk.loglik(rows).select("series_id", r6("ll", 4).alias("ll"), r6("ln_coef", 4).alias("ln_coef"))
    terms = lk.loglik_terms(sh.bin_share(b.segment_counts(spark, sf, "week"), tr.explode_trajectory(rows)))
    return inside.join(terms.select("series_id", r6("ll", 4).alias("ll_terms")), "series_id")


def loglik_dirichlet(spark, sf):
    series = b.segment_series(spark, sf)
    rows = tr.with_trajectory(
        series.withColumn("k", F.transform("subjects", lambda v: 1.0 + F.length(v) / 1000)), ALPHA, THETA)
    return se.union([
        lk.loglik(rows, F.lit(d)).select("series_id", F.lit(d).alias("D"), r6("ll", 4).alias("ll"))
        for d in (10.0, 200.0)
    ])


def loglik_dirichlet_terms(spark, sf):
    """Relational form on weekly bins."""
    series = b.segment_series(spark, sf, "week")
    rows = tr.with_trajectory(
        series.withColumn("k", F.transform("subjects", lambda v: 1.0 + F.length(v) / 1000)), ALPHA, THETA)
    cells = sh.bin_share(b.segment_counts(spark, sf, "week"), tr.explode_trajectory(rows))
    inside = lk.loglik(rows, F.lit(50.0)).select("series_id", r6("ll", 4).alias("ll"))
    terms = lk.loglik_terms(cells, F.lit(50.0)).select("series_id", r6("ll", 4).alias("ll_terms"))
    return inside.join(terms, "series_id")


def loglik_zero_probability(spark, sf):
    """Users as if every type were there from the start with the last type at share 0.

    The multinomial gives the worst value, the Dirichlet form leaves the type out.
    """
    series = b.series_with_shares(b.user_counts(spark, sf), BASELINE)
    rows = series.withColumns({
        "k": F.transform("subjects", lambda v: F.lit(1.0)),
        "intro": F.transform("intro", lambda d: F.lit(0)),
        "qt": F.transform("subjects", lambda v: F.when(v == "signup", 0.0).otherwise(0.2)),
    })
    rows = tr.with_trajectory(rows, ALPHA, THETA)
    multi = lk.loglik(rows).select("series_id", (F.col("ll") < -1e300).alias("impossible"))
    diri = lk.loglik(rows, F.lit(10.0)).select("series_id", r6("ll", 4).alias("ll_dirichlet"))
    return multi.join(diri, "series_id")


def _grid(spark, sf) -> DataFrame:
    return lk.grid_scores(b.segment_series(spark, sf), RATES, ALPHA, THETA)


def _best(spark, sf) -> DataFrame:
    return lk.best_point(_grid(spark, sf))


def _best_rates(x: DataFrame, *more: str) -> DataFrame:
    cells = x.select("series_id", r6("ll", 4).alias("ll"), *more, F.explode(F.arrays_zip("subjects", "k")).alias("x"))
    return cells.select("series_id", "ll", *more, F.col("x.subjects").alias("variant"), F.col("x.k").alias("k"))


def fit_grid(spark, sf):
    """Best of all rate combinations per segment."""
    return _best_rates(_best(spark, sf))


def fit_grid_window(spark, sf):
    """The same for listed event types, without the first and the last week of the table."""
    first, last = _window(spark, sf)
    start, end = F.date_add(F.lit(first), 7), F.date_sub(F.lit(last), 7)
    counts = ct.clip_window(ct.keep_subjects(b.segment_counts(spark, sf), LISTED, BASELINE), start, end)
    series = b.series_with_shares(counts, BASELINE, start, end)
    return _best_rates(lk.best_point(lk.grid_scores(series, RATES, ALPHA, THETA)))


def fit_grid_substep(spark, sf):
    """Two steps of the model per day."""
    return _best_rates(lk.best_point(lk.grid_scores(b.segment_series(spark, sf), COARSE_RATES, ALPHA, THETA, division=2)))


def fit_grid_time_scale(spark, sf):
    """Rates and one common time-scale ratio per segment."""
    scores = lk.grid_scores(b.segment_series(spark, sf), COARSE_RATES, ALPHA, THETA, time_scales=RATIOS)
    return _best_rates(lk.best_point(scores).withColumn("c", F.col("c")[0]), "c")


def fit_grid_scales(spark, sf):
    """Rates and a time-scale ratio of its own per listed event type, without the first and the last week."""
    first, last = _window(spark, sf)
    start, end = F.date_add(F.lit(first), 7), F.date_sub(F.lit(last), 7)
    counts = ct.clip_window(ct.keep_subjects(b.segment_counts(spark, sf), LISTED, BASELINE), start, end)
    scores = lk.grid_scores(b.series_with_shares(counts, BASELINE, start, end), b.UNEVEN_RATES, ALPHA, THETA, time_scales=RATIOS, each=True)
    best = lk.best_point(scores)
    cells = best.select("series_id", r6("ll", 4).alias("ll"), F.explode(F.arrays_zip("subjects", "k", "c")).alias("x"))
    return cells.select("series_id", "ll", F.col("x.subjects").alias("variant"), F.col("x.k").alias("k"), F.col("x.c").alias("c"))


def fit_grid_dirichlet(spark, sf):
    """Rates and the concentration of the Dirichlet-multinomial per segment."""
    scores = lk.grid_scores(b.segment_series(spark, sf), COARSE_RATES, ALPHA, THETA, concentrations=CONCENTRATIONS)
    return _best_rates(lk.best_point(scores).withColumnRenamed("d", "D"), "D")


def grid_loglik(spark, sf):
    """Log-likelihood of every grid point."""
    return _grid(spark, sf).select("series_id", "candidate_id", r6("ll", 4).alias("ll"))


def _grid_params(points: DataFrame) -> DataFrame:
    cells = points.select("series_id", "candidate_id", F.explode(F.arrays_zip("subjects", "k", "qt")).alias("x"))
    return cells.select("series_id", "candidate_id", F.col("x.subjects").alias("variant"),
                        F.lit(1.0).alias("c"), F.col("x.k").alias("k"), F.col("x.qt").alias("qt"))


def profile_ci_grid(spark, sf):
    """Range of each rate over the grid points inside the likelihood cut."""
    return sh.param_range(_grid_params(lk.likelihood_region(_grid(spark, sf), 1)), "k")


def _point_shares(points: DataFrame, series: DataFrame) -> DataFrame:
    """Daily shares and means of grid points ``(series_id, candidate_id, k)``, folded again from the series."""
    rows = attach_series(points, series.drop("bins")).withColumn("c", F.transform("k", lambda x: F.lit(1.0)))
    return tr.explode_trajectory(tr.with_trajectory(rows, ALPHA, THETA), means=True)


def region_bands_grid(spark, sf):
    """Bands of shares and mean rate over the best grid point and the extreme points of the joint region."""
    series = b.segment_series(spark, sf)
    points = lk.extreme_points(lk.likelihood_region(lk.grid_scores(series, RATES, ALPHA, THETA)))
    out = rp.bands(_point_shares(points, series))
    cols = ["q_lb", "q_ub", "average_k_lb", "average_k_ub"]
    return dated(out.withColumns({c: r6(c) for c in cols}).drop("average_c_lb", "average_c_ub"), "date")


def baseline_range_grid(spark, sf):
    """Range of the baseline start share over the user shares, weeks as replicates."""
    counts = b.user_counts(spark, sf, "week")
    shares = ct.observed_share(ct.nonempty_bins(counts)).filter(F.col("variant") != BASELINE)
    bounds = ct.date_bounds(counts)
    replicates = shares.select("series_id", "variant", F.col("date_from").alias("candidate_id"),
                               F.col("share").alias("qt")).join(
        ct.first_seen(counts).withColumnRenamed("first_date", "date"), ["series_id", "variant"])
    out = sh.baseline_range(replicates, bounds)
    return out.select("series_id", r6("qt_lb").alias("qt_lb"), r6("qt_ub").alias("qt_ub"))


def _blocks(spark, sf) -> DataFrame:
    """Per segment the event types in blocks of equal best grid rate, baseline first."""
    best = _best(spark, sf)
    rgs = part.to_rgs(F.concat(F.array(F.lit(1.0)), F.col("k")))
    names = F.concat(F.array(F.col("baseline")), F.col("subjects"))
    cells = best.select("series_id", F.explode(F.arrays_zip(names.alias("v"), rgs.alias("b"))).alias("x"))
    return cells.select("series_id", F.col("x.v").alias("variant"), F.col("x.b").cast("bigint").alias("block"))


def blocks_report(spark, sf):
    return rp.blocks_report(_blocks(spark, sf).filter(F.col("variant") != BASELINE), BASELINE)


def warm_start(spark, sf):
    """Start rate per block: mean of the value ratios of its event types, by name."""
    out = sh.mean_by_block(b.segment_rates(spark, sf), _blocks(spark, sf))
    return out.withColumn("k", r6("k"))


def shared_rates(spark, sf):
    """Rate of every event type through its block; block 0 has rate 1."""
    blocks = _blocks(spark, sf)
    out = sh.apply_blocks(blocks, sh.mean_by_block(b.segment_rates(spark, sf), blocks))
    return out.select("series_id", "variant", "block", r6("k").alias("k"))


def _grid_estimates(spark, sf) -> DataFrame:
    counts = b.segment_counts(spark, sf)
    return _grid_report(counts, materialise(lk.grid_scores(b.series_with_shares(counts, BASELINE), RATES, ALPHA, THETA)))


def _grid_report(counts: DataFrame, grid: DataFrame) -> DataFrame:
    """Estimates report of a grid fit: best point, ranges over the region, baseline row."""
    first = ct.first_seen(counts).withColumnRenamed("first_date", "date")
    params = _grid_params(lk.best_point(grid)).join(first, ["series_id", "variant"])
    inside = _grid_params(lk.likelihood_region(grid, 1)).join(first, ["series_id", "variant"])
    return rp.estimates_report(params, ct.date_bounds(counts), BASELINE, inside)


def estimates_report(spark, sf):
    out = _grid_estimates(spark, sf)
    return dated(out.withColumns({c: r6(c) for c in ("qt", "qt_lb", "qt_ub")}), "date")


def group_report(spark, sf):
    return rp.group_report(_grid_estimates(spark, sf))


def rate_report(spark, sf):
    return rp.rate_report(_grid_estimates(spark, sf))


def order_by_rate(spark, sf):
    """Event types of all segments by mean value ratio, highest first."""
    rates = b.segment_rates(spark, sf).withColumn("k", r6("k"))
    return rk.order_by_rate(rates).withColumn("variant", F.concat_ws(":", "series_id", "variant")).drop("series_id")


def score_report(spark, sf):
    """Maximum log-likelihood, parameter count and AIC of the finest grid model."""
    best = _best(spark, sf).withColumn("num_pars", num.num_parameters(F.size("k"), F.size("k")))
    out = rp.score_report(best.withColumn("AIC", num.aic("ll", "num_pars")))
    return out.withColumn("maxll", r6("maxll", 4)).withColumn("AIC", r6("AIC", 4))


def frequency_report(spark, sf):
    """Wide daily shares with population means, best grid point."""
    series = b.segment_series(spark, sf)
    best = lk.best_point(lk.grid_scores(series, RATES, ALPHA, THETA))
    names = ct.category_names(b.segment_counts(spark, sf))
    out = rp.frequency_report(_point_shares(best.select("series_id", "k"), series), names)
    return dated(out.withColumns({c: r6(c) for c in [*names, "average_c", "average_k"]}), "date")


def frequency_report_bounds(spark, sf):
    """The same with the bands of the shares and means over the joint region."""
    series = b.segment_series(spark, sf)
    region = materialise(lk.likelihood_region(lk.grid_scores(series, RATES, ALPHA, THETA)))
    ranges = rp.bands(_point_shares(lk.extreme_points(region), series))
    best = _point_shares(lk.best_point(region).select("series_id", "k"), series)
    out = rp.frequency_report(best, ct.category_names(b.segment_counts(spark, sf)), ranges)
    return dated(out.withColumns({c: r6(f"`{c}`") for c in out.columns if c not in ("series_id", "date")}), "date")


# --- search ------------------------------------------------------------------------------

def _patterns(spark, sf) -> DataFrame:
    return lk.point_partition_scores(_grid(spark, sf))


def _finest(spark, sf) -> DataFrame:
    n = b.segment_counts(spark, sf).groupBy("series_id").agg(F.count_distinct("variant").alias("n"))
    return n.select("series_id", F.sequence(F.lit(0), (F.col("n") - 1).cast("int")).alias("rgs"))


def _every_grouping(spark, sf) -> DataFrame:
    """All groupings of the event types of a segment, scored on the grid."""
    every = pt.enumerate_partitions(
        _finest(spark, sf).select("series_id", F.size("rgs").alias("n")), "n").drop("n")
    scorer = se.grid_scorer(_patterns(spark, sf), _types(spark, sf))
    return pt.with_level(scorer(every))


def _rounded(df: DataFrame) -> DataFrame:
    cols = [c for c in ("ll", "AIC", "lb_agg_AIC", "best_before", "best_AIC") if c in df.columns]
    out = df.withColumns({c: r6(c, 4) for c in cols})
    return rgs_text(out, "rgs") if dict(out.dtypes).get("rgs", "").startswith("array") else out


def partition_scores(spark, sf):
    """Every grouping scored exhaustively."""
    return _rounded(_every_grouping(spark, sf))


def beam(spark, sf):
    """Best two AIC values per level, ties kept."""
    return _rounded(rk.beam(_every_grouping(spark, sf), 2))


def running_best(spark, sf):
    """Lowest AIC among the groupings before each one."""
    text = materialise(rgs_text(_every_grouping(spark, sf), "rgs"))
    return _rounded(rk.running_best(text)).select("series_id", "level", "rgs", "AIC", "best_before")


def best_partition(spark, sf):
    text = materialise(rgs_text(_every_grouping(spark, sf), "rgs"))
    best = rk.best_partition(text)
    low = rk.best_so_far(text)
    return _rounded(best.join(low, "series_id"))


def _search(spark, sf, width: int = 1, grid: DataFrame | None = None, **stored) -> tuple[DataFrame, DataFrame]:
    patterns = materialise(lk.point_partition_scores(_grid(spark, sf) if grid is None else grid))
    scorer = se.grid_scorer(patterns, _types(spark, sf))
    return se.search_partitions(_finest(spark, sf), scorer, width, **stored)


def search_grid(spark, sf):
    """Level-wise beam search with the grid scorer."""
    scores, _ = _search(spark, sf)
    return _rounded(se.ledger(scores))


def pruned_grid(spark, sf):
    _, pruned = _search(spark, sf, 2)
    return rgs_text(pruned, "rgs")


def search_stored(spark, sf):
    """A wider search that reads the scores of an earlier one from the table they were written to."""
    earlier, _ = _search(spark, sf)
    keys = materialise(se.fingerprints(b.segment_counts(spark, sf), "grid", RATES, ALPHA, THETA))
    stored = tb.read_estimates(spark, tb.write_table(se.new_scores(earlier, None, keys), work_path(spark), "scores"), "parquet")
    scores, _ = _search(spark, sf, 2, stored=stored, config_hash=keys)
    return _rounded(se.ledger(scores))


def refit_report(spark, sf):
    """From counts to the report of the best grouping: search, refit with that grouping, ranges, shared rows."""
    grid = materialise(_grid(spark, sf))
    scores, _ = _search(spark, sf, grid=grid)
    best = rk.best_partition(rgs_text(scores, "rgs"))
    inside = materialise(lk.within_grouping(grid, best.withColumn("rgs", F.split("rgs", "-").cast("array<int>"))))
    return rp.group_report(_grid_report(b.segment_counts(spark, sf), inside))


def level_summary(spark, sf):
    scores, _ = _search(spark, sf, 2)
    return rk.level_summary(scores)


def pending_candidates(spark, sf):
    """Customer groupings by orders whose digest is not among those by status of the customer."""
    p = materialise(b.customer_partitions(spark, sf))
    keyed = p.select("series_id", F.lit("run").alias("config_hash"),
                     part.rgs_digest("by_orders").alias("sha1"), F.col("by_orders").alias("rgs"))
    stored = p.select("series_id", F.lit("run").alias("config_hash"), part.rgs_digest("by_status").alias("sha1"))
    return rgs_text(se.pending(keyed, stored), "rgs")


# --- continuous fits ---------------------------------------------------------------------

OPTIONS = ft.Options(ALPHA, THETA)


def _fits(spark, sf, options=OPTIONS, grain="day") -> tuple[DataFrame, DataFrame]:
    series = series_arrays(b.segment_counts(spark, sf, grain), BASELINE)
    return series, materialise(ft.scored(ft.fit(ft.finest_start(series), options), options))


def _pair_fits(spark, counts: DataFrame, options=OPTIONS) -> tuple[DataFrame, DataFrame]:
    """One subject against the baseline per series, both there from the start."""
    counts = counts.filter(F.col("variant").isin(LISTED[0], BASELINE))
    series = materialise(series_arrays(counts, BASELINE, undetected=True))
    return series, materialise(ft.scored(rf.fit(rf.finest(series), options), options))


def fit_pair(spark, sf):
    """Continuous fit of one subject per segment: rate, start share, likelihood."""
    _, fits = _pair_fits(spark, b.segment_counts(spark, sf))
    return fits.select("series_id", r6(F.col("k")[0], 4).alias("k"), r6(F.col("qt")[0], 4).alias("qt"),
                       r6("ll", 4).alias("maxll"), "num_pars", r6("AIC", 4).alias("AIC"), "converged")


def profile_ci_pair(spark, sf):
    """Profile-likelihood intervals of rate and start share of one subject over all events, with the likelihood at each end."""
    series, fits = _pair_fits(spark, b.all_counts(spark, sf))
    ends = rf.interval_solutions(fits, series, OPTIONS)
    value = F.when(F.col("param") == 0, F.col("k")[0]).otherwise(F.col("qt")[0])
    return ends.select("series_id", "param", "side", r6(value, 3).alias("value"), r6("ll", 3).alias("ll"))


def region_bands_pair(spark, sf):
    """Bands of the shares over the extreme solutions of the joint region of one subject, all events."""
    series, fits = _pair_fits(spark, b.all_counts(spark, sf))
    out = rp.region_bands(fits, rf.interval_solutions(fits, series, OPTIONS, joint=True), series, OPTIONS)
    return dated(out.select("series_id", "date", "variant", r6("q_lb", 3).alias("q_lb"), r6("q_ub", 3).alias("q_ub")), "date")


def dirichlet_report(spark, sf):
    """Concentration and its interval for weekly bins and rates that follow from the names."""
    series = b.segment_series(spark, sf, "week")
    rows = tr.with_trajectory(
        series.withColumns({"k": F.transform("subjects", lambda v: 1.0 + F.length(v) / 100),
                            "rgs": F.sequence(F.lit(0), F.size("subjects"))}), ALPHA, THETA)
    out = rp.concentration_report(rows, ft.Options(ALPHA, THETA, dirichlet=True))
    return out.select("series_id", *[r6(F.log10(c), 4).alias(f"log10_{c}") for c in ("D", "D_lb", "D_ub")])


def fit(spark, sf):
    """Maximum likelihood per segment."""
    series, fits = _fits(spark, sf)
    return ft.array_params(fits, series).join(fits.select("series_id", "ll", "num_pars", "AIC"), "series_id")


def fit_users(spark, sf):
    """One small fit per user: many series at once."""
    series = series_arrays(b.user_counts(spark, sf), BASELINE)
    started = ft.finest_start(series)
    return ft.fit_summary(ft.fit(started, OPTIONS), OPTIONS)


def fit_parts(spark, sf):
    """Shipped part types per return flag: monthly bins over seven years of days."""
    series = series_arrays(b.part_counts(spark, sf), b.TYPE_BASELINE)
    return ft.fit_summary(ft.fit(ft.finest_start(series), OPTIONS), OPTIONS)


def fit_shared(spark, sf):
    """Refit with the blocks of equal grid rate, started from the finest fit."""
    series, fits = _fits(spark, sf)
    rgs = part.to_rgs(F.concat(F.array(F.lit(1.0)), F.col("k")))
    blocks = _best(spark, sf).select("series_id", rgs.alias("rgs"))
    started = ft.named_start(series, ft.array_params(fits, series))
    return ft.fit_summary(ft.fit(ft.warm_start(blocks, started), OPTIONS), OPTIONS)


def _constant_fits(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All rates tied to the baseline: shares stay constant, so the optimum is the pooled share."""
    series = series_arrays(b.segment_counts(spark, sf), BASELINE, undetected=True)
    tied = series.select("series_id", F.transform(F.sequence(F.lit(0), F.size("subjects")), lambda i: F.lit(0)).alias("rgs"))
    return series, ft.scored(ft.fit(ft.default_start(tied, series), OPTIONS), OPTIONS)


def fit_constant(spark, sf):
    """Continuous fit of the coarsest grouping, for which SQL knows the optimum."""
    series, fits = _constant_fits(spark, sf)
    params = ft.array_params(fits, series).select("series_id", "variant", r6("k").alias("k"), r6("qt", 4).alias("qt"))
    return params.join(rp.score_report(fits).select("series_id", r6("maxll", 4).alias("maxll"), "num_pars",
                                                    r6("AIC", 4).alias("AIC")), "series_id")


def profile_ci_constant(spark, sf):
    """Profile intervals of the start shares of the coarsest grouping, baseline included."""
    series, fits = _constant_fits(spark, sf)
    fits = materialise(fits)
    solutions = ft.array_params(ft.solution_ids(ft.interval_solutions(fits, series, OPTIONS)), series)
    out = rp.estimates_report(ft.array_params(fits, series), series.select("series_id", "t_start"), BASELINE, solutions)
    return out.select("series_id", "variant", *[r6(c, 4).alias(c) for c in ("qt", "qt_lb", "qt_ub")])


def region_bands_constant(spark, sf):
    """Joint-region bands of the coarsest grouping, three days ahead."""
    series, fits = _constant_fits(spark, sf)
    fits = materialise(fits)
    out = rp.region_bands(fits, ft.interval_solutions(fits, series, OPTIONS, joint=True), series, OPTIONS, future=3)
    cols = ["q_lb", "q_ub", "average_k_lb", "average_k_ub"]
    return dated(out.select("series_id", "date", "variant", *[r6(c, 4).alias(c) for c in cols]), "date")


def fit_time_scale(spark, sf):
    options = ft.Options(ALPHA, THETA, time_scale=True)
    series, fits = _fits(spark, sf, options)
    return ft.array_params(fits, series)


def fit_dirichlet(spark, sf):
    """Concentration and its interval, weekly bins."""
    options = ft.Options(ALPHA, THETA, dirichlet=True)
    series, fits = _fits(spark, sf, options, "week")
    return rp.dirichlet_report(fits, ft.interval_solutions(fits, series, options))


def profile_ci(spark, sf):
    """Estimates with profile-likelihood intervals."""
    series, fits = _fits(spark, sf)
    solutions = ft.solution_ids(ft.interval_solutions(fits, series, OPTIONS))
    bounds = series.select("series_id", "t_start")
    return rp.estimates_report(ft.array_params(fits, series), bounds, BASELINE,
                               ft.array_params(solutions, series))


def region_bands(spark, sf):
    """Joint-region bands of the shares and means, 7 days ahead."""
    series, fits = _fits(spark, sf)
    solutions = ft.interval_solutions(fits, series, OPTIONS, joint=True)
    return rp.region_bands(fits, solutions, series, OPTIONS, future=7)


def search_fit(spark, sf):
    """Search with continuous fits per segment, each started from the finest fit."""
    series = materialise(series_arrays(b.segment_counts(spark, sf), BASELINE))
    finest = ft.finest_candidates(series)
    best = ft.array_params(ft.fit(ft.finest_start(series), OPTIONS), series)
    scores, _ = se.search_partitions(finest, se.fit_scorer(series, OPTIONS, best), 1)
    return se.ledger(scores)


NAMES = [
    daily_counts, weekly_counts, monthly_counts, day_bins, wide_counts, read_write_counts,
    read_write_reports, variant_violations, window_violations, bin_width_violations,
    block_violations, keep_subjects, clip_window, variant_index, baseline_first_index, date_bounds,
    first_seen, bin_totals, observed_share, start_share, first_appearance, log_gamma_values,
    day_numbers, generation_weights, normalised_shares, truncation, labels_to_partition,
    labels_to_long, partition_predicates, partition_blocks, merge_once, all_coarsenings,
    common_children, finest_common, enumerate_all, enumerate_at_most, enumerate_exactly,
    enumerate_reverse, drop_dominated, trajectory, trajectory_late, trajectory_substep,
    trajectory_time_scale, forecast, population_mean, scenario_trajectory, bin_share, lag_sum, lag_sum_gaps, finest_common_long, fit_grid_scales,
    chart_table, loglik_multinomial, loglik_dirichlet, loglik_dirichlet_terms,
    loglik_zero_probability, fit_grid, fit_grid_window, fit_grid_substep, fit_grid_time_scale, fit_grid_dirichlet, grid_loglik, profile_ci_grid, region_bands_grid,
    baseline_range_grid, blocks_report, warm_start, shared_rates, estimates_report, group_report,
    rate_report, order_by_rate, score_report, frequency_report, frequency_report_bounds, partition_scores, beam,
    running_best, best_partition, search_grid, pruned_grid, level_summary, search_stored, refit_report,
    pending_candidates,
    fit_pair, profile_ci_pair, region_bands_pair, dirichlet_report,
    fit_constant, profile_ci_constant, region_bands_constant, fit, fit_users, fit_parts, fit_shared,
    fit_time_scale, fit_dirichlet, profile_ci, region_bands, search_fit,
]
QUERIES = {f.__name__: f for f in NAMES}
