"""Tidy report tables from fits, trajectories and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.functions.gamma import chi2_quantile
from tideshare.functions.numbers import floor3, interval_label, let
from tideshare.operators.counts import observed_share, to_wide
from tideshare.operators.ranking import with_place
from tideshare.operators.shares import (
    baseline_range,
    baseline_share,
    concat_names,
    observed_vs_fitted,
)
from tideshare.plans import scoring
from tideshare.plans.fit import Options, solution_ids
from tideshare.plans.likelihood import bin_probabilities
from tideshare.plans.refine import model_of
from tideshare.plans.series import attach_series
from tideshare.plans.trajectory import explode_trajectory, with_trajectory


def estimates_report(params: DataFrame, bounds: DataFrame, baseline: str,
                     solutions: DataFrame | None = None) -> DataFrame:
    """One row per category: ``date, c, k, qt`` and, with interval solutions, their ranges.

    ``params`` is ``(series_id, variant, date, c, k, qt)`` of the subjects, ``solutions`` the
    same with a ``candidate_id`` per interval end. The baseline has c = k = 1 and the rest of
    the start shares.
    """
    one = F.lit(1.0)
    base = baseline_share(params, bounds).join(bounds.select("series_id", "t_start"), "series_id").select(
        "series_id", F.lit(baseline).alias("variant"), F.col("t_start").alias("date"),
        one.alias("c"), one.alias("k"), "qt",
    )
    if solutions is not None:
        base = base.join(baseline_range(solutions, bounds), "series_id")
        for v in ("c", "k"):
            base = base.withColumn(f"{v}_lb", one).withColumn(f"{v}_ub", one)
        ranges = solutions.groupBy("series_id", "variant").agg(
            *[f(v).alias(f"{v}_{e}") for v in ("c", "k", "qt") for f, e in ((F.min, "lb"), (F.max, "ub"))]
        )
        params = params.join(ranges, ["series_id", "variant"])
    ends = ("", "_lb", "_ub") if solutions is not None else ("",)
    columns = ["series_id", "variant", "date", *[v + e for v in ("c", "k", "qt") for e in ends]]
    return base.select(*columns).unionByName(params.select(*columns))


def dirichlet_report(fits: DataFrame, solutions: DataFrame | None = None) -> DataFrame:
    out = fits.select("series_id", F.col("d").alias("D"))
    if solutions is None:
        return out
    ranges = solutions.withColumn("D", F.col("d")).groupBy("series_id").agg(
        F.min("D").alias("D_lb"), F.max("D").alias("D_ub")
    )
    return out.join(ranges, "series_id")


def concentration_report(rows: DataFrame, options: Options) -> DataFrame:
    """``(series_id, D, D_lb, D_ub)`` for rows with ``traj`` and ``bins``: shares as given, 95 % interval."""
    model = model_of(options)
    p = F.transform("bins", lambda b: bin_probabilities(F.col("traj"), b))
    found = let(p, lambda q: scoring.concentration(model, q, chi2_quantile(1) / 2))
    return rows.select("series_id", F.inline(F.array(found))).select(
        "series_id", F.col("d").alias("D"), F.col("d_lb").alias("D_lb"), F.col("d_ub").alias("D_ub"))


def blocks_report(params: DataFrame, baseline: str) -> DataFrame:
    """``(series_id, variant, block)`` with the baseline in block 0."""
    base = params.select("series_id").distinct().select(
        "series_id", F.lit(baseline).alias("variant"), F.lit(0).cast("bigint").alias("block")
    )
    return base.unionByName(params.select("series_id", "variant", F.col("block").cast("bigint").alias("block")))


def model_rows(fits: DataFrame, series: DataFrame) -> DataFrame:
    """Parameter arrays next to the dates and names of their series."""
    light = series.select("series_id", "t_start", "n_days", "subjects", "baseline", "intro")
    keep = [c for c in ("series_id", "candidate_id", "c", "k", "qt", "rgs") if c in fits.columns]
    return attach_series(fits.select(*keep), light)


def fitted_trajectory(fits: DataFrame, series: DataFrame, options: Options, future: int = 0) -> DataFrame:
    """Long daily shares and means of fitted parameters, ``future`` days past the end."""
    rows = with_trajectory(model_rows(fits, series), options.alpha, options.theta, len(options.weights),
                           future=future, time_scale=options.time_scale)
    return explode_trajectory(rows, means=True)


def bands(traj: DataFrame) -> DataFrame:
    """Range of the shares and means per day and category over all candidates, in one aggregate."""
    values = ("q", "average_c", "average_k")
    ends = [f(v).alias(f"{v}_{e}") for v in values for f, e in ((F.min, "lb"), (F.max, "ub"))]
    return traj.groupBy("series_id", "date", "variant").agg(*ends)


def region_bands(fits: DataFrame, solutions: DataFrame, series: DataFrame, options: Options,
                 future: int = 0) -> DataFrame:
    """Bands of the daily shares and of the mean rate and time scale.

    The best fit and every extreme solution run through the same fold once; the bands are one
    partial aggregate over their days.
    """
    ids = ["series_id", "candidate_id", "rgs", "c", "k", "qt"]
    best = fits.withColumn("candidate_id", F.lit(-1).cast("bigint")).select(*ids)
    every = best.unionByName(solution_ids(solutions).select(*ids))
    return bands(fitted_trajectory(every, series, options, future))


def frequency_report(traj: DataFrame, variants: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """One row per day: share per category, population means and, if given, the bands."""
    keys = ["series_id", "date", "average_c", "average_k"]
    if ranges is None:
        return to_wide(traj, keys, {"q": ""}, variants)
    both = traj.join(ranges, ["series_id", "date", "variant"])
    keys += [f"average_{v}_{e}" for v in ("c", "k") for e in ("lb", "ub")]
    return to_wide(both, keys, {"q": "", "q_lb": "_lb", "q_ub": "_ub"}, variants)


def group_report(estimates: DataFrame) -> DataFrame:
    """Categories with equal (cut) rate and interval in one row, highest rate first; ``place`` counts from 1."""
    cut = estimates.select(
        "series_id", "variant", floor3("k").alias("k"),
        interval_label(floor3("k_lb"), floor3("k_ub")).alias("k_ci_95"),
    )
    groups = concat_names(cut, ["series_id", "k", "k_ci_95"], "variant")
    rows = groups.select("series_id", "variant", "k", "k_ci_95")
    return with_place(rows, F.desc("k"), "variant").orderBy("series_id", "place")


def rate_report(estimates: DataFrame) -> DataFrame:
    """One row per category, highest rate first; ``place`` counts from 1."""
    ordered = with_place(estimates, F.desc("k"), "variant").orderBy("series_id", "place")
    return ordered.select(
        "series_id", "variant", floor3("k").alias("k"),
        interval_label(floor3("k_lb"), floor3("k_ub")).alias("k_ci_95"), "place",
    )


def chart_table(counts: DataFrame, traj: DataFrame) -> DataFrame:
    """Observed and fitted share per day and category."""
    return observed_vs_fitted(observed_share(counts), traj).select(
        "series_id", "date", "variant", F.col("share").alias("observed"), F.col("q").alias("fitted")
    )


def score_report(scores: DataFrame) -> DataFrame:
    return scores.select("series_id", F.col("ll").alias("maxll"), "num_pars", "AIC")

