"""Continuous maximum likelihood, intervals and bands as Spark jobs.

One row is one fit: (series, grouping), or (series, grouping, parameter, side) for an interval
end. Rows are spread over tasks by these keys; inside a task NumPy works on Arrow batches of
small dense problems (see ``functions.renewal``). Likelihoods can be recomputed in the JVM by
``plans.likelihood``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.gamma import chi2_quantile, weights_value
from tideshare.functions.numbers import aic, array_sum, num_parameters
from tideshare.functions.partitions import rgs_key
from tideshare.functions.renewal import (
    START_CONCENTRATION,
    START_RATE,
    START_SCALE,
    START_SHARE,
    Fits,
)
from tideshare.plans.series import attach_series, narrow_bins, spread

FIT_SCHEMA = (
    "series_id string, rgs array<int>, ll double, k array<double>, qt array<double>, "
    "c array<double>, d double, converged boolean"
)
SOLUTION_SCHEMA = (
    "series_id string, rgs array<int>, param int, side int, ll double, k array<double>, "
    "qt array<double>, c array<double>, d double"
)
#: Further starts of a fit: factor of the rates, share of every subject.
OTHER_STARTS = [(factor, share) for factor in (0.6, 0.8, 1.25, 1.7) for share in (0.002, 0.02, 0.2)]
#: Start shares of the subjects together are at most this.
HIGHEST_START = 0.9
#: Bytes of counts and information matrices that fits worked on together may hold.
BATCH = 256 * 2**20
ARRAYS = ["intro", "n_days", "d1", "d2", "flat"]


def finest_candidates(series: DataFrame) -> DataFrame:
    """Every category its own block."""
    return series.select("series_id", F.sequence(F.lit(0), F.size("subjects")).alias("rgs"))


def finest_start(series: DataFrame) -> DataFrame:
    """The finest candidate of each series, ready to fit: made from the series row, no join."""
    rows = fixed_start(series)
    return spread(rows.withColumn("rgs", F.sequence(F.lit(0), F.size("intro"))))


def default_start(candidates: DataFrame, series: DataFrame) -> DataFrame:
    """Candidates ``(series_id, rgs)`` with the fixed start values."""
    return attach_series(candidates, fixed_start(series))


def block_rates(rows: DataFrame) -> DataFrame:
    """Start rate of each subject: the mean earlier rate of its block."""
    block = F.slice("rgs", F.lit(2), F.size("rgs") - 1)
    pairs = F.arrays_zip(block.alias("b"), F.col("k").alias("k"))

    def mean_rate(b):
        same = F.transform(F.filter(pairs, lambda x: x["b"] == b), lambda x: x["k"])
        return F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x) / F.size(same)

    return rows.withColumn("k", F.transform(block, mean_rate))


def fixed_start(series: DataFrame) -> DataFrame:
    """Lean series rows with the fixed start values."""
    rows = lean(series)
    return rows.withColumns({
        "k": F.transform("intro", lambda x: F.lit(START_RATE)),
        "qt": F.transform("intro", lambda x: F.lit(START_SHARE)),
    })


def named_start(series: DataFrame, estimates: DataFrame) -> DataFrame:
    """Lean series rows with the earlier ``(series_id, variant, k, qt)``, matched by name.

    A category without an earlier estimate has the fixed start values, and so has a whole series.
    """
    packed = estimates.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", F.struct("k", "qt")))).alias("m")
    )
    rows = lean(series, "subjects").join(packed, "series_id", "left")

    def value(field: str, fixed: float) -> Column:
        return F.transform("subjects", lambda v: F.coalesce(F.try_element_at("m", v)[field], F.lit(fixed)))

    found = {"k": value("k", START_RATE), "qt": value("qt", START_SHARE)}
    return rows.withColumns(found).drop("m", "subjects")


def warm_start(candidates: DataFrame, started: DataFrame) -> DataFrame:
    """Candidates with earlier values from ``named_start``: mean rate per block, share per category."""
    return block_rates(attach_series(candidates, started))


def lean(series: DataFrame, *more: str) -> DataFrame:
    """Only what a fit reads, with flat arrays."""
    return series.select(
        "series_id", "intro", "n_days", *more,
        F.transform("bins", lambda b: b["d1"]).alias("d1"),
        F.transform("bins", lambda b: b["d2"]).alias("d2"),
        F.flatten(F.transform("bins", lambda b: b["n"])).alias("flat"),
    )


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


class Options:
    """Run options that every fit of a job shares."""

    def __init__(self, alpha: float, theta: float, length: int | None = None,
                 time_scale: bool = False, dirichlet: bool = False):
        self.alpha, self.theta = alpha, theta
        self.weights = weights_value(alpha, theta, length)
        self.time_scale, self.dirichlet = time_scale, dirichlet

    def batches(self, rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Fits]]:
        """Rows with equally many categories together, sorted by length to save padding, in
        pieces whose counts and information fit in memory."""
        width = rows["rgs"].str.len()
        for s, same in rows.groupby(width, sort=False):
            same = same.sort_values("n_days", kind="stable")
            per_row = 8 * s * (int(same["n_days"].max()) + 4 * 9 * s)
            step = max(1, BATCH // per_row)
            for at in range(0, len(same), step):
                piece = same.iloc[at : at + step]
                yield piece, self.fits(piece, s)

    def fits(self, rows: pd.DataFrame, s: int) -> Fits:
        bins = int(rows["d1"].str.len().max())
        d1 = np.ones((bins, len(rows)), dtype=int)
        d2 = np.ones((bins, len(rows)), dtype=int)
        n = np.zeros((bins, len(rows), s))
        for i, (a, b, flat) in enumerate(zip(rows["d1"], rows["d2"], rows["flat"])):
            d1[: len(a), i], d2[: len(b), i] = a, b
            n[: len(a), i] = np.reshape(flat, (-1, s))
        return Fits(stack(rows["rgs"])[:, 1:].astype(int), stack(rows["intro"]), d1, d2, n,
                    np.asarray(self.weights), self.alpha, self.theta, self.time_scale, self.dirichlet)

    def num_pars(self):
        return num_parameters(F.array_max("rgs"), F.size("rgs") - 1, self.time_scale, self.dirichlet)


def result(keys: pd.DataFrame, f: Fits, par: np.ndarray, ll: np.ndarray) -> pd.DataFrame:
    k, qt, c, d = f.unpack(par)
    return keys.assign(ll=ll, k=list(k), qt=list(qt), c=list(c), d=np.full(f.b, np.nan) if d is None else d)


def scaled_by(values: Column, factor: Column | float) -> Column:
    return F.transform(values, lambda x: x * factor)


def with_starts(started: DataFrame) -> DataFrame:
    """Rows with their own start and those of ``OTHER_STARTS``, numbered in ``start``.

    Start shares that leave nothing to the baseline are out of reach of a fit and are scaled down.
    """
    k, qt = F.col("k"), F.col("qt")
    tried = [F.struct(k.alias("k"), qt.alias("qt"))]
    for factor, share in OTHER_STARTS:
        tried.append(F.struct(scaled_by(k, factor).alias("k"), F.transform(qt, lambda x: F.lit(share)).alias("qt")))
    rows = started.select("*", F.posexplode(F.array(*tried)).alias("start", "_from"))
    total = array_sum(F.col("_from.qt"))
    return rows.withColumns({
        "k": F.col("_from.k"),
        "qt": F.when(total > HIGHEST_START, scaled_by(F.col("_from.qt"), HIGHEST_START / total)).otherwise(F.col("_from.qt")),
    }).drop("_from")


def best_start(fits: DataFrame) -> DataFrame:
    """The likeliest fit of each series and grouping; of equal ones a converged one, then the first start."""
    values = [c for c in fits.columns if c not in ("series_id", "rgs", "start")]
    order = F.struct(F.round("ll", 6).alias("ll"), "converged", (-F.col("start")).alias("start"))
    return fits.groupBy("series_id", "rgs").agg(F.max_by(F.struct(*values), order).alias("b")).select("series_id", "rgs", "b.*")


def fit(started: DataFrame, options: Options) -> DataFrame:
    """Fit every row of ``started`` (see ``default_start`` and ``warm_start``) from several starts.

    The likelihood can have several maxima; the highest that a start leads to is returned. The starts
    are rows beside each other in one batch, and only their results are exchanged. Without a settled
    fit ``converged`` is false; where no start has a likelihood, ``ll`` is minus infinity.
    ``d`` is NaN without a concentration. Time scales cannot be told from wide bins: with them a bin
    of more than seven days ends the job.
    """
    if options.time_scale:
        started = started.withColumn("n_days", F.when(narrow_bins(F.col("d1"), F.col("d2")), F.col("n_days")))
    return best_start(fit_rows(with_starts(started.select("series_id", "rgs", "k", "qt", *ARRAYS)), options))


def same_as_before(rows: pd.DataFrame, *names: str) -> np.ndarray:
    """Numbers that rise where a row differs from the one before it."""
    keys = [pd.factorize(rows[name].map(tuple) if name == "rgs" else rows[name])[0] for name in names]
    changes = np.any([np.diff(k, prepend=k[:1]) != 0 for k in keys], axis=0)
    return np.cumsum(changes)


def fit_rows(rows: DataFrame, options: Options) -> DataFrame:
    """One fit per row and ``start``. Of starts that meet on their way, all but the likeliest end there, unsettled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, f in options.batches(batch):
                scale, d = np.full((f.b, f.s), START_SCALE), np.full(f.b, START_CONCENTRATION)
                # time scales far below a day change nothing: starts with other scales have not met
                problem = None if options.time_scale else same_as_before(rows, "series_id", "rgs")
                par, ll, ok = f.maximise(f.pack(stack(rows["k"]), stack(rows["qt"]), scale, d), problem=problem)
                yield result(rows[["series_id", "rgs", "start"]], f, par, ll).assign(converged=ok)

    return rows.mapInPandas(run, f"{FIT_SCHEMA}, start int")


def scored(fits: DataFrame, options: Options) -> DataFrame:
    return fits.withColumn("num_pars", options.num_pars()).withColumn("AIC", aic("ll", "num_pars"))


def interval_solutions(fits: DataFrame, series: DataFrame, options: Options,
                       joint: bool = False) -> DataFrame:
    """Whole parameter vectors at both ends of each parameter's interval.

    The cut is chi2(1)/2 below the maximum, or chi2(number of parameters)/2 for the joint region.
    Every end is a row of its own before the arrays are attached, so the ends of one fit run in
    different tasks.
    """
    free = F.array_max("rgs") + (F.size("rgs") - 1) * (2 if options.time_scale else 1)
    free = free + (1 if options.dirichlet else 0)
    ends = fits.select(
        "series_id", "rgs", F.col("ll").alias("ll_max"), "k", "qt", "c", "d",
        F.explode(F.sequence(F.lit(0), free - 1)).alias("param"),
    ).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    joined = attach_series(ends, lean(series))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, f in options.batches(batch):
                d = rows["d"].to_numpy(dtype=float)
                best = f.pack(stack(rows["k"]), stack(rows["qt"]), stack(rows["c"]), d)
                df = f.used.sum(axis=1) if joint else np.ones(f.b, dtype=int)
                drop = np.array([chi2_quantile(int(x)) / 2 for x in df])
                which = rows["param"].to_numpy()
                # a grouping with fewer blocks than the batch leaves rate slots unused
                which = which + np.where(which < f.block.max(axis=1), 0, f.k - f.block.max(axis=1))
                top = rows["ll_max"].to_numpy()
                par, ll = f.extreme(best, top, which, rows["side"].to_numpy(), top - drop)
                yield result(rows[["series_id", "rgs", "param", "side"]], f, par, ll)

    cols = ["series_id", "rgs", "param", "side", "ll_max", "k", "qt", "c", "d", *ARRAYS]
    return joined.select(*cols).mapInPandas(run, SOLUTION_SCHEMA)


def solution_ids(solutions: DataFrame) -> DataFrame:
    """Number the solutions of a fit, so that they work as candidates of other operators."""
    return solutions.withColumn(
        "candidate_id", (F.col("param") * 2 + (F.col("side") + 1) / 2).cast("bigint")
    )


def array_params(fits: DataFrame, series: DataFrame) -> DataFrame:
    """Fit rows to long ``(series_id, [candidate_id], variant, date, c, k, qt)`` of the subjects."""
    ids = [c for c in ("series_id", "candidate_id") if c in fits.columns]
    named = fits.join(series.select("series_id", "subjects", "intro", "t_start"), "series_id")
    cells = named.withColumn(
        "x", F.explode(F.arrays_zip("subjects", "intro", "c", "k", "qt",
                                    F.slice("rgs", F.lit(2), F.size("rgs") - 1).alias("block")))
    )
    return cells.select(
        *ids, F.col("x.subjects").alias("variant"), F.date_add("t_start", F.col("x.intro")).alias("date"),
        F.col("x.c").alias("c"), F.col("x.k").alias("k"), F.col("x.qt").alias("qt"),
        F.col("x.block").alias("block"),
    )


def fit_summary(fits: DataFrame, options: Options) -> DataFrame:
    return scored(fits, options).select(
        "series_id", rgs_key("rgs").alias("rgs"), F.col("ll").alias("maxll"), "num_pars", "AIC", "converged"
    )
