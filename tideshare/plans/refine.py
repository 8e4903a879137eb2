"""Continuous fits and interval ends in the JVM, as rounds over a table of fits (see ``plans.scoring``).

One row is one fit: (series, grouping, start), or (series, grouping, parameter, side) for an interval
end. Rows are dealt to tasks by these keys. The results have the form of those of ``plans.fit``, so that the
reports take either. A trajectory costs about a millisecond here: this is the way for a few hundred fits;
for thousands of small ones the batches of ``plans.fit`` are faster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.gamma import chi2_quantile, chi2_quantile_column
from tideshare.functions.numbers import array_sum, let
from tideshare.plans import scoring
from tideshare.plans.fit import HIGHEST_START, Options, best_start
from tideshare.plans.series import attach_series, narrow_bins, spread

# Start values.
START_SCALE, START_CONCENTRATION = 1.0, 10.0

#: Start rates of a regression lie within these.
START_RATES = (0.2, 5.0)
ARRAYS = ["intro", "n_days", "bins", "ln_coef"]


def model_of(options: Options) -> scoring.Model:
    """The model of a row with ``rgs`` and the arrays of its series."""
    return scoring.Model(options, subject_blocks(), F.col("intro"), F.col("n_days"), F.col("bins"))


def constant_part(options: Options) -> Column:
    """What the likelihood of the rounds lacks: the Dirichlet form is whole."""
    return F.lit(0.0) if options.dirichlet else F.col("ln_coef")


def subject_blocks() -> Column:
    return F.slice("rgs", F.lit(2), F.size("rgs") - 1)


def mean_of_block(k: Column) -> Column:
    """Per subject the mean value of the subjects of its block."""
    def of(pairs: Column) -> Column:
        def mean_rate(b: Column) -> Column:
            same = F.transform(F.filter(pairs, lambda x: x["b"] == b), lambda x: x["k"])
            return let(same, lambda v: array_sum(v) / F.size(v))

        return F.transform(subject_blocks(), mean_rate)

    return let(F.arrays_zip(subject_blocks().alias("b"), k.alias("k")), of)


def regression_start(options: Options) -> Column:
    """Struct ``k, qt`` from a weighted line through the log odds of each subject against the baseline.

    The slope gives the rate, the value on the day of entry the start share. One subject at a time, so
    the cost grows with the number of cells.
    """
    mean_lag = sum((m + 1) * w for m, w in enumerate(options.weights))

    def line(j: Column, intro: Column) -> Column:
        def point(b: Column) -> Column:
            n, base = F.element_at(b["n"], j) + 0.5, F.element_at(b["n"], -1) + 0.5
            w = 1.0 / (1.0 / n + 1.0 / base)
            return F.struct(w.alias("w"), ((b["d1"] + b["d2"]) / 2.0 - 1.0).alias("t"), F.ln(n / base).alias("y"))

        points = F.transform(F.filter("bins", lambda b: b["d1"] > intro), point)

        def fitted(p: Column) -> Column:
            total = lambda f: array_sum(F.transform(p, f))
            sums = F.struct(
                total(lambda v: v["w"]).alias("w"), total(lambda v: v["w"] * v["t"]).alias("t"),
                total(lambda v: v["w"] * v["y"]).alias("y"), total(lambda v: v["w"] * v["t"] * v["t"]).alias("tt"),
                total(lambda v: v["w"] * v["t"] * v["y"]).alias("ty"))

            def coefficients(s: Column) -> Column:
                spread_ = s["w"] * s["tt"] - s["t"] * s["t"]
                slope = F.when(spread_ > 1e-9 * s["w"] * s["w"], (s["w"] * s["ty"] - s["t"] * s["y"]) / spread_).otherwise(F.lit(0.0))
                return let(slope, lambda m: F.struct(
                    m.alias("slope"), F.when(s["w"] > 0, (s["y"] - m * s["t"]) / s["w"]).otherwise(F.lit(-7.0)).alias("level"),
                    intro.alias("intro")))

            return let(sums, coefficients)

        return let(points, fitted)

    def values(lines: Column) -> Column:
        low, high = START_RATES
        k = F.transform(lines, lambda v: F.least(F.lit(high), F.greatest(F.lit(low), F.exp(F.least(v["slope"] * mean_lag, F.lit(5.0))))))

        def share(v: Column) -> Column:
            odds = F.transform(F.filter(lines, lambda u: u["intro"] <= v["intro"]),
                               lambda u: F.exp(F.least(u["level"] + u["slope"] * v["intro"], F.lit(30.0))))
            own = F.exp(F.least(v["level"] + v["slope"] * v["intro"], F.lit(30.0)))
            return own / (1.0 + array_sum(odds))

        return F.struct(mean_of_block(k).alias("k"), F.transform(lines, share).alias("qt"))

    lines = F.zip_with(F.sequence(F.lit(1), F.size("intro")), F.col("intro"), line)
    return let(lines, values)


def with_starts(candidates: DataFrame, options: Options) -> DataFrame:
    """Rows ``(series_id, rgs, arrays)`` with two starts ``k, qt``: a regression (0), and its shares with constant rates (1).

    Start shares that leave nothing to the baseline are out of reach of a fit and are scaled down.
    """
    line = lambda r: F.struct(r["k"].alias("k"), r["qt"].alias("qt"), F.lit(0).alias("start"))
    still = lambda r: F.struct(F.transform(r["k"], lambda x: F.lit(1.0)).alias("k"), r["qt"].alias("qt"), F.lit(1).alias("start"))
    tried = candidates.withColumn("_tried", let(regression_start(options), lambda r: F.array(line(r), still(r))))
    rows = tried.select("series_id", "rgs", *ARRAYS, F.explode("_tried").alias("_from"))
    total = array_sum(F.col("_from.qt"))
    return rows.withColumns({
        "start": F.col("_from.start"),
        "k": F.col("_from.k"),
        "qt": F.when(total > HIGHEST_START, F.transform(F.col("_from.qt"), lambda x: x * HIGHEST_START / total)).otherwise(F.col("_from.qt")),
    }).drop("_from")


def finest(series: DataFrame) -> DataFrame:
    """The finest grouping of each series with its arrays."""
    return series.select("series_id", *ARRAYS, F.sequence(F.lit(0), F.size("subjects")).alias("rgs"))


def fit(candidates: DataFrame, options: Options) -> DataFrame:
    """Fit rows with ``series_id, rgs`` and the arrays of their series (see ``finest``); results as in ``plans.fit``.

    The likelihood can have several maxima; the higher one that the two starts lead to is returned. Without
    a settled fit ``converged`` is false; where no start has a likelihood, ``ll`` is minus infinity. ``d`` is NaN
    without a concentration. Time scales cannot be told from wide bins: with them a bin of more than
    seven days ends the job.
    """
    if options.time_scale:
        first, last = F.transform("bins", lambda b: b["d1"]), F.transform("bins", lambda b: b["d2"])
        candidates = candidates.withColumn("n_days", F.when(narrow_bins(first, last), F.col("n_days")))
    return best_start(fit_rows(spread(with_starts(candidates, options), "series_id", "rgs", "start"), options))


def result(keys: list[str], rows: DataFrame, options: Options) -> DataFrame:
    """Rows of ``keys`` with likelihood and parameters of their ``x, ll, ok``."""
    values = model_of(options).unpack(F.col("x"))
    ll = F.coalesce(F.col("ll") + constant_part(options), F.lit(float("-inf")))
    return rows.withColumns({"_u": values, "_ll": ll}).select(
        *keys, F.col("_ll").alias("ll"), *[F.col(f"_u.{n}").alias(n) for n in ("k", "qt", "c", "d")], F.col("ok").alias("converged"))


def fit_rows(rows: DataFrame, options: Options) -> DataFrame:
    """One fit per row and ``start``, from this start only."""
    model = model_of(options)
    start = model.pack(F.col("k"), F.col("qt"), F.transform("qt", lambda x: F.lit(START_SCALE)), F.lit(START_CONCENTRATION))
    done = scoring.maximise(rows.select("series_id", "rgs", "start", *ARRAYS, start.alias("_start")), model, F.col("_start"))
    return result(["series_id", "rgs", "start"], done, options)


def interval_solutions(fits: DataFrame, series: DataFrame, options: Options, joint: bool = False) -> DataFrame:
    """Whole parameter vectors at both ends of each parameter's interval.

    The cut is chi2(1)/2 below the maximum, or chi2(number of parameters)/2 for the joint region.
    Every end is a row of its own before the arrays are attached, so the ends of one fit run in
    different tasks. The few that do not settle by steps are bracketed afterwards. ``converged``
    tells whether the end has settled.
    """
    free = options.num_pars()
    half = (chi2_quantile_column(free) if joint else F.lit(chi2_quantile(1))) / 2
    sized = fits.withColumns({"drop": half, "free": free.cast("int")}).filter("free > 0")
    ends = sized.select(
        "series_id", "rgs", F.col("ll").alias("ll_max"), "drop", "k", "qt", "c", "d",
        F.explode(F.sequence(F.lit(0), F.col("free") - 1)).alias("param"),
    ).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    model = model_of(options)
    keys = ["series_id", "rgs", "param", "side"]
    arrays = series.select("series_id", *ARRAYS)
    rows = attach_series(ends, arrays).select(
        *keys, *ARRAYS, (F.col("param") + 1).alias("place"),
        model.pack(F.col("k"), F.col("qt"), F.col("c"), F.col("d")).alias("best"),
        (F.col("ll_max") - constant_part(options)).alias("top"),
        (F.col("ll_max") - constant_part(options) - F.col("drop")).alias("cut"))
    quick = scoring.extreme(rows, model)
    left = quick.filter("not ok")
    done = result(keys, quick.filter("ok"), options)
    if left.isEmpty():
        return done
    slow = scoring.bracketed(left.select(*rows.columns), model)
    return done.unionByName(result(keys, slow, options))
