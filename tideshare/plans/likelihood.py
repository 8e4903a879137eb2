"""Log-likelihood of counts under a trajectory, and the grid search on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.gamma import chi2_quantile, chi2_quantile_column
from tideshare.functions.numbers import (
    array_sum,
    col,
    dirichlet_head,
    dirichlet_term,
    finite_ll,
    let,
    multinomial_term,
)
from tideshare.functions.partitions import to_rgs
from tideshare.operators.partitions import all_coarsenings
from tideshare.plans.series import materialise, narrow_bins, spread
from tideshare.plans.trajectory import with_trajectory


def bin_probabilities(traj: Column, b: Column) -> Column:
    """Mean daily shares over the days of one bin, floored at 0."""
    one_day = F.element_at(traj, b["d1"])
    days = F.slice(traj, b["d1"], b["d2"] - b["d1"] + 1)
    mean = let(
        days,
        lambda rows: F.transform(
            F.sequence(F.lit(1), F.size(b["n"])),
            lambda j: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.element_at(r, j)) / F.size(rows),
        ),
    )
    floored = lambda p: F.transform(p, lambda x: F.greatest(F.lit(0.0), x))
    return F.when(b["d1"] == b["d2"], floored(one_day)).otherwise(floored(mean))


def multinomial_ll(traj: Column | str, bins: Column | str, constant: Column | str | None = None) -> Column:
    """Sum over the bins inside the row: candidates are never blown up to cells."""

    def over_bins(t: Column) -> Column:
        def one_bin(acc: Column, b: Column) -> Column:
            terms = F.zip_with(bin_probabilities(t, b), b["n"], lambda p, n: multinomial_term(n, p))
            return acc + array_sum(terms)

        return F.aggregate(col(bins), F.lit(0.0), one_bin)

    ll = let(col(traj), over_bins)
    return finite_ll(ll if constant is None else ll + col(constant))


def dirichlet_ll(traj: Column | str, bins: Column | str, concentration: Column | str) -> Column:
    """Dirichlet-multinomial; categories of zero probability are left out with their counts."""
    d = col(concentration)

    def bin_ll(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + y["n"])
        alpha = array_sum(F.transform(x, lambda y: y["a"]))
        terms = array_sum(F.transform(x, lambda y: dirichlet_term(y["n"], y["a"])))
        head = let(total, lambda n: let(alpha, lambda a: dirichlet_head(n, a)))
        return F.when(total == 0, F.lit(0.0)).otherwise(head + terms)

    def over_bins(t: Column) -> Column:
        def one_bin(acc: Column, b: Column) -> Column:
            cells = F.filter(
                F.zip_with(bin_probabilities(t, b), b["n"],
                           lambda p, n: F.struct((p * d).alias("a"), n.alias("n"))),
                lambda x: x["a"] != 0,
            )
            return acc + let(cells, bin_ll)

        return F.aggregate(col(bins), F.lit(0.0), one_bin)

    return finite_ll(let(col(traj), over_bins))


def loglik(df: DataFrame, dirichlet: Column | str | None = None, constant: bool = True) -> DataFrame:
    """Add ``ll`` to rows with ``traj, bins, ln_coef``."""
    if dirichlet is not None:
        return df.withColumn("ll", dirichlet_ll("traj", "bins", dirichlet))
    return df.withColumn("ll", multinomial_ll("traj", "bins", "ln_coef" if constant else None))


def loglik_terms(bins_p: DataFrame, dirichlet: Column | None = None) -> DataFrame:
    """Relational form of ``loglik``: long ``(.., date_from, n, p)`` to ``ll`` per series and candidate.

    The multinomial comes without its constant; a count on a zero probability gives the worst
    value, while the Dirichlet form leaves such categories out.
    """
    ids = [c for c in ("series_id", "candidate_id") if c in bins_p.columns]
    if dirichlet is None:
        term = multinomial_term("n", "p")
        sums = bins_p.groupBy(*ids).agg(F.sum(term).alias("ll"), F.count_if(term.isNull()).alias("bad"))
        return sums.select(*ids, finite_ll(F.when(F.col("bad") == 0, F.col("ll"))).alias("ll"))
    cells = positive_prob(bins_p).withColumn("a", F.col("p") * dirichlet)
    per_bin = cells.groupBy(*ids, "date_from").agg(
        F.sum("n").alias("total"), F.sum("a").alias("alpha"), F.sum(dirichlet_term("n", "a")).alias("terms"))
    ll = F.when(F.col("total") > 0, dirichlet_head("total", "alpha") + F.col("terms")).otherwise(F.lit(0.0))
    return per_bin.groupBy(*ids).agg(finite_ll(F.sum(ll)).alias("ll"))


def positive_prob(bins_p: DataFrame) -> DataFrame:
    """Only categories with a probability."""
    return bins_p.filter(F.col("p") != 0)


def rate_grid(series: DataFrame, rates: list[float], ratios: list[float] | None = None) -> DataFrame:
    """Every combination of ``rates`` over the subjects of each series as ``candidate_id, k``.

    With ``ratios`` every subject has one of them besides its rate, in ``c``.

    The points are digits of a number, so they are generated from the series row in place: no
    join with a candidate table. About the root of their number of pieces is spread first and each
    holds as many points, so one series does not stay in one task and no row holds a long array.
    """
    base = len(rates) * len(ratios or [1.0])
    size = F.pow(F.lit(base), F.size("subjects")).cast("bigint")
    values = F.array(*[F.lit(float(r)) for r in rates])
    count = F.ceil(F.sqrt("_size")).cast("bigint")
    sized = series.withColumn("_size", size).withColumn("_count", count)
    pieces = spread(
        sized.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_count") - 1))),
        "series_id",
        "_piece",
    )
    # piece i holds i, i + count, ..; a piece beyond the last point is empty
    numbers = F.when(F.col("_piece") < F.col("_size"), F.sequence("_piece", F.col("_size") - 1, "_count"))
    points = pieces.withColumn("candidate_id", F.explode(numbers)).drop("_size", "_count", "_piece")
    subject = F.sequence(F.lit(1), F.size("subjects"))
    digit = lambda j: (
        F.floor(F.col("candidate_id") / F.pow(F.lit(base), F.size("subjects") - j)) % base
    )
    if ratios is None:
        return points.withColumn("k", F.transform(subject, lambda j: F.element_at(values, (digit(j) + 1).cast("int"))))
    scales = F.array(*[F.lit(float(c)) for c in ratios])
    return points.withColumns({
        "k": F.transform(subject, lambda j: F.element_at(values, (F.floor(digit(j) / len(ratios)) + 1).cast("int"))),
        "c": F.transform(subject, lambda j: F.element_at(scales, (digit(j) % len(ratios) + 1).cast("int")))})


def grid_scores(series: DataFrame, rates: list[float], alpha: float, theta: float, constant: bool = False,
                division: int = 1, time_scales: list[float] | None = None,
                concentrations: list[float] | None = None, each: bool = False) -> DataFrame:
    """``ll`` of every grid point. ``series`` carries the start shares in ``qt``.

    ``division`` is the number of steps a day. With ``time_scales`` every point is tried with each
    of these ratios, which all subjects share, or, with ``each``, with every combination of a ratio per
    subject; ``candidate_id`` numbers them and bins of more than seven days end the job. With ``concentrations`` the likelihood is the Dirichlet-multinomial
    one and ``d`` the best of them; the trajectory of a point is folded once for all.
    """
    points, more = rate_grid(series, rates, time_scales if each else None), []
    first, last = F.transform("bins", lambda x: x["d1"]), F.transform("bins", lambda x: x["d2"])
    if each:
        more.append("c")
        points = points.withColumn("c", F.when(narrow_bins(first, last), F.col("c")))
    elif time_scales is not None:
        more.append("c")
        places = F.posexplode(F.array(*[F.lit(float(x)) for x in time_scales])).alias("_place", "_ratio")
        points = points.select("*", places).withColumns({
            "candidate_id": F.col("candidate_id") * len(time_scales) + F.col("_place"),
            "c": F.when(narrow_bins(first, last), F.transform("subjects", lambda v: F.col("_ratio"))),
        })
    rows = with_trajectory(points, alpha, theta, division=division, time_scale=time_scales is not None)
    if concentrations is None:
        scored = loglik(rows, constant=constant)
    else:
        more.append("d")
        tried = [F.struct(dirichlet_ll("traj", "bins", F.lit(float(d))).alias("ll"), F.lit(float(d)).alias("d"))
                 for d in concentrations]
        best = rows.withColumn("_best", F.array_max(F.array(*tried)))
        scored = best.withColumns({"ll": F.col("_best.ll"), "d": F.col("_best.d")})
    return scored.select("series_id", "candidate_id", "subjects", "baseline", "k", "qt", "ll", *more)


def likelihood_region(scores: DataFrame, df: int | None = None) -> DataFrame:
    """Points within chi2(df)/2 of the best one of their series.

    Without ``df`` it is two per subject of the series (rate and start share): the joint region.
    The scores are used twice, so they are written to the checkpoint folder first; they hold
    parameters and likelihoods only.
    """
    scores = materialise(scores)
    top = scores.groupBy("series_id").agg(F.max("ll").alias("top"), F.first(F.size("subjects")).alias("subjects"))
    half = F.lit(chi2_quantile(df)) if df is not None else chi2_quantile_column(2 * F.col("subjects"))
    cuts = top.select("series_id", (F.col("top") - half / 2).alias("cut"))
    return scores.join(cuts, "series_id").filter(F.col("ll") >= F.col("cut")).drop("cut")


def extreme_points(region: DataFrame) -> DataFrame:
    """``(series_id, candidate_id, k)``: the best point of each series, and per subject those of its
    lowest and highest rate inside the region.

    Of equal rates the point of higher likelihood counts, then the lower number. A point that is
    extreme in several ways comes once. Two aggregates with map-side combine, no sort of points.
    """
    point = F.struct("candidate_id", "k")
    cells = region.select("series_id", "candidate_id", "k", "ll", F.posexplode("k").alias("place", "rate"))

    def nearest(rate: Column) -> Column:
        return F.min_by(point, F.struct(rate.alias("rate"), (-F.col("ll")).alias("loss"), F.col("candidate_id")))

    ends = cells.groupBy("series_id", "place").agg(F.array(nearest(F.col("rate")), nearest(-F.col("rate"))).alias("ends"))
    found = ends.select("series_id", F.explode("ends").alias("p")).select("series_id", "p.candidate_id", "p.k")
    return found.unionByName(best_point(region).select("series_id", "candidate_id", "k")).distinct()


def best_point(scores: DataFrame) -> DataFrame:
    """Point of highest log-likelihood per series, lowest number on ties."""
    cols = [c for c in scores.columns if c != "series_id"]
    return scores.groupBy("series_id").agg(
        F.max_by(F.struct(*cols), F.struct(F.col("ll"), -F.col("candidate_id"))).alias("b")
    ).select("series_id", "b.*")


def within_grouping(scores: DataFrame, groupings: DataFrame) -> DataFrame:
    """Grid points that respect the grouping ``(series_id, rgs)`` of their series.

    All categories of a block have the rate of its first one, those with the baseline rate 1.
    ``groupings`` holds one row per series.
    """
    rates = F.concat(F.array(F.lit(1.0)), F.col("k"))
    pairs = F.arrays_zip(F.col("rgs").alias("b"), rates.alias("x"))
    same = F.forall(pairs, lambda p: p["x"] == F.element_at(rates, F.array_position("rgs", p["b"]).cast("int")))
    return scores.join(groupings.select("series_id", "rgs"), "series_id").filter(same).drop("rgs")


def point_partition_scores(scores: DataFrame) -> DataFrame:
    """Highest ``ll`` per equality pattern of the rates (baseline rate 1 first)."""
    pattern = to_rgs(F.concat(F.array(F.lit(1.0)), F.col("k")))
    return scores.groupBy("series_id", pattern.alias("pattern")).agg(F.max("ll").alias("ll"))


def score_on_grid(candidates: DataFrame, patterns: DataFrame, max_blocks: int) -> DataFrame:
    """``ll`` of a grouping = best grid point whose equal rates include the grouping.

    Such points are those whose pattern coarsens the grouping, so the coarsenings of each
    candidate meet the patterns in an equi join; grid points are already reduced to patterns.
    """
    keys = [c for c in candidates.columns]
    wider = all_coarsenings(candidates, max_blocks, out="pattern")
    return wider.join(patterns, ["series_id", "pattern"]).groupBy(*keys).agg(F.max("ll").alias("ll"))


def start_share_arrays(series: DataFrame, shares: DataFrame) -> DataFrame:
    """Attach start shares ``(series_id, variant, qt)`` as an array in subject order.

    The result is spread over tasks, ready for the fold.
    """
    packed = shares.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("variant", "qt"))).alias("m")
    )
    return spread(series.join(packed, "series_id").withColumn(
        "qt", F.transform("subjects", lambda v: F.element_at(F.col("m"), v))
    ).drop("m"))
