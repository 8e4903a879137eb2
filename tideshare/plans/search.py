"""Level-wise search for the grouping of categories with the lowest AIC."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.functions.numbers import aic, coarsening_bound, num_parameters
from tideshare.functions.partitions import block_count, rgs_digest, rgs_key
from tideshare.operators.partitions import surviving_children
from tideshare.operators.ranking import beam, rank_scores
from tideshare.plans.fit import Options, fit, fixed_start, named_start, scored, warm_start
from tideshare.plans.likelihood import score_on_grid
from tideshare.plans.series import materialise

# Fixed value: a bound must beat the best AIC by this much, since fits are not exact.
PRUNE_MARGIN = 1e-6
SCORE_COLUMNS = ["series_id", "rgs", "ll", "num_pars", "AIC"]

Scorer = Callable[[DataFrame], DataFrame]


def grid_scorer(patterns: DataFrame, max_blocks: int) -> Scorer:
    """Score by the best grid point that fits the grouping (start shares are fixed)."""

    def score(candidates: DataFrame) -> DataFrame:
        return with_aic(score_on_grid(candidates, patterns, max_blocks))

    return score


def fit_scorer(series: DataFrame, options: Options, estimates: DataFrame | None = None) -> Scorer:
    """Score by a continuous fit, one row per candidate, with the flag ``converged``.

    ``estimates`` ``(series_id, variant, k, qt)`` of an earlier fit give the start values.
    """
    started = materialise(fixed_start(series) if estimates is None else named_start(series, estimates))

    def score(candidates: DataFrame) -> DataFrame:
        rows = warm_start(candidates, started)
        return scored(fit(rows, options), options).select(*SCORE_COLUMNS, "converged")

    return score


def with_aic(df: DataFrame) -> DataFrame:
    pars = num_parameters(block_count("rgs"), F.size("rgs") - 1)
    return df.withColumn("num_pars", pars).withColumn("AIC", aic("ll", "num_pars")).select(*SCORE_COLUMNS)


def score_candidates(candidates: DataFrame, scorer: Scorer, stored: DataFrame | None = None,
                     config_hash: str | DataFrame = "") -> DataFrame:
    """Score candidates ``(series_id, rgs)``; those in ``stored`` are read instead.

    ``stored`` is ``(series_id, config_hash, sha1, ll, num_pars, AIC[, converged])``, a ledger for
    example; ``config_hash`` names the data and options, as a word or by series (see ``fingerprints``), so that
    scores of another run are not taken for this one.
    """
    if stored is None:
        return scorer(candidates)
    named = candidates.withColumn("config_hash", F.lit(config_hash)) if isinstance(config_hash, str) else candidates.join(config_hash, "series_id")
    keyed = named.withColumn("sha1", rgs_digest("rgs"))
    keys = ["series_id", "config_hash", "sha1"]
    flags = [c for c in ("converged",) if c in stored.columns]
    known = keyed.join(stored.select(*keys, "ll", "num_pars", "AIC", *flags), keys).select(*SCORE_COLUMNS, *flags)
    todo = pending(keyed, stored).select("series_id", "rgs")
    return scorer(todo).unionByName(known, allowMissingColumns=True)


def fingerprints(counts: DataFrame, *options: object) -> DataFrame:
    """``(series_id, config_hash)``: a key of the counts of a series and the options of a run.

    The digest sums hashes of the cells, so it depends on every cell and on no order; two sums of 64 bits
    and the number of cells make it up. Other counts or options give another key.
    """
    named = F.lit("|".join(map(repr, options)))

    def part(seed: int) -> Column:
        bits = F.xxhash64(F.lit(seed), "date_from", "date_till", "variant", "n")
        return F.sum(bits.cast("decimal(20)"))

    sums = counts.groupBy("series_id").agg(part(1).alias("a"), part(2).alias("b"), F.count(F.lit(1)).alias("cells"))
    return sums.select("series_id", F.sha1(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"), "cells", named)).alias("config_hash"))


def new_scores(scores: DataFrame, stored: DataFrame | None, keys: DataFrame) -> DataFrame:
    """Rows of a ledger that ``stored`` lacks, with the key of their series: what a rerun has to add."""
    rows = ledger(scores).join(keys, "series_id")
    return rows if stored is None else pending(rows, stored)


def pending(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates without a stored score."""
    keys = ["series_id", "config_hash", "sha1"]
    return candidates.join(stored.select(*keys), keys, "left_anti")


def flag(scores: DataFrame, best: DataFrame) -> DataFrame:
    """Add the bound and whether any coarsening can still win against ``best_AIC``.

    A fit that has not converged may score too low, so its bound rules nothing out.
    """
    unsettled = ~F.coalesce("converged", F.lit(True)) if "converged" in scores.columns else F.lit(False)
    bound = coarsening_bound("AIC", block_count("rgs"))
    return (
        scores.join(best, "series_id")
        .withColumn("lb_agg_AIC", bound)
        .withColumn("has_chance", unsettled | ~(F.col("lb_agg_AIC") > F.col("best_AIC") + PRUNE_MARGIN))
    )


def prune(flagged: DataFrame) -> DataFrame:
    """Groupings none of whose coarsenings can win."""
    return flagged.filter(~F.col("has_chance")).select("series_id", "rgs")


def search_partitions(finest: DataFrame, scorer: Scorer, width: int = 1, max_levels: int | None = None,
                      stored: DataFrame | None = None, config_hash: str | DataFrame = "") -> tuple[DataFrame, DataFrame]:
    """All scored groupings ``(series_id, level, rgs, ll, num_pars, AIC, lb_agg_AIC, has_chance)``
    and the pruned ones ``(series_id, rgs)``.

    The driver only steps through the levels; all series advance together and every level is one
    distributed job. The levels are cut from the lineage by reliable checkpoints, which survive
    the loss of executors. The lowest AIC counts all earlier levels and the whole current one.
    """

    def scores_of(candidates: DataFrame) -> DataFrame:
        return materialise(score_candidates(candidates, scorer, stored, config_hash))

    first = scores_of(finest.select("series_id", "rgs"))
    flagged = flag(first, first.select("series_id", F.col("AIC").alias("best_AIC"))).withColumns(
        {"has_chance": F.lit(True), "level": F.lit(1).cast("bigint")})
    levels, survivors = [flagged], flagged
    while max_levels is None or len(levels) < max_levels:
        scores = scores_of(surviving_children(survivors, union([prune(f) for f in levels])))
        if scores.isEmpty():
            break
        earlier = levels[-1].groupBy("series_id").agg(F.min("best_AIC").alias("earlier"))
        best = (
            scores.groupBy("series_id").agg(F.min("AIC").alias("now"))
            .join(earlier, "series_id")
            .select("series_id", F.least("now", "earlier").alias("best_AIC"))
        )
        level = F.lit(len(levels) + 1).cast("bigint")
        levels.append(materialise(flag(scores, best).withColumn("level", level)))
        survivors = beam(levels[-1].filter("has_chance"), width)
    flags = [c for c in ("converged",) if c in first.columns]
    columns = ["series_id", "level", *SCORE_COLUMNS[1:], "lb_agg_AIC", "has_chance", *flags]
    return union(levels).select(*columns), union([prune(f) for f in levels])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ledger(scores: DataFrame) -> DataFrame:
    """Report form: label strings and digests, lowest AIC first."""
    return rank_scores(scores).select(
        "series_id", "level", rgs_key("rgs").alias("rgs"), rgs_digest("rgs").alias("sha1"),
        "ll", "num_pars", "AIC", "lb_agg_AIC", "has_chance",
        *[c for c in ("converged",) if c in scores.columns],
    )
