import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import coarser, partitions
from test_model import ALPHA, OPTIONS, THETA, counts_of, expected_counts
from tideshare.functions.partitions import rgs_digest
from tideshare.operators.partitions import enumerate_partitions, with_level
from tideshare.plans import fit as ft
from tideshare.plans import likelihood as lk
from tideshare.plans import search as se
from tideshare.plans import series as ss

RATES = [0.95, 1.0, 1.05]


@pytest.fixture(scope="module")
def planted(spark):
    """a and c grow alike, b and d like the baseline."""
    table = expected_counts([1.05, 1.0, 1.05, 1.0], [0.1, 0.2, 0.1, 0.2], total=300, days=30)
    counts = counts_of(spark, table)
    other = counts_of(spark, np.roll(table, 1, axis=1), series="t")
    return ss.series_arrays(counts.unionByName(other), "base", undetected=True).persist()


def finest(series):
    return ft.finest_candidates(series)


def test_search_finds_the_planted_grouping(spark, planted):
    one = planted.filter("series_id = 's'")
    start = ft.array_params(ft.fit(ft.finest_start(one), OPTIONS), one)
    scores, pruned = se.search_partitions(finest(one), se.fit_scorer(one, OPTIONS, start), 1)
    best = se.ledger(scores).first()
    assert best.rgs == "0-1-0-1-0"
    assert scores.filter("level = 1").count() == 1 and scores.filter("level = 2").count() == 10
    # whatever was pruned cannot win through any of its coarsenings
    bad = [tuple(r.rgs) for r in pruned.collect()]
    seen = {tuple(r.rgs): r.AIC for r in scores.collect()}
    assert all(seen[x] >= best.AIC - 1e-6 for p in bad for x in seen if coarser(x, p))


def test_wide_search_equals_exhaustive_scoring(spark, planted):
    grid = planted.withColumn("qt", F.array(*[F.lit(x) for x in (0.1, 0.2, 0.1, 0.2)]))
    patterns = ss.materialise(lk.point_partition_scores(lk.grid_scores(grid, RATES, ALPHA, THETA)))
    scorer = se.grid_scorer(patterns, 5)
    every = enumerate_partitions(finest(planted).select("series_id", F.size("rgs").alias("n")), "n", 5).drop("n")
    full = {(r.series_id, tuple(r.rgs)): r for r in with_level(scorer(every)).collect()}
    assert len(full) == 2 * 52
    scores, pruned = se.search_partitions(finest(planted), scorer, 100)
    got = {(r.series_id, tuple(r.rgs)): r for r in scores.collect()}
    for key, row in got.items():
        assert row.AIC == pytest.approx(full[key].AIC) and row.level == full[key].level
    bad = {}
    for r in pruned.collect():
        bad.setdefault(r.series_id, []).append(tuple(r.rgs))
    for (series, rgs), row in full.items():
        if (series, rgs) not in got:
            assert any(coarser(rgs, p) for p in bad[series])
    for series in ("s", "t"):
        low = min(r.AIC for (s, _), r in full.items() if s == series)
        assert min(r.AIC for (s, _), r in got.items() if s == series) == pytest.approx(low)


def test_grid_scores_of_groupings(spark, planted):
    """A grouping scores the best point whose equal rates include it."""
    grid = planted.filter("series_id = 's'").withColumn("qt", F.array(*[F.lit(x) for x in (0.1, 0.2, 0.1, 0.2)]))
    points = lk.grid_scores(grid, RATES, ALPHA, THETA).collect()
    assert len(points) == 81 and len({tuple(p.k) for p in points}) == 81
    cand = spark.createDataFrame([("s", list(x)) for x in partitions(5)], "series_id string, rgs array<int>")
    patterns = lk.point_partition_scores(lk.grid_scores(grid, RATES, ALPHA, THETA))
    for r in lk.score_on_grid(cand, patterns, 5).collect():
        fits = [p.ll for p in points if coarser([1.0, *p.k], r.rgs)]
        assert r.ll == pytest.approx(max(fits))


def test_stored_scores_are_reused(spark, planted):
    one = planted.filter("series_id = 's'")
    cand = spark.createDataFrame([("s", [0, 1, 2, 3, 4]), ("s", [0, 1, 1, 2, 3])], "series_id string, rgs array<int>")
    stored = cand.limit(1).select("series_id", F.lit("h").alias("config_hash"), rgs_digest("rgs").alias("sha1"),
                                  F.lit(-1.0).alias("ll"), F.lit(8).cast("bigint").alias("num_pars"), F.lit(18.0).alias("AIC"))
    out = se.score_candidates(cand, se.fit_scorer(one, OPTIONS), stored, "h").collect()
    assert len(out) == 2 and sum(r.ll == -1.0 for r in out) == 1
    other = se.score_candidates(cand, se.fit_scorer(one, OPTIONS), stored, "other").collect()
    assert len(other) == 2 and not any(r.ll == -1.0 for r in other)


def test_checkpoints_use_the_named_folder(spark):
    ss.ensure_checkpoint_dir(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert named.rstrip("/") in spark.sparkContext.getCheckpointDir()


def test_candidates_of_one_series_use_many_tasks(spark, planted):
    many = spark.createDataFrame([("s", list(x)) for x in partitions(5)], "series_id string, rgs array<int>")
    tasks = ss.attach_series(many, planted.select("series_id", "intro")).select(F.spark_partition_id().alias("p"))
    assert tasks.distinct().count() > 1


def test_unsettled_fit_prunes_nothing(spark):
    scores = spark.createDataFrame(
        [("s", [0, 1, 2], 900.0, True), ("s", [0, 1, 1], 900.0, False), ("s", [0, 0, 1], 900.0, None)],
        "series_id string, rgs array<int>, AIC double, converged boolean")
    best = spark.createDataFrame([("s", 100.0)], "series_id string, best_AIC double")
    flagged = se.flag(scores, best)
    assert {tuple(r.rgs) for r in se.prune(flagged).collect()} == {(0, 1, 2), (0, 0, 1)}
    assert se.prune(se.flag(scores.drop("converged"), best)).count() == 3


def test_a_search_reads_the_ledger_of_another(spark, planted):
    one = planted.filter("series_id = 's'")
    scorer = se.fit_scorer(one, OPTIONS)
    earlier, _ = se.search_partitions(finest(one), scorer, 1)
    asked = []

    def counting(candidates):
        asked.append(candidates.count())
        return scorer(candidates)

    stored = se.ledger(earlier).withColumn("config_hash", F.lit("h"))
    again, _ = se.search_partitions(finest(one), counting, 1, stored=stored, config_hash="h")
    assert asked and sum(asked) == 0
    assert sorted((r.rgs, r.ll) for r in se.ledger(again).collect()) == sorted((r.rgs, r.ll) for r in stored.collect())


def test_fingerprints_follow_counts_and_options(spark):
    table = expected_counts([1.05], [0.2], total=300, days=10)
    counts = counts_of(spark, table)

    def key(c, *options):
        return se.fingerprints(c, *options).first().config_hash

    plain = key(counts, "fit", 1.0)
    assert plain == key(counts.repartition(5), "fit", 1.0) and len(plain) == 40
    table[3][0] += 1
    assert len({plain, key(counts_of(spark, table), "fit", 1.0), key(counts, "fit", 2.0), key(counts.limit(5), "fit", 1.0)}) == 4
    both = counts.unionByName(counts_of(spark, table, series="t"))
    assert {r.series_id: r.config_hash for r in se.fingerprints(both, "fit", 1.0).collect()}["s"] == plain


def test_a_rerun_adds_nothing_to_the_ledger(spark, planted):
    one = planted.filter("series_id = 's'")
    keys = spark.createDataFrame([("s", "k1")], "series_id string, config_hash string")
    scorer = se.fit_scorer(one, OPTIONS)
    earlier, _ = se.search_partitions(finest(one), scorer, 1)
    first = se.new_scores(earlier, None, keys)
    again, _ = se.search_partitions(finest(one), scorer, 1, stored=first, config_hash=keys)
    assert se.new_scores(again, first, keys).count() == 0 < first.count()
    assert first.count() == first.select("series_id", "sha1").distinct().count()
    other = keys.withColumn("config_hash", F.lit("k2"))
    assert se.new_scores(again, first, other).count() == first.count()
