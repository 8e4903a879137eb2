"""Fits and interval ends by rounds in the JVM, against plain loops and against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from test_model import ALPHA, THETA, VARIANTS, W, counts_of, expected_counts
from tideshare.functions import linear
from tideshare.functions.gamma import chi2_quantile, chi2_quantile_column
from tideshare.functions.numbers import digamma
from tideshare.plans import fit as ft
from tideshare.plans import likelihood as lk
from tideshare.plans import refine as rf
from tideshare.plans import reports as rp
from tideshare.plans import scoring as sc
from tideshare.plans import series as ss
from tideshare.plans import trajectory as tr

OPTIONS = ft.Options(ALPHA, THETA)


def drawn(k, qt, days, total, seed, intro=None):
    q = brute.shares(k, qt, intro or [0] * len(k), days, [W] * (len(k) + 1))
    rnd = np.random.default_rng(seed)
    return np.array([rnd.multinomial(total, p) for p in q])


@pytest.fixture(scope="module")
def two(spark):
    """Two subjects, one of which enters on the fifth day; the fit and its series."""
    table = drawn([1.15, 0.92], [0.2, 0.15], 16, 150, 3, [0, 4])
    series = ss.series_arrays(counts_of(spark, table), "base").persist()
    return table, series, ss.materialise(rf.fit(rf.finest(series), OPTIONS))


def loglik(table, k, qt, intro):
    q = brute.shares(list(k), list(qt), intro, len(table), [W] * (len(k) + 1))
    return sum(brute.multinomial(n.tolist(), x) for n, x in zip(table, q, strict=True))


def test_agrees_with_the_batch_fits(spark):
    tables = [(drawn([1.1, 0.9, 1.0][:s], [0.2, 0.1, 0.1][:s], days, 60, i), f"s{i}", width)
              for i, (days, s, width) in enumerate([(20, 1, 1), (28, 2, 7), (25, 3, 1), (21, 3, 3)])]
    counts = [counts_of(spark, t, width, name) for t, name, width in tables]
    together = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    series = ss.series_arrays(together, "base", undetected=True)
    got = {r.series_id: r for r in rf.fit(rf.finest(series), OPTIONS).collect()}
    want = {r.series_id: r for r in ft.fit(ft.finest_start(series), OPTIONS).collect()}
    assert set(got) == set(want) == {"s0", "s1", "s2", "s3"}
    for name, r in got.items():
        assert r.converged and r.ll == pytest.approx(want[name].ll, abs=1e-6)
        assert list(r.k) == pytest.approx(list(want[name].k), abs=1e-4)
        assert list(r.qt) == pytest.approx(list(want[name].qt), rel=1e-3)


def test_no_point_around_is_better(two):
    """No grid point around beats the result by 1e-4, and the likelihood is that of plain loops."""
    table, _, fits = two
    best = fits.first()
    assert best.converged and best.ll == pytest.approx(loglik(table, best.k, best.qt, [0, 4]), abs=1e-7)
    rnd = np.random.default_rng(0)
    for _ in range(300):
        k, qt = (np.array(v) * np.exp(rnd.normal(0, s, 2)) for v, s in ((best.k, 0.05), (best.qt, 0.2)))
        if qt.sum() < 1:
            assert loglik(table, k, qt, [0, 4]) < best.ll + 1e-4


def test_cost_follows_the_parameters(spark):
    """One trajectory per parameter and round beside that of the point."""
    for s in (1, 4):
        row = spark.createDataFrame([(list(range(s + 1)), [0.1] * (2 * s))], "rgs array<int>, trial array<double>")
        model = sc.Model(OPTIONS, rf.subject_blocks(), F.col("rgs"), F.lit(1), F.col("rgs"))
        assert len(row.select(sc.neighbours(model)).first()[0]) == 2 * s + 1


def test_shared_rates(spark):
    series = ss.series_arrays(counts_of(spark, expected_counts([1.1, 1.1, 0.9], [0.2, 0.1, 0.1], total=5000)), "base")
    cand = spark.createDataFrame([("s", [0, 1, 1, 2]), ("s", [0, 0, 0, 0])], "series_id string, rgs array<int>")
    out = {tuple(r.rgs): r for r in rf.fit(cand.join(series, "series_id"), OPTIONS).collect()}
    old = {tuple(r.rgs): r.ll for r in ft.fit(ft.default_start(cand, series), OPTIONS).collect()}
    assert out[0, 1, 1, 2].k[0] == out[0, 1, 1, 2].k[1] and list(out[0, 0, 0, 0].k) == [1.0] * 3
    assert {k: r.ll for k, r in out.items()} == pytest.approx(old, abs=1e-6)


@pytest.mark.parametrize("joint", [False, True])
def test_ends_touch_the_cut(two, joint):
    table, series, fits = two
    best = fits.first()
    cut = chi2_quantile(4 if joint else 1) / 2
    ends = rf.interval_solutions(fits, series, OPTIONS, joint).collect()
    assert len(ends) == 8 and all(e.converged for e in ends)
    for e in ends:
        assert e.ll == pytest.approx(best.ll - cut, abs=1e-5) == pytest.approx(loglik(table, e.k, e.qt, [0, 4]), abs=1e-5)
        assert ([*e.k, *e.qt][e.param] - [*best.k, *best.qt][e.param]) * e.side > 0


def test_brackets_give_the_same_ends(two):
    _, series, fits = two
    quick = {(e.param, e.side): [*e.k, *e.qt][e.param] for e in rf.interval_solutions(fits, series, OPTIONS).collect()}
    model = rf.model_of(OPTIONS)
    rows = fits.drop("ll").join(series, "series_id").crossJoin(fits.select("ll")).select(
        "series_id", "rgs", *rf.ARRAYS, F.lit(1).alias("place"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"),
        model.pack(F.col("k"), F.col("qt")).alias("best"), (F.col("ll") - F.col("ln_coef")).alias("top"),
        (F.col("ll") - F.col("ln_coef") - chi2_quantile(1) / 2).alias("cut"))
    got = sc.bracketed(rows, model).select("side", "ok", F.exp(F.col("x")[0]).alias("k"), "ll", "cut").collect()
    assert all(r.ok for r in got) and all(r.ll >= r.cut for r in got)
    assert {r.side: r.k for r in got} == pytest.approx({s: quick[0, s] for s in (-1, 1)}, abs=1e-5)


def test_end_at_a_bound(spark):
    """A subject never seen after the first day: the rate has no lower end but its bound."""
    table = np.array([[5, 95]] + [[0, 100]] * 11)
    series = ss.series_arrays(counts_of(spark, table), "base")
    fits = rf.fit(rf.finest(series), OPTIONS)
    ends = {(e.param, e.side): e for e in rf.interval_solutions(ss.materialise(fits), series, OPTIONS).collect()}
    assert ends[0, -1].k[0] == pytest.approx(1e-10, rel=1e-6) and ends[0, 1].k[0] < 1
    assert len(ends) == 4


def test_time_scales_and_concentration(spark):
    rnd = np.random.default_rng(7)
    q = np.array(brute.shares([1.1, 0.95], [0.2, 0.3], [0, 0], 30, [W] * 3))
    counts = counts_of(spark, np.array([rnd.multinomial(200, rnd.dirichlet(p * 30)) for p in q]))
    series = ss.series_arrays(counts, "base", undetected=True)
    options = ft.Options(ALPHA, THETA, dirichlet=True)
    fits = ss.materialise(rf.fit(rf.finest(series), options))
    old = ft.fit(ft.finest_start(series), options).first()
    row = fits.first()
    assert row.converged and row.ll == pytest.approx(old.ll, abs=1e-5) and row.d == pytest.approx(old.d, rel=1e-3)
    fold = lk.loglik(tr.with_trajectory(ss.attach_series(fits.select("series_id", "k", "qt", "d"), series), ALPHA, THETA), "d").first().ll
    assert fold == pytest.approx(row.ll, abs=1e-6)
    with pytest.raises(Exception, match="too wide"):
        wide = ss.series_arrays(counts_of(spark, expected_counts([1.05], [0.2], days=24, total=200), width=8), "base", undetected=True)
        rf.fit(rf.finest(wide), ft.Options(ALPHA, THETA, time_scale=True)).collect()


def test_concentration_of_given_shares(spark):
    """Against a search over the plain likelihood."""
    rnd = np.random.default_rng(2)
    q = brute.shares([1.0], [0.3], [0], 40, [W] * 2)
    table = np.array([rnd.multinomial(80, rnd.dirichlet(np.array(p) * 12)) for p in q])
    series = ss.series_arrays(counts_of(spark, table), "base", undetected=True).withColumns({
        "k": F.array(F.lit(1.0)), "qt": F.array(F.lit(0.3)), "rgs": F.array(F.lit(0), F.lit(1))})
    got = rp.concentration_report(tr.with_trajectory(series, ALPHA, THETA), ft.Options(ALPHA, THETA, dirichlet=True)).first()

    def ll(d):
        return sum(brute.dirichlet(n.tolist(), p, d) for n, p in zip(table, q, strict=True))

    grid = np.exp(np.linspace(math.log(1), math.log(200), 400))
    assert ll(got.D) >= max(map(ll, grid)) - 1e-9
    for end in (got.D_lb, got.D_ub):
        assert ll(end) == pytest.approx(ll(got.D) - chi2_quantile(1) / 2, abs=1e-6)
    assert got.D_lb < got.D < got.D_ub


def test_regression_start_is_near(spark):
    table = expected_counts([1.15, 0.9], [0.2, 0.05], days=30, total=5000, intro=[0, 6])
    series = ss.series_arrays(counts_of(spark, table), "base")
    r = rf.finest(series).select(rf.regression_start(OPTIONS).alias("s")).first().s
    # the days after an entry still remember its absence, so its slope is only roughly right
    assert list(r.k) == pytest.approx([1.15, 0.9], abs=0.15) and list(r.qt) == pytest.approx([0.2, 0.05], rel=0.5)


def test_small_systems(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(6, 6))
    a, b = a @ a.T + np.eye(6), rnd.normal(size=(6, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<array<double>>")
    got = df.select(linear.solve(F.col("a"), F.col("b"))).first()[0]
    assert np.allclose(got, np.linalg.solve(a, b), atol=1e-12)
    singular = spark.createDataFrame([([[1.0, 1.0], [1.0, 1.0]], [[1.0], [1.0]])], "a array<array<double>>, b array<array<double>>")
    assert singular.select(linear.solve(F.col("a"), F.col("b"))).first()[0][1] == [None]


def test_digamma_and_quantiles(spark):
    xs = [1e-3, 0.5, 1.0, 7.5, 1e4]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(digamma("x")).collect()]
    want = [(math.lgamma(x * (1 + 1e-6)) - math.lgamma(x * (1 - 1e-6))) / (2e-6 * x) for x in xs]
    assert got == pytest.approx(want, rel=1e-5)
    dfs = [1, 2, 3, 10, 60]
    found = [r[0] for r in spark.createDataFrame([(d,) for d in dfs], "d int").select(chi2_quantile_column("d")).collect()]
    assert found == pytest.approx([chi2_quantile(d) for d in dfs], rel=1e-10)

