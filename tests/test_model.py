import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tideshare.functions.gamma import weights_value
from tideshare.operators.counts import day_bins
from tideshare.operators.shares import bin_share, population_mean
from tideshare.plans import fit as ft
from tideshare.plans import likelihood as lk
from tideshare.plans import reports as rp
from tideshare.plans import search as se
from tideshare.plans import series as ss
from tideshare.plans import trajectory as tr
from tideshare.workload.bindings import BASELINE, user_counts

ALPHA, THETA = 4.109, 0.73
W = weights_value(ALPHA, THETA)
START = dt.date(2024, 1, 1)
OPTIONS = ft.Options(ALPHA, THETA)
VARIANTS = ["a", "b", "c", "d"]


def model_row(spark, k, qt, intro, days, c=None):
    c = c or [1.0] * len(k)
    return spark.createDataFrame(
        [("s", START, days, [f"v{i}" for i in range(len(k))], "base", intro, [float(x) for x in c],
          [float(x) for x in k], [float(x) for x in qt])],
        "series_id string, t_start date, n_days int, subjects array<string>, baseline string, "
        "intro array<int>, c array<double>, k array<double>, qt array<double>")


def traj(spark, *args, c=None, **kw):
    return np.array(tr.with_trajectory(model_row(spark, *args, c=c), ALPHA, THETA, **kw).first().traj)


def counts_of(spark, table, width=1, series="s"):
    """counts from a days x categories table, ``width`` days per bin, baseline last."""
    data = []
    for i in range(0, len(table), width):
        chunk = np.sum(table[i : i + width], axis=0)
        a, b = START + dt.timedelta(i), START + dt.timedelta(min(i + width, len(table)) - 1)
        data += [(series, a, b, v, int(x)) for v, x in zip([*VARIANTS[: len(chunk) - 1], "base"], chunk)]
    return spark.createDataFrame(
        data, "series_id string, date_from date, date_till date, variant string, n bigint")


def expected_counts(k, qt, days=40, total=2000, intro=None):
    q = brute.shares(list(k), list(qt), intro or [0] * len(k), days, [W] * (len(k) + 1))
    return np.round(np.array(q) * total).astype(int)


def test_fixed_trajectory_value(spark):
    w = [round(x, 6) for x in W]
    row = model_row(spark, [1.05, 0.97, 1.2, 1.0], [0.2, 0.2, 0.1, 0.2], [0] * 4, 30)
    q = row.select(tr.trajectory_column("k", "qt", "intro", "n_days", w, 8)[29][2].alias("q"))
    assert q.first().q == pytest.approx(0.344944, abs=5e-7)


@pytest.mark.parametrize("k,qt,intro", [
    ([1.1, 0.9], [0.3, 0.2], [0, 0]),
    ([1.3, 0.8, 1.0], [0.1, 0.2, 0.05], [0, 5, 11]),
    ([1.0, 1.0], [0.7, 0.6], [0, 0]),
    ([1.4, 1.2], [0.6, 0.9], [0, 3]),
])
@pytest.mark.parametrize("division", [1, 2, 4])
def test_trajectory_against_loops(spark, k, qt, intro, division):
    w = weights_value(ALPHA, THETA, None, division)
    want = brute.shares(k, qt, intro, 20, [w] * (len(k) + 1), division)
    assert traj(spark, k, qt, intro, 20, division=division) == pytest.approx(np.array(want), abs=1e-12)


def test_shares_above_one_are_rescaled(spark):
    q = traj(spark, [1.0, 1.0], [0.7, 0.6], [0, 0], 2)
    assert q[0] == pytest.approx([0.538462, 0.461538, 0.0], abs=1e-6)


def test_time_scale_and_forecast(spark):
    c = [0.6, 1.5]
    w = [weights_value(ALPHA, THETA, 8, 1, x) for x in (*c, 1.0)]
    want = brute.shares([1.1, 1.2], [0.2, 0.1], [0, 4], 25, w)
    got = traj(spark, [1.1, 1.2], [0.2, 0.1], [0, 4], 20, c=c, future=5, time_scale=True)
    assert got == pytest.approx(np.array(want), abs=1e-12)


def test_scenarios_from_a_table(spark):
    params = spark.createDataFrame(
        [("s", "v0", START, 1.0, 1.0, 0.8), ("s", "v1", START, 1.0, 1.2, 0.15),
         ("s", "v2", START + dt.timedelta(3), 1.0, 0.9, 0.05)],
        "series_id string, variant string, date date, c double, k double, qt double")
    rows = tr.with_trajectory(tr.scenario_arrays(params, "v0", F.lit(START + dt.timedelta(9))), ALPHA, THETA)
    want = brute.shares([1.2, 0.9], [0.15, 0.05], [0, 3], 10, [W] * 3)
    assert np.array(rows.first().traj) == pytest.approx(np.array(want), abs=1e-12)
    long = tr.explode_trajectory(rows, means=True)
    means = population_mean(long, params).orderBy("date").collect()
    inside = long.groupBy("date").agg(F.max("average_k").alias("k")).orderBy("date").collect()
    assert [r.k for r in inside] == pytest.approx([r.average_k for r in means])
    assert means[9].average_k == pytest.approx(want[9][0] * 1.2 + want[9][1] * 0.9 + want[9][2])
    point = long.groupBy("date").agg(F.sum("q").alias("n"))
    assert day_bins(point).filter("date_from = date_till").count() == 10


def test_series_arrays(spark):
    table = np.array([[1, 0, 5], [0, 0, 6], [2, 3, 4]])
    row = ss.series_arrays(counts_of(spark, table), "base").first()
    assert (row.subjects, row.intro, row.n_days) == (["a", "b"], [0, 2], 3)
    assert [b.n for b in row.bins] == table.tolist()
    want = sum(math.lgamma(sum(r) + 1) - sum(math.lgamma(x + 1) for x in r) for r in table.tolist())
    assert row.ln_coef == pytest.approx(want)
    assert ss.series_arrays(counts_of(spark, table), "base", undetected=True).first().intro == [0, 0]


def test_series_contracts(spark):
    c = counts_of(spark, np.array([[1, 0, 5], [2, 0, 6], [1, 0, 2], [1, 0, 2]]), width=2)
    with pytest.raises(Exception, match="no counts of the baseline"):
        ss.series_arrays(c, "other").collect()
    with pytest.raises(Exception, match="never seen"):
        ss.series_arrays(c, "base").collect()
    with pytest.raises(Exception, match="leaves the window"):
        ss.series_arrays(c, "base", start=F.lit(START + dt.timedelta(1)), undetected=True).collect()


@pytest.mark.parametrize("width", [1, 7])
def test_likelihoods_against_loops(spark, width):
    table = expected_counts([1.1, 0.9], [0.3, 0.1], 21, 50)
    table[3 if width == 1 else slice(0, 7)] = 0  # an empty bin adds nothing
    c = counts_of(spark, table, width)
    rows = tr.with_trajectory(
        ss.series_arrays(c, "base", undetected=True)
        .withColumn("k", F.array(F.lit(1.05), F.lit(1.0))).withColumn("qt", F.array(F.lit(0.25), F.lit(0.2))),
        ALPHA, THETA)
    q = np.array(brute.shares([1.05, 1.0], [0.25, 0.2], [0, 0], 21, [W] * 3))
    bins = [(table[i : i + width].sum(axis=0), q[i : i + width].mean(axis=0)) for i in range(0, 21, width)]
    want = sum(brute.multinomial(n.tolist(), p) for n, p in bins)
    assert lk.loglik(rows).first().ll == pytest.approx(want, abs=1e-8)
    want = sum(brute.dirichlet(n.tolist(), p, 30.0) for n, p in bins)
    assert lk.loglik(rows, F.lit(30.0)).first().ll == pytest.approx(want, abs=1e-8)
    terms = lk.loglik_terms(bin_share(c, tr.explode_trajectory(rows))).first().ll
    assert terms == pytest.approx(lk.loglik(rows, constant=False).first().ll, abs=1e-8)


def test_zero_probability(spark):
    c = counts_of(spark, np.array([[1, 2, 5], [2, 1, 6]]))
    rows = tr.with_trajectory(
        ss.series_arrays(c, "base").withColumn("k", F.array(F.lit(1.0), F.lit(1.0)))
        .withColumn("qt", F.array(F.lit(0.0), F.lit(0.2))), ALPHA, THETA)
    assert lk.loglik(rows).first().ll == -1.7976931348623157e308
    want = sum(brute.dirichlet(n, p, 9.0) for n, p in zip([[2, 5], [1, 6]], [[0.2, 0.8]] * 2))
    assert lk.loglik(rows, F.lit(9.0)).first().ll == pytest.approx(want, abs=1e-9)


def fitted(spark, counts, options=OPTIONS, undetected=False):
    series = ss.series_arrays(counts, "base", undetected=undetected)
    fits = ft.scored(ft.fit(ft.finest_start(series), options), options)
    return series, fits


def test_fit_recovers_the_truth_and_agrees_with_the_fold(spark):
    k, qt = [1.08, 0.94, 1.2], [0.2, 0.1, 0.02]
    series, fits = fitted(spark, counts_of(spark, expected_counts(k, qt, total=200000, intro=[0, 0, 6])))
    row = fits.first()
    assert row.converged and row.num_pars == 6
    assert list(row.k) == pytest.approx(k, abs=2e-3) and list(row.qt) == pytest.approx(qt, rel=2e-2)
    assert row.AIC == pytest.approx(-2 * row.ll + 12)
    again = lk.loglik(tr.with_trajectory(
        ss.attach_series(fits.select("series_id", "k", "qt"), series), ALPHA, THETA)).first().ll
    assert again == pytest.approx(row.ll, abs=1e-6)


def test_no_neighbour_is_better(spark):
    rng = np.random.default_rng(3)
    q = brute.shares([1.1, 0.95], [0.2, 0.3], [0, 0], 30, [W] * 3)
    table = np.array([rng.multinomial(80, p) for p in q])
    _, fits = fitted(spark, counts_of(spark, table), undetected=True)
    best = fits.first()

    def ll(k, qt):
        p = brute.shares(k, qt, [0, 0], 30, [W] * 3)
        return sum(brute.multinomial(n.tolist(), x) for n, x in zip(table, p))

    top = ll(list(best.k), list(best.qt))
    assert top == pytest.approx(best.ll, abs=1e-7)
    for j in range(2):
        for f in (0.998, 1.002):
            k, qt = list(best.k), list(best.qt)
            k[j] *= f
            assert ll(k, qt) < top
            k, qt = list(best.k), list(best.qt)
            qt[j] *= f
            assert ll(k, qt) < top


def test_batched_fits_equal_single_fits(spark):
    rng = np.random.default_rng(5)
    parts = []
    for i, (days, s) in enumerate([(20, 2), (35, 2), (25, 3), (30, 3), (20, 2)]):
        q = brute.shares([1.1, 0.9, 1.0][:s], [0.2, 0.1, 0.1][:s], [0] * s, days, [W] * (s + 1))
        table = np.array([rng.multinomial(60, p) for p in q])
        parts.append(counts_of(spark, table, 7 if i % 2 else 1, f"s{i}"))
    together = se.union(parts)
    _, fits = fitted(spark, together, undetected=True)
    got = {r.series_id: r for r in fits.collect()}
    assert len(got) == 5 and all(r.converged for r in got.values())
    for i, part in enumerate(parts):
        alone = fitted(spark, part, undetected=True)[1].first()
        assert got[f"s{i}"].ll == pytest.approx(alone.ll, abs=1e-7)
        assert list(got[f"s{i}"].k) == pytest.approx(list(alone.k), abs=1e-5)


def test_shared_rates_and_one_block(spark):
    c = counts_of(spark, expected_counts([1.1, 1.1, 0.9], [0.2, 0.1, 0.1], total=5000))
    series, fits = fitted(spark, c)
    cand = spark.createDataFrame([("s", [0, 1, 1, 2]), ("s", [0, 0, 0, 0])], "series_id string, rgs array<int>")
    out = {tuple(r.rgs): r for r in ft.scored(ft.fit(ft.warm_start(cand, ft.named_start(series, ft.array_params(fits, series))), OPTIONS), OPTIONS).collect()}
    two, none = out[0, 1, 1, 2], out[0, 0, 0, 0]
    assert two.k[0] == two.k[1] and two.num_pars == 5 and none.num_pars == 3
    assert list(none.k) == [1.0, 1.0, 1.0]
    assert none.ll < two.ll <= fits.first().ll + 1e-7
    cold = ft.fit(ft.default_start(cand, series), OPTIONS).collect()
    assert {tuple(r.rgs): r.ll for r in cold}[0, 1, 1, 2] == pytest.approx(two.ll, abs=1e-6)


def test_intervals_touch_the_cut_and_hold_the_estimate(spark):
    rng = np.random.default_rng(1)
    q = brute.shares([1.1, 0.95], [0.2, 0.3], [0, 0], 30, [W] * 3)
    series, fits = fitted(spark, counts_of(spark, np.array([rng.multinomial(80, p) for p in q])), undetected=True)
    best = fits.first()
    for joint, cut in ((False, 3.841459 / 2), (True, 9.487729 / 2)):
        ends = ft.interval_solutions(fits, series, OPTIONS, joint).collect()
        assert len(ends) == 8
        for e in ends:
            assert e.ll == pytest.approx(best.ll - cut, abs=1e-5)
            mid = [*best.k, *best.qt][e.param]
            assert ([*e.k, *e.qt][e.param] - mid) * e.side > 0


def test_extreme_equals_bisection():
    rng = np.random.default_rng(2)
    q = brute.shares([1.2, 0.9], [0.1, 0.2], [0, 4], 25, [W] * 3)
    n = np.array([rng.multinomial(100, p) for p in q], dtype=float)[:, None, :]
    day = np.arange(1, 26)[:, None]
    from tideshare.functions.renewal import Fits

    fits = Fits(np.array([[1, 2]]), np.array([[0, 4]]), day, day, n, np.array(W), ALPHA, THETA, False, False)
    par, ll, ok = fits.maximise(fits.pack(np.ones((1, 2)), np.full((1, 2), 0.001)))
    assert ok[0]
    for i in range(4):
        for side in (-1, 1):
            args = (par, ll, np.array([i]), np.array([side]), ll - 1.92)
            assert fits.extreme(*args)[0][0, i] == pytest.approx(fits.bisect(*args)[0][0, i], abs=1e-5)


def test_derivatives():
    from tideshare.functions.renewal import Fits

    rng = np.random.default_rng(4)
    n = rng.integers(0, 30, (20, 1, 4)).astype(float)
    d1, d2 = np.arange(1, 41, 2)[:, None], np.arange(2, 42, 2)[:, None]
    for scale, diri in ((False, False), (True, False), (False, True), (True, True)):
        f = Fits(np.array([[1, 0, 1]]), np.array([[0, 0, 0]]), d1, d2, n, np.array(W), ALPHA, THETA, scale, diri)
        par = f.pack(np.array([[1.1, 1.0, 1.1]]), np.array([[0.2, 0.1, 0.3]]), np.array([[0.9, 1.2, 1.1]]), np.array([40.0]))
        grad = f.evaluate(par)[1][0]
        for j in range(par.shape[1]):
            e = np.zeros_like(par)
            e[0, j] = 1e-5
            slope = (f.evaluate(par + e)[0][0] - f.evaluate(par - e)[0][0]) / 2e-5
            assert grad[j] == pytest.approx(slope, rel=1e-5, abs=1e-4)


def small_fits(starts, users=6, days=24):
    """Every start for every user: sparse counts of two subjects, the second one enters on day 3."""
    from tideshare.functions.renewal import Fits

    rng = np.random.default_rng(11)
    q = brute.shares([1.1, 0.9], [0.2, 0.3], [0, 3], days, [W] * 3)
    n = np.array([[rng.multinomial(3, p) for p in q] for _ in range(users)], dtype=float).repeat(len(starts), axis=0)
    day = np.repeat(np.arange(1, days + 1)[:, None], len(n), axis=1)
    block, intro = np.array([[1, 2]]).repeat(len(n), axis=0), np.array([[0, 3]]).repeat(len(n), axis=0)
    fits = Fits(block, intro, day, day, n.transpose(1, 0, 2), np.array(W), ALPHA, THETA, False, False)
    rates, shares = np.tile(np.array(starts), (users, 1)).T
    return fits, fits.pack(rates[:, None].repeat(2, axis=1), shares[:, None].repeat(2, axis=1))


def test_starts_that_meet_go_on_once(monkeypatch):
    """The same best fit of every user, with derivatives for fewer points."""
    from tideshare.functions.renewal import Fits

    starts = [(ft.START_RATE, ft.START_SHARE), *ft.OTHER_STARTS]
    fits, par = small_fits(starts)
    points, whole = [], Fits.evaluate_piece
    monkeypatch.setattr(Fits, "evaluate_piece", lambda f, x, slopes: points.append(f.b * slopes) or whole(f, x, slopes))
    _, ll, ok = fits.maximise(par)
    alone = sum(points)
    points.clear()
    _, met_ll, met_ok = fits.maximise(par, problem=np.repeat(np.arange(6), len(starts)))
    assert sum(points) < 0.95 * alone
    best, met_best = (v.reshape(6, -1).max(axis=1) for v in (ll, np.where(met_ok, met_ll, -np.inf)))
    assert ok.reshape(6, -1).any(axis=1).all() and met_best == pytest.approx(best, abs=1e-6)


def test_pieces_give_the_same_as_the_whole():
    fits, par = small_fits([(1.0, 0.01), (1.2, 0.6)])
    whole = fits.evaluate(par)
    fits.piece = 1
    for a, b in zip(fits.evaluate(par), whole):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)
    some = np.array([7, 2])
    assert fits.evaluate(par[some], some, slopes=False) == pytest.approx(whole[0][some])


def test_dirichlet_and_time_scale_fits(spark):
    rng = np.random.default_rng(7)
    q = np.array(brute.shares([1.1, 0.95], [0.2, 0.3], [0, 0], 40, [W] * 3))
    table = np.array([rng.multinomial(200, rng.dirichlet(p * 30)) for p in q])
    c = counts_of(spark, table)
    options = ft.Options(ALPHA, THETA, dirichlet=True)
    series, fits = fitted(spark, c, options, undetected=True)
    row = fits.first()
    assert 15 < row.d < 60 and row.num_pars == 5
    fold = lk.loglik(tr.with_trajectory(ss.attach_series(fits.select("series_id", "k", "qt", "d"), series), ALPHA, THETA),
                     "d").first().ll
    assert fold == pytest.approx(row.ll, abs=1e-6)
    report = rp.dirichlet_report(fits, ft.interval_solutions(fits, series, options)).first()
    assert report.D_lb < row.d < report.D_ub
    plain = fitted(spark, c, undetected=True)[1].first()
    scaled = fitted(spark, c, ft.Options(ALPHA, THETA, time_scale=True), undetected=True)[1].first()
    assert scaled.ll >= plain.ll - 1e-6 and scaled.num_pars == 6


def test_reports(spark):
    c = counts_of(spark, expected_counts([1.1, 0.95, 1.1], [0.2, 0.3, 0.01], total=500, intro=[0, 0, 5]))
    series, fits = fitted(spark, c)
    solutions = ft.solution_ids(ft.interval_solutions(fits, series, OPTIONS))
    bounds = series.select("series_id", "t_start")
    est = rp.estimates_report(ft.array_params(fits, series), bounds, "base", ft.array_params(solutions, series))
    rows = {r.variant: r for r in est.collect()}
    assert set(rows) == {"a", "b", "c", "base"}
    assert rows["base"].k == 1.0 and rows["base"].qt == pytest.approx(1 - rows["a"].qt - rows["b"].qt)
    assert rows["c"].date == START + dt.timedelta(5)
    for r in rows.values():
        assert r.k_lb <= r.k <= r.k_ub and r.qt_lb <= r.qt <= r.qt_ub and r.c_lb == r.c_ub == 1.0
    traj_ = rp.fitted_trajectory(fits, series, OPTIONS, 5)
    bands = rp.region_bands(fits, ft.interval_solutions(fits, series, OPTIONS, True), series, OPTIONS, 5)
    wide = rp.frequency_report(traj_, ["a", "b", "c", "base"], bands)
    out = wide.orderBy("date").collect()
    assert len(out) == 45
    for r in out:
        assert r.a_lb <= r.a + 1e-12 and r.a <= r.a_ub + 1e-12
        assert r.average_k_lb <= r.average_k + 1e-12 <= r.average_k_ub + 2e-12
    blocks = {r.variant: r.block for r in rp.blocks_report(ft.array_params(fits, series), "base").collect()}
    assert blocks == {"base": 0, "a": 1, "b": 2, "c": 3}
    chart = rp.chart_table(c, rp.fitted_trajectory(fits, series, OPTIONS))
    assert chart.count() == 40 * 4


def test_group_report_merges_equal_rows(spark):
    est = spark.createDataFrame(
        [("s", "b", 1.0501, 1.0401, 1.0601), ("s", "a", 1.0502, 1.0402, 1.0602), ("s", "c", 1.2, 1.1, 1.3)],
        "series_id string, variant string, k double, k_lb double, k_ub double")
    assert [(r.variant, r.k, r.k_ci_95) for r in rp.group_report(est).collect()] == [
        ("c", 1.2, "1.100—1.300"), ("a,b", 1.05, "1.040—1.060")]
    assert [r.variant for r in rp.rate_report(est).collect()] == ["c", "a", "b"]


def test_extreme_points_of_a_region(spark):
    rows = [("s", 0, [1.0, 3.0], -5.0), ("s", 1, [1.0, 2.0], -4.0), ("s", 2, [2.0, 2.0], -1.0),
            ("s", 3, [3.0, 2.0], -4.0), ("s", 4, [2.0, 1.0], -3.0), ("s", 5, [2.0, 2.5], -2.0), ("t", 7, [1.5], -9.0)]
    region = spark.createDataFrame(rows, "series_id string, candidate_id long, k array<double>, ll double").withColumns({
        "qt": F.col("k"), "subjects": F.transform("k", lambda x: x.cast("string")), "baseline": F.lit("b")})
    got = lk.extreme_points(region).collect()
    # of the two points with the lowest first rate the likelier one; nothing twice; 5 is extreme nowhere
    assert sorted((r.series_id, r.candidate_id) for r in got) == [("s", 0), ("s", 1), ("s", 2), ("s", 3), ("s", 4), ("t", 7)]
    inside = lk.likelihood_region(region.drop("top"))
    # cuts of 4.74 for two subjects and 3.0 for one
    assert {r.candidate_id for r in inside.collect()} == {0, 1, 2, 3, 4, 5, 7}
    assert {r.candidate_id for r in lk.likelihood_region(region, 1).collect()} == {2, 5, 7}


def test_time_scales_need_narrow_bins(spark):
    table = expected_counts([1.05], [0.2], days=24, total=200)
    options = ft.Options(ALPHA, THETA, time_scale=True)
    with pytest.raises(Exception, match="too wide"):
        fitted(spark, counts_of(spark, table, width=8), options, undetected=True)[1].collect()
    assert len(fitted(spark, counts_of(spark, table, width=7), options, undetected=True)[1].collect()) == 1
    arrays = ss.series_arrays(counts_of(spark, table, width=8), "base", undetected=True).withColumn("qt", F.array(F.lit(0.2)))
    with pytest.raises(Exception, match="too wide"):
        lk.grid_scores(arrays, [1.0, 1.1], ALPHA, THETA, time_scales=[0.8, 1.0]).collect()


def test_grid_options_against_the_fold(spark):
    table = expected_counts([1.05, 0.95], [0.2, 0.1], days=20, total=100)
    series = ss.series_arrays(counts_of(spark, table), "base", undetected=True).withColumn("qt", F.array(F.lit(0.2), F.lit(0.1)))
    rates = [0.9, 1.0, 1.1]
    scaled = lk.grid_scores(series, rates, ALPHA, THETA, division=2, time_scales=[0.8, 1.25]).collect()
    assert len(scaled) == 18 and len({r.candidate_id for r in scaled}) == 18
    assert {(tuple(r.k), tuple(r.c)) for r in scaled} == {((a, b), (c, c)) for a in rates for b in rates for c in (0.8, 1.25)}
    again = spark.createDataFrame([(r.candidate_id, r.k, r.c) for r in scaled], "candidate_id long, k array<double>, c array<double>")
    rows = again.crossJoin(series.drop("k", "c"))
    want = {r.candidate_id: r.ll for r in lk.loglik(tr.with_trajectory(rows, ALPHA, THETA, division=2, time_scale=True), constant=False).collect()}
    assert {r.candidate_id: r.ll for r in scaled} == pytest.approx(want)
    tried = {d: {r.candidate_id: r.ll for r in lk.grid_scores(series, rates, ALPHA, THETA, concentrations=[d]).collect()}
             for d in (5.0, 500.0)}
    for r in lk.grid_scores(series, rates, ALPHA, THETA, concentrations=[5.0, 500.0]).collect():
        assert r.ll == pytest.approx(max(t[r.candidate_id] for t in tried.values()))
        assert tried[r.d][r.candidate_id] == r.ll


def test_points_within_a_grouping(spark):
    rows = [("s", 0, [1.1, 1.1]), ("s", 1, [1.0, 1.1]), ("s", 2, [1.1, 1.0]), ("s", 3, [1.0, 1.0]), ("t", 4, [1.2, 1.1]), ("u", 5, [1.0, 1.0])]
    points = spark.createDataFrame(rows, "series_id string, candidate_id long, k array<double>")
    groupings = spark.createDataFrame([("s", [0, 1, 1]), ("t", [0, 0, 1])], "series_id string, rgs array<int>")
    assert {r.candidate_id for r in lk.within_grouping(points, groupings).collect()} == {0, 3}
    other = spark.createDataFrame([("s", [0, 0, 1]), ("t", [0, 1, 2])], "series_id string, rgs array<int>")
    assert {r.candidate_id for r in lk.within_grouping(points, other).collect()} == {1, 3, 4}


def test_restarts_find_nothing_better(spark):
    """Other start points than those of the fit, on all users; maxima on the edge of rescaled shares differ a little."""
    series = ss.series_arrays(user_counts(spark, "/root/testdata/sf0.01"), BASELINE)
    started = ss.materialise(ft.finest_start(series))
    best = {r.series_id: r.ll for r in ft.fit(started, OPTIONS).collect()}
    rng = np.random.default_rng(7)
    points = spark.createDataFrame([(float(k), float(q)) for k, q in zip(rng.uniform(0.5, 2, 8), 10 ** rng.uniform(-3, -0.7, 8))], "f double, s double")
    again = started.crossJoin(points).withColumns({
        "k": F.transform("k", lambda x: x * F.col("f")), "qt": F.transform("qt", lambda x: F.col("s"))})
    alone = again.select("series_id", "rgs", "k", "qt", *ft.ARRAYS).withColumn("start", F.lit(0))
    found = ft.fit_rows(alone, OPTIONS).groupBy("series_id").agg(F.max("ll").alias("ll")).collect()
    assert len(best) == len(found) > 100
    assert max(r.ll - best[r.series_id] for r in found) < 0.01


def test_start_out_of_reach_and_best_of_several(spark):
    table = expected_counts([1.05, 0.95], [0.2, 0.1], days=24, total=200)
    series = ss.series_arrays(counts_of(spark, table), "base", undetected=True)
    far = ft.finest_start(series).withColumn("qt", F.array(F.lit(0.7), F.lit(0.6)))
    near = ft.fit(ft.finest_start(series), OPTIONS).first()
    got = ft.fit(far, OPTIONS).first()
    assert got.converged and got.ll == pytest.approx(near.ll, abs=1e-6)
    own = ft.with_starts(far).filter("start = 0").first()
    assert sum(own.qt) == pytest.approx(ft.HIGHEST_START) and own.qt[0] / own.qt[1] == pytest.approx(7 / 6)
    rows = spark.createDataFrame(
        [("s", [0, 1], 0, -5.0, False), ("s", [0, 1], 1, -5.0 - 1e-9, True), ("s", [0, 1], 2, float("-inf"), False),
         ("t", [0, 1], 0, -3.0, True), ("t", [0, 1], 1, -3.0, True), ("u", [0, 1], 0, float("-inf"), False)],
        "series_id string, rgs array<int>, start int, ll double, converged boolean")
    kept = {r.series_id: (r.ll, r.converged) for r in ft.best_start(rows).collect()}
    assert kept == {"s": (-5.0 - 1e-9, True), "t": (-3.0, True), "u": (float("-inf"), False)}
