"""Whitening against a direct decomposition of the covariance."""

import math

import numpy as np
import pytest

from tideshare.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(given, count):
    """``{(vec_id, component): (n, deviation, whitened, explained)}`` up to the sign of a component."""
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in given
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in rows}), float)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    trace = (y * y).sum() / n
    out = []
    for i, x in rows:
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        for k, w in enumerate((np.array(x) - s / n) @ u / np.sqrt(e)):
            out.append((i, k + 1, n, deviation, w, e[k] / trace))
    return out


def same(got, want):
    got, want = (sorted(r, key=lambda x: (x[0] is not None, x[0], x[1])) for r in (got, want))
    assert [r[:4] for r in got] == [tuple(r[:4]) for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-9 for r in got)


def table(seed, n, dim, spread=1.0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(0, 0.1, (n, dim)) * (1 + spread * np.arange(dim) / dim)
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(x)]


@pytest.mark.parametrize(("n", "dim", "spread"), [(200, 5, 1.0), (300, 48, 1.0), (260, 40, 0.0), (30, 48, 2.0), (3, 50, 1.0)])
def test_same_as_direct(spark, n, dim, spread):
    given = table(n, n, dim, spread)
    given += [(n + i, given[0][1], 1) for i in range(40)]  # a hot vector
    given += [(9000, None, 1), (9001, [None] * dim, 1), (9002, [math.nan] * dim, 1), (9003, [math.inf] + [0.0] * (dim - 1), 1)]
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    want = plain(given, 4)
    if n == 3:  # three points span two directions
        want = [r for r in want if r[1] <= 2]
    same([tuple(r) for r in wh.whitening(df, 4).collect()], want)


def test_passes_damp_a_crowded_spectrum(spark):
    """Fewer passes than dimensions, none of which forms the whole matrix."""
    given = table(1, 4000, 96, 1.0)
    fits = wh.FitList(spark.createDataFrame(given, SCHEMA), 96, "embedding")
    shapes, over = [], fits.sum_over
    fits.sum_over = lambda of, shape: shapes.append(shape) or over(of, shape)
    fit = wh.components(fits, 4)
    assert len(fit.values) == 4 and all(s[1] <= 32 for s in shapes) and len(shapes) < 96
    x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in given], float)
    y = x - x.mean(axis=0)
    v = y.T @ y / len(y)
    assert np.abs(v @ fit.vectors - fit.vectors * fit.values).max() < 1e-10 * fit.values[0]


def test_filter_is_small_where_it_damps():
    values = np.linspace(1, 10, 40)
    got = wh.filtered(lambda q: values[:, None] * q, np.ones((40, 1)), 1.0, 7.0, 10.0, 12)[:, 0]
    assert abs(got[-1] - 1) < 1e-9 and np.abs(got[values <= 7]).max() < 1e-4


def test_lowest_is_a_bound():
    rnd = np.random.default_rng(0)
    a = rnd.normal(size=(60, 60))
    v = a @ a.T + 3 * np.eye(60)
    assert 0 <= wh.lowest(lambda q: v @ q, 60) <= np.linalg.eigvalsh(v)[0] + 1e-9


def test_exact_beyond_doubles(spark):
    """Entries whose squares pass 53 bits; a deviation that passes 64 bits is null."""
    given = [(i, [float(2**20 + i), float(-(2**18) * i)], 0) for i in range(5)]
    got = {r["vec_id"]: r["deviation"] for r in wh.whitening(spark.createDataFrame(given, SCHEMA), 1).collect()}
    xs = [[256 * (2**20 + i), -256 * 2**18 * i] for i in range(5)]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    assert got == {i: sum((5 * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in enumerate(xs)}
    huge = [(i, [1e17 * i, 1.0], 0) for i in range(4)]
    assert {r["deviation"] for r in wh.whitening(spark.createDataFrame(huge, SCHEMA), 1).collect()} == {None}


def test_nothing_to_fit(spark):
    for given in ([], [(1, None, 0)], [(1, [], 0), (2, [], 0)], [(1, [0.5, 0.5], 0)] * 4):
        df = spark.createDataFrame(given, SCHEMA)
        assert wh.whitening(df).collect() == [] and len(wh.whitening(df).columns) == 7


def test_other_lengths_null_and_repeated_identifiers_clashing_columns(spark):
    rnd = np.random.default_rng(5)
    given = [(None if i % 3 == 0 else 7, [float(np.float32(c)) for c in rnd.normal(size=3)], i) for i in range(30)]
    df = spark.createDataFrame([*given, (1, [1.0], 2), (2, [1.0] * 9, 2)], "vec_id long, embedding array<float>, n int")
    got = wh.whitening(df, 2).collect()
    assert len(got) == 60 and {r["n"] for r in got} == {30} and {r["vec_id"] for r in got} == {None, 7}


def test_bytes_of_rows():
    x = np.array([[1, -1], [200, 0], [-40_000, 5], [2**40, -(2**63)]], np.int64)
    coded = wh.to_bytes(x)
    assert (wh.from_bytes(coded, 2) == x).all() and [len(c) for c in coded] == [3, 5, 9, 17]
