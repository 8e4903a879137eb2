import math

import pytest
from pyspark.sql import functions as F

from brute import coarser, finest_common, partitions, relabel
from tideshare.functions import gamma as G
from tideshare.functions import numbers as N
from tideshare.functions import partitions as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def ints(a):
    return F.array(*[F.lit(int(x)) for x in a])


@pytest.mark.parametrize("x", [1e-6, 0.01, 0.5, 1.0, 2.0, 3.7, 100.0, 1e6])
def test_log_gamma(spark, x):
    assert value(spark, N.log_gamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-13)


def test_log_factorial_is_exact_for_empty_cells(spark):
    assert value(spark, N.log_factorial(F.lit(0))) == 0.0
    assert value(spark, N.log_factorial(F.lit(5))) == pytest.approx(math.log(120))


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -float("inf"), None])
def test_finite_guard(spark, bad):
    assert value(spark, N.finite_ll(F.lit(bad).cast("double"))) == N.WORST_LL


def test_report_text(spark):
    assert value(spark, N.floor3(F.lit(1.09199))) == pytest.approx(1.091)
    assert value(spark, N.interval_label(F.lit(1.0), F.lit(1.25))) == "1.000—1.250"


def test_weights_of_the_default_settings():
    weights = G.weights_value(4.109, 0.73)
    assert [round(w, 6) for w in weights] == [
        0.044150, 0.231893, 0.293012, 0.216051, 0.121596, 0.058240, 0.025063, 0.009995]
    assert G.truncation_length(2.03, 2.32) == 16
    assert G.truncation_length(4.5, 0.6) == 7
    assert sum(G.weights_value(2.03, 2.32, division=4)) == pytest.approx(1)


def test_weight_column_equals_scalar(spark):
    for c in (0.3, 1.0, 1.7):
        column = value(spark, G.gamma_weights(4.109, 0.73, F.lit(c), 8, 2))
        assert column == pytest.approx(G.weights_value(4.109, 0.73, 8, 2, c), abs=1e-13)
    assert value(spark, G.truncation_days(4.109, F.lit(0.73))) == 8


@pytest.mark.parametrize("df,expected", [(1, 3.841459), (8, 15.507313), (36, 50.998460)])
def test_chi2(df, expected):
    assert G.chi2_quantile(df) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("a,ok", [([0, 1, 1, 2], True), ([0, 2, 1], False), ([1, 0], False), ([0, -1], False)])
def test_is_rgs(spark, a, ok):
    assert value(spark, P.is_rgs(ints(a))) is ok


def test_relabel_blocks_and_back(spark):
    assert value(spark, P.to_rgs(ints([7, 3, 7, 0, 3, 9]))) == [0, 1, 0, 2, 1, 3]
    assert value(spark, P.rgs_to_blocks(ints([0, 1, 0, 2]))) == [[1, 3], [2], [4]]
    assert value(spark, P.blocks_to_rgs(F.array(ints([4]), ints([3, 1]), ints([2])))) == [0, 1, 0, 2]
    assert value(spark, P.sort_partition(F.array(ints([4]), ints([3, 1]), ints([2])))) == [[1, 3], [2], [4]]
    assert value(spark, P.ground_set(F.array(ints([4]), ints([3, 1])))) == [1, 3, 4]
    assert value(spark, P.parse_rgs(F.lit("0-1-10"))) == [0, 1, 10]
    assert value(spark, P.rgs_digest(ints([0, 1, 2]))) == "d06d8aa64fba0fc59d7def312fb4fea8a1a41d01"


def test_is_partition(spark):
    ground = ints([1, 2, 3])
    assert value(spark, P.is_partition(F.array(ints([1, 3]), ints([2])), ground))
    assert not value(spark, P.is_partition(F.array(ints([1, 3])), ground))
    assert not value(spark, P.is_partition(F.array(ints([1, 3]), ints([2, 3])), ground))
    empty = F.filter(ints([1]), lambda x: x > 5)
    assert not value(spark, P.is_partition(F.array(ints([1, 2, 3]), empty), ground))


def test_merges(spark):
    assert sorted(value(spark, P.one_step_merges(ints([0, 1, 2, 0])))) == [[0, 0, 1, 0], [0, 1, 0, 0], [0, 1, 1, 0]]
    assert value(spark, P.one_step_merges(ints([0, 0, 0]))) == []
    shared = value(spark, P.common_children(ints([0, 1, 1, 2]), ints([0, 1, 2, 2])))
    assert sorted(shared) == [[0, 1, 1, 1]]


def test_lattice_against_brute_force(spark):
    every = partitions(4)
    pairs = spark.createDataFrame([(list(x), list(y)) for x in every for y in every], "x array<int>, y array<int>")
    got = pairs.select("x", "y", P.is_coarsening("y", "x").alias("c"), P.is_refinement("x", "y").alias("r"),
                       P.finest_common_coarsening("x", "y").alias("j")).collect()
    for row in got:
        assert row.c == row.r == coarser(row.y, row.x)
        assert row.j == list(finest_common(row.x, row.y))


def test_common_coarsening_of_a_chain(spark):
    assert value(spark, P.finest_common_coarsening(ints([0, 1, 2, 0, 2]), ints([0, 1, 2, 1, 2]))) == [0, 0, 1, 0, 1]


def test_length_mismatch_fails(spark):
    with pytest.raises(Exception, match="different length"):
        value(spark, P.is_coarsening(ints([0, 1]), ints([0, 1, 2])))


def test_brute_relabel():
    assert relabel([7, 3, 7]) == [0, 1, 0]


def test_gamma_cdf_needs_many_terms(spark):
    """Large shapes, near the mean and far above it."""
    import numpy as np

    from tideshare.functions.renewal import gamma_cdf as batch_cdf

    for shape, x in ((200.0, 499.0), (300.0, 699.0), (300.0, 300.0), (4.1, 3.0)):
        want = G.gamma_cdf_value(x, shape)
        assert abs(value(spark, G.gamma_cdf(F.lit(x), shape, 1.0)) - want) < 1e-9
        assert abs(float(batch_cdf(np.array([x]), shape)[0]) - want) < 1e-9
    assert value(spark, G.truncation_days(4.109, F.lit(20 * 0.73))) == next(
        m for m in range(1, 10_000) if G.gamma_cdf_value(m, 4.109, 20 * 0.73) >= 0.99)
