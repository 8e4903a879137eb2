from tideshare.functions.partitions import finest_common_coarsening
import random
import pytest
from pyspark.sql import functions as F

from brute import coarser, partitions
from tideshare.functions.partitions import rgs_key
from tideshare.operators import partitions as P


def sizes(spark, *ns):
    return spark.createDataFrame([(n,) for n in ns], "n int")


def test_enumeration(spark):
    out = P.enumerate_partitions(sizes(spark, 5), "n", 5).orderBy("rgs")
    assert [tuple(r.rgs) for r in out.collect()] == partitions(5)
    assert P.enumerate_partitions(sizes(spark, 7), "n", 7).count() == 877
    assert P.enumerate_partitions(sizes(spark, 6), "n", 6, at_most=F.lit(3)).count() == 122
    exact = P.enumerate_partitions(sizes(spark, 6), "n", 6, exactly=F.lit(3))
    assert exact.count() == 90 and exact.filter(F.array_max("rgs") != 2).count() == 0
    assert [r.rgs for r in P.enumerate_partitions(sizes(spark, 1), "n", 3).collect()] == [[0]]


def test_rows_of_different_size(spark):
    out = P.enumerate_partitions(sizes(spark, 1, 2, 3, 4), "n", 4).groupBy("n").count()
    assert {r.n: r["count"] for r in out.collect()} == {1: 1, 2: 2, 3: 5, 4: 15}
    with pytest.raises(Exception, match="more than 3"):
        P.enumerate_partitions(sizes(spark, 4), "n", 3).count()


def test_numbers_of_partitions(spark):
    """Positions follow the order of the strings in both directions, with limits that differ by row."""
    given = spark.createDataFrame([(n, k) for n in range(1, 7) for k in range(1, 8)], "n int, k int")
    every = {n: partitions(n) for n in range(1, 7)}
    for kind in ("at_most", "exactly"):
        for reverse in (False, True):
            out = P.enumerate_partitions(given, "n", position="place", reverse=reverse, **{kind: "k"})
            got = {}
            for r in out.collect():
                got.setdefault((r.n, r.k), {})[r.place] = tuple(r.rgs)
            for n in every:
                for k in range(1, 8):
                    fits = [p for p in every[n] if (max(p) + 1 == k if kind == "exactly" else max(p) < k)]
                    want = dict(enumerate(sorted(fits, reverse=reverse), 1))
                    assert got.get((n, k), {}) == want


def test_enumeration_is_dealt_evenly(spark):
    """One row of eleven elements keeps all tasks busy alike."""
    out = P.enumerate_partitions(sizes(spark, 11), "n", position="place").withColumn("task", F.spark_partition_id())
    tasks = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(rgs_key("rgs")).alias("kinds")).collect()
    assert sum(r.n for r in tasks) == sum(r.kinds for r in tasks) == 678570
    assert len(tasks) > 1 and max(r.n for r in tasks) < 1.1 * min(r.n for r in tasks)


def test_enumeration_without_elements_and_of_too_many(spark):
    none = spark.createDataFrame([(0,), (-3,), (None,)], "n int")
    assert P.enumerate_partitions(none, "n").collect() == []
    with pytest.raises(Exception, match="64 bits"):
        P.enumerate_partitions(sizes(spark, 26), "n").count()
    two = P.enumerate_partitions(sizes(spark, 14), "n", at_most=F.lit(2), position="place")
    assert two.filter("place = 8192").first().rgs == [0] + [1] * 13


def test_all_coarsenings(spark):
    every = partitions(4)
    df = spark.createDataFrame([(list(x),) for x in every], "rgs array<int>")
    got = {}
    for r in P.all_coarsenings(df, 4).collect():
        got.setdefault(tuple(r.rgs), []).append(tuple(r.coarser))
    for x in every:
        assert sorted(got[x]) == [y for y in every if coarser(y, x)]


def test_merge_once(spark):
    df = spark.createDataFrame([([0, 1, 2, 3],)], "rgs array<int>")
    out = P.merge_once(df)
    assert out.count() == 6
    assert out.select(F.array_max("child").alias("m")).distinct().collect()[0].m == 2


def test_drop_dominated_against_brute_force(spark):
    every = partitions(5)
    pruned = {"a": [every[7], every[30]], "b": [every[-1]], "c": []}
    cand = spark.createDataFrame([(s, list(x)) for s in pruned for x in every], "series_id string, rgs array<int>")
    bad = spark.createDataFrame([(s, list(x)) for s, xs in pruned.items() for x in xs],
                                "series_id string, rgs array<int>")
    got = {(r.series_id, tuple(r.rgs)) for r in P.drop_dominated(cand, bad).collect()}
    want = {(s, x) for s, xs in pruned.items() for x in every if not any(coarser(x, p) for p in xs)}
    assert got == want
    plan = P.drop_dominated(cand, bad)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_surviving_children_equal_the_general_form(spark):
    every = partitions(5)
    schema = "series_id string, rgs array<int>"
    pruned = [every[9], every[20], every[33]]
    parents = [x for x in every if 1 <= max(x) and not any(coarser(x, p) for p in pruned)]
    bad = spark.createDataFrame([("s", list(x)) for x in pruned], schema)
    up = spark.createDataFrame([("s", list(x)) for x in parents], schema)
    children = P.merge_once(up).select("series_id", F.col("child").alias("rgs")).distinct()
    want = {tuple(r.rgs) for r in P.drop_dominated(children, bad).collect()}
    got = [tuple(r.rgs) for r in P.surviving_children(up, bad).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < children.count()
    assert P.surviving_children(up, bad.limit(0)).count() == children.count()


def test_labels(spark):
    data = [("s", 1, 1.0), ("s", 2, 1.2), ("s", 3, 1.0), ("s", 4, 0.9)]
    df = spark.createDataFrame(data, "series_id string, pos int, k double")
    assert P.labels_to_partition(df, "k", "pos").first().rgs_key == "0-1-0-2"
    long = P.labels_to_long(df, "k", "pos").orderBy("pos").collect()
    assert [r.label for r in long] == [0, 1, 0, 2]
    assert P.with_level(spark.createDataFrame([([0, 1, 2],), ([0, 0, 0],)], "rgs array<int>")).select(
        rgs_key("rgs").alias("r"), "level").collect() == [("0-1-2", 1), ("0-0-0", 3)]


def test_common_coarsening_of_memberships_equals_the_array_form(spark):
    rnd = random.Random(5)
    rows, pairs = [], []
    for i in range(40):
        a, b = ([rnd.randrange(6) for _ in range(9)] for _ in range(2))
        pairs.append((str(i), a, b))
        rows += [(str(i), source, pos, str(x)) for source, labels in (("a", a), ("b", b)) for pos, x in enumerate(labels)]
    members = spark.createDataFrame(rows, "series_id string, source string, pos int, label string")
    arrays = spark.createDataFrame(pairs, "series_id string, a array<int>, b array<int>").select(
        "series_id", finest_common_coarsening("a", "b").alias("rgs"))
    want = {r.series_id: list(r.rgs) for r in arrays.collect()}
    got: dict = {}
    for r in P.common_coarsening(members).collect():
        got.setdefault(r.series_id, {})[r.pos] = r.block
    assert {k: [v[p] for p in range(9)] for k, v in got.items()} == want


def test_common_coarsening_of_a_long_chain(spark):
    """Ten thousand elements in three partitions, linked two by two into chains of a thousand."""
    n = 10_000
    rows = []
    for pos in range(n):
        chain, place = divmod(pos, 1000)
        rows += [("a", pos, chain * 1000 + place // 2), ("b", pos, chain * 1000 + (place + 1) // 2), ("c", pos, 10**6 + pos)]
    members = spark.createDataFrame(rows, "source string, pos int, label int").withColumn("series_id", F.lit("s"))
    got = {r.pos: r.block for r in P.common_coarsening(members).collect()}
    assert got == {pos: pos // 1000 for pos in range(n)}
