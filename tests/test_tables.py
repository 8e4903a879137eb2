import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideshare.operators import counts as C
from tideshare.operators import ranking as R
from tideshare.operators import shares as S
from tideshare.sources import checks as K
from tideshare.sources import tables as T
from tideshare.streaming.counts import stream_counts, write_counts

DAY = dt.date


def raw(spark):
    data = [("a", "2024-01-01", "x")] * 3 + [("a", "2024-01-10", "y"), ("a", "2024-01-10", "x"),
                                              ("b", "2024-01-02", "x"), ("b", None, "x"), ("b", "2024-01-02", None)]
    return spark.createDataFrame(data, "s string, d string, v string").withColumn("d", F.to_date("d"))


def counts(spark, data):
    return spark.createDataFrame(
        data, "series_id string, date_from date, date_till date, variant string, n bigint")


def test_count_categories_is_dense(spark):
    out = C.count_categories(raw(spark), F.col("d"), "v", "s")
    got = {(r.series_id, r.date_from.day, r.variant): r.n for r in out.collect()}
    assert len(got) == 10 * 2 + 1
    assert got["a", 1, "x"] == 3 and got["a", 1, "y"] == 0 and got["a", 5, "x"] == 0 and got["b", 2, "x"] == 1


def test_weeks_are_cut_at_the_observed_days(spark):
    out = C.count_categories(raw(spark), F.col("d"), "v", "s", "week").filter("series_id = 'a'")
    bins = {(r.date_from.day, r.date_till.day) for r in out.collect()}
    assert bins == {(1, 7), (8, 10)}
    assert out.agg(F.sum("n")).first()[0] == 5


@pytest.mark.parametrize("grain", ["day", "week", "month"])
def test_raw_rows_are_scanned_once(spark, tmp_path, grain):
    path = str(tmp_path / "raw")
    raw(spark).write.parquet(path)
    out = C.count_categories(spark.read.parquet(path), F.col("d"), "v", "s", grain)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<s:string,d:date,v:string>" in out._jdf.queryExecution().executedPlan().toString()


def test_wide_and_long(spark):
    wide = spark.createDataFrame([(DAY(2024, 1, 1), DAY(2024, 1, 1), 1, 2)],
                                 "date_from date, date_till date, `A.1` int, `A.1.2` int")
    K.check_counts(wide)
    long = C.to_long(wide)
    assert {(r.variant, r.n) for r in long.collect()} == {("A.1", 1), ("A.1.2", 2)}
    back = C.to_wide(long, ["date_from", "date_till"], {"n": ""}, ["A.1", "A.1.2"])
    assert back.columns[2:] == ["A.1", "A.1.2"] and back.first()[2:] == (1, 2)


def test_contracts(spark):
    with pytest.raises(ValueError, match="date_from"):
        K.check_counts(spark.createDataFrame([(DAY(2024, 1, 1), DAY(2024, 1, 1))], "a date, date_till date"))
    with pytest.raises(ValueError, match="dates"):
        K.check_counts(spark.createDataFrame([("x", DAY(2024, 1, 1))], "date_from string, date_till date"))
    with pytest.raises(ValueError):
        K.check_params(spark.createDataFrame([("x", 1.0)], "variant string, k double"))
    with pytest.raises(ValueError, match="dates"):
        K.check_params(spark.createDataFrame([("x", "y", 1.0, 1.0, 1.0)],
                                             "variant string, date string, c double, k double, qt double"))
    blocks = spark.createDataFrame([([0, 1, 2],), ([0, 2, 1],), ([1, 1, 1],), ([0, 1],), ([0, 3, 1],)], "rgs array<int>")
    problems = {tuple(r.rgs): r.problem for r in K.block_violations(blocks, 3).collect()}
    assert problems == {(0, 2, 1): "label order", (1, 1, 1): "lowest label", (0, 1): "length",
                        (0, 3, 1): "too many blocks"}
    with pytest.raises(ValueError, match="label order"):
        K.require_empty(K.block_violations(blocks.filter(F.col("rgs")[1] == 2), 3))


def test_window_and_width_checks(spark):
    c = counts(spark, [("a", DAY(2024, 1, 1), DAY(2024, 1, 8), "x", 1), ("b", DAY(2024, 1, 1), DAY(2024, 1, 7), "x", 1)])
    assert [r.series_id for r in K.bin_width_violations(c).collect()] == ["a"]
    bad = K.window_violations(c, F.lit(DAY(2024, 1, 1)), F.lit(DAY(2024, 1, 8)))
    assert [r.series_id for r in bad.collect()] == ["b"]
    wanted = spark.createDataFrame([("a", "x"), ("a", "z")], "series_id string, variant string")
    assert [r.variant for r in K.variant_violations(c, wanted).collect()] == ["z"]


def test_first_seen_and_empty_bins(spark):
    c = counts(spark, [("a", DAY(2024, 1, i), DAY(2024, 1, i), v, n) for i, v, n in
                       [(1, "x", 0), (1, "y", 0), (2, "x", 4), (2, "y", 0), (3, "x", 1), (3, "y", 0)]])
    assert {r.variant: r.first_date for r in C.first_seen(c).collect()} == {"x": DAY(2024, 1, 2), "y": None}
    assert {r.first_date for r in C.first_seen(c, undetected=True).collect()} == {DAY(2024, 1, 1)}
    assert C.nonempty_bins(c).select("date_from").distinct().count() == 2
    shares = {(r.date_from.day, r.variant): r.share for r in C.observed_share(c).collect()}
    assert shares[1, "x"] is None and shares[2, "x"] == 1.0 and shares[2, "y"] == 0.0


def test_beam_keeps_ties(spark):
    scores = spark.createDataFrame([("a", 2, "p", 1.0), ("a", 2, "q", 1.0), ("a", 2, "r", 2.0), ("a", 2, "s", 3.0)],
                                   "series_id string, level int, rgs string, AIC double")
    assert R.beam(scores, 1).count() == 2
    assert R.beam(scores, 2).count() == 2
    assert R.beam(scores, 3).count() == 3
    assert R.best_partition(scores).first().rgs == "p"
    plan = R.beam(scores, 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_running_best_is_the_sequential_minimum(spark):
    data = [("a", level, f"{level}{i}", float((level * 7 + i * 13) % 11)) for level in (1, 2, 3) for i in range(4)]
    scores = spark.createDataFrame(data, "series_id string, level int, rgs string, AIC double")
    got = {r.rgs: r.best_before for r in R.running_best(scores).collect()}
    low = None
    for _, _, rgs, aic in sorted(data, key=lambda x: (x[1], x[2])):
        assert got[rgs] == low
        low = aic if low is None else min(low, aic)


def test_lag_sum_repeats_the_first_day(spark):
    q = [0.5, 0.3, 0.2]
    traj = spark.createDataFrame([("a", DAY(2024, 1, i + 1), "x", v) for i, v in enumerate(q)],
                                 "series_id string, date date, variant string, q double")
    got = [r.num for r in S.lag_sum(traj, [0.7, 0.3], F.lit(2.0)).orderBy("date").collect()]
    assert got == pytest.approx([2 * 0.5, 2 * 0.5, 2 * (0.7 * 0.3 + 0.3 * 0.5)])


def test_concat_names_and_first_appearance(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 1, "c"), ("h", 3, "a")], "g string, o int, variant string")
    assert {r.g: r.variant for r in S.concat_names(df, ["g"], "o").collect()} == {"g": "c,b", "h": "a"}
    seen = spark.createDataFrame([("s", i, v) for i, v in enumerate([9, 4, 9, 7])], "series_id string, pos int, v int")
    assert {r.v: r.label for r in C.first_appearance_id(seen, "v", "pos", ["series_id"]).collect()} == {9: 0, 4: 1, 7: 2}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_tables_round_trip(spark, tmp_path, fmt):
    wide = spark.createDataFrame([(DAY(2024, 1, 1), DAY(2024, 1, 2), 1, 2)],
                                 "date_from date, date_till date, `A.1` int, B int")
    path = T.write_table(wide, str(tmp_path), "counts", fmt)
    assert sorted((r.variant, r.n) for r in T.read_counts(spark, path, fmt).collect()) == [("A.1", 1), ("B", 2)]
    assert T.read_estimates(spark, path, fmt).count() == 1


def test_parameter_and_score_files(spark, tmp_path):
    params = spark.createDataFrame([("v0", DAY(2024, 1, 1), 1.0, 1.0, 0.8)], T.PARAMS_SCHEMA)
    assert T.read_params(spark, T.write_table(params, str(tmp_path), "p", "csv")).first() == params.first()
    scores = spark.createDataFrame([(-3.5, 2, 11.0)], T.SCORES_SCHEMA)
    assert T.read_scores(spark, T.write_table(scores, str(tmp_path), "s", "csv")).first() == scores.first()


def test_stream_gives_the_batch_counts(spark, tmp_path):
    data = [(f"2024-01-0{d} 0{h}:00:00", "x" if h % 2 else "y") for d in range(1, 8) for h in range(1, 6)]
    rows = spark.createDataFrame(data, "ts string, v string").withColumn("ts", F.to_timestamp("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stream_counts(stream, "ts", "v", F.lit("all"), "1 day")
    write_counts(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = C.count_categories(rows, F.col("ts"), "v", F.lit("all"), dense=False)
    final = got.agg(F.max("date_from")).first()[0]
    assert final >= DAY(2024, 1, 5)
    same = batch.filter(F.col("date_from") <= F.lit(final))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.select(*got.columns).collect()))


def test_running_best_of_groupings_that_start_alike(spark):
    """A thousand strings with a long common beginning lie in several tasks."""
    rnd = random.Random(3)
    rows = [("s", 1 + i % 2, "-".join(["0"] * 30 + list(f"{i:04d}")), rnd.random()) for i in range(1000)]
    scores = spark.createDataFrame(rows, "series_id string, level long, rgs string, AIC double")
    got = R.running_best(scores, 7)
    low, want = None, {}
    for _, level, rgs, value in sorted(rows, key=lambda r: (r[1], r[2])):
        want[level, rgs] = low
        low = value if low is None else min(low, value)
    assert {(r.level, r.rgs): r.best_before for r in got.collect()} == want
    placed = scores.repartitionByRange(7, "series_id", "level", "rgs").groupBy(F.spark_partition_id().alias("p")).count()
    assert placed.count() > 3


def test_lags_are_days_and_not_rows(spark):
    days = [1, 2, 4, 7]
    traj = spark.createDataFrame([("s", dt.date(2024, 1, d), "a", float(d)) for d in days], "series_id string, date date, variant string, q double")
    got = {r.date.day: r.num for r in S.lag_sum(traj, [0.7, 0.3], F.lit(1.0)).collect()}
    # days before the first count as the first, a missing day adds nothing
    assert got == pytest.approx({1: 1.0, 2: 0.7 * 1 + 0.3 * 1, 4: 0.3 * 2, 7: 0.0})


def test_unlisted_category_fails(spark):
    long = spark.createDataFrame([("s", "x", 1), ("s", "y", 2)], "series_id string, variant string, n long")
    assert C.to_wide(long, ["series_id"], {"n": ""}, ["x", "y", "z"]).first().asDict() == {"series_id": "s", "x": 1, "y": 2, "z": None}
    with pytest.raises(Exception, match="not listed"):
        C.to_wide(long, ["series_id"], {"n": ""}, ["x"]).collect()
