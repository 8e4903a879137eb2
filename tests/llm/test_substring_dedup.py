"""Repeated word windows against a dictionary of all windows."""

import re

import pytest
from corpus_rows import SCHEMA, rows

from tideshare.llm import substring_dedup as sd


def plain(given, size):
    docs = [((-2**63 if i is None else i), re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), i) for i, t, *_ in given]
    first = {}
    for did, words, _ in docs:
        for s in range(len(words) - size + 1):
            key = tuple(words[s:s + size])
            first[key] = min(first.get(key, (did, s)), (did, s))
    out = []
    for did, words, shown in docs:
        gone = set()
        for s in range(len(words) - size + 1):
            if first[tuple(words[s:s + size])] < (did, s):
                gone.update(range(s, s + size))
        out.append((shown, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "bits"), [(20, 22), (3, 22), (5, 4)])
def test_same_as_all_windows(spark, monkeypatch, size, bits):
    """Also with a sketch of 16 cells a slice, which lets nearly everything through."""
    monkeypatch.setattr(sd, "CELL_BITS", bits)
    given = [*rows(1), (None, rows(1)[4][1], None, None, None), (3, rows(1)[9][1], "en", None, None), rows(1)[5]]
    df = spark.createDataFrame(given, SCHEMA)
    got = sorted(map(tuple, sd.substring_dedup(df, size).collect()), key=repr)
    assert got == plain(given, size)
    assert any(r[2] for r in got)


def test_buckets_without_windows(spark):
    given = [(i, "few words" if i % 2 else None, None, None, None) for i in range(9)]
    assert sorted(map(tuple, sd.substring_dedup(spark.createDataFrame(given, SCHEMA)).collect()), key=repr) == plain(given, 20)


def test_empty_table(spark):
    assert sd.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_are_shuffled_once(spark):
    df = spark.createDataFrame(rows(2), SCHEMA)
    done = sd.substring_dedup(df)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") == 2
