"""Repeated byte strings against a dictionary of all strings."""

import random

import pytest
from corpus_rows import SCHEMA, prose, rows

from tideshare.llm import suffix_dedup as sd


def plain(given, length):
    docs = [((-2**63 if r[0] is None else r[0]), (r[1] or "").encode(), r[0]) for r in given]
    first = {}
    for did, text, _ in docs:
        for s in range(len(text) - length + 1):
            key = text[s:s + length]
            first[key] = min(first.get(key, (did, s)), (did, s))
    out = []
    for did, text, shown in docs:
        gone = [False] * len(text)
        for s in range(len(text) - length + 1):
            if first[text[s:s + length]] < (did, s):
                gone[s:s + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((shown, len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return sorted(out, key=repr)


def shared_line(n=150):
    """A line in most texts, with other words around it, and edited copies of one text."""
    rnd = random.Random(7)
    line, base = prose(rnd, 30), prose(rnd, 120).split()
    out = []
    for i in range(n):
        if i % 3:
            out.append((i, f"{prose(rnd, rnd.randint(0, 30))} {line} {prose(rnd, rnd.randint(0, 30))}", None, None, None))
        else:
            words = list(base)
            words[rnd.randrange(len(words))] = prose(rnd, 1)
            out.append((i, " ".join(words), None, None, None))
    return out


def result(spark, given, length):
    found = sd.suffix_dedup(spark.createDataFrame(given, SCHEMA), length).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr)


@pytest.mark.parametrize(("length", "run", "group", "waiting"), [
    (100, 4 << 20, 50_000, 200_000), (40, 4 << 20, 50_000, 200_000), (100, 3000, 50_000, 200_000),  # many runs, cut texts
    (100, 3000, 3, 200_000), (100, 2000, 3, 10),  # groups go on by content
])
def test_same_as_all_strings(spark, monkeypatch, length, run, group, waiting):
    monkeypatch.setattr(sd, "RUN_BYTES", run)
    monkeypatch.setattr(sd, "GROUP", group)
    monkeypatch.setattr(sd, "WAITING", waiting)
    given = [*rows(1), (None, rows(1)[4][1], None, None, None), (3, rows(1)[9][1], "en", None, None), rows(1)[5]]
    got = result(spark, given, length)
    assert got == plain(given, length)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("buckets", [4, 40])
def test_groups_over_several_ranges(spark, monkeypatch, buckets):
    monkeypatch.setattr(sd, "tasks", lambda _: buckets)
    monkeypatch.setattr(sd, "RUN_BYTES", 10_000)
    given = shared_line()
    assert result(spark, given, 100) == plain(given, 100)


def test_merge_is_sorted_and_knows_prefixes():
    rnd = random.Random(2)
    runs = []
    for _ in range(7):
        keys = sorted(bytes(rnd.choice(b"\1\2") for _ in range(rnd.randint(24, 30))) for _ in range(rnd.randint(0, 40)))
        shared = [0, *(sd.compared(a, b, 0)[0] for a, b in zip(keys, keys[1:]))]
        runs.append([(n, k, ()) for n, k in zip(shared, keys)])
    got = list(sd.merged([iter(r) for r in runs]))
    keys = [k for _, k, _ in got]
    assert keys == sorted(k for r in runs for _, k, _ in r)
    assert [n for n, *_ in got][1:] == [sd.compared(a, b, 0)[0] for a, b in zip(keys, keys[1:])]


def test_empty_table(spark):
    assert sd.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_whose_marks_agree_in_half(spark):
    """Two texts without identifier whose hashes share 32 bits: the repeats of one stay out of the other."""
    import random

    import xxhash

    rnd = random.Random(0)
    base = "".join(chr(rnd.randrange(97, 123)) for _ in range(240))
    block = "".join(chr(rnd.randrange(65, 91)) for _ in range(120))
    half = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) & 0xFFFFFFFF
    plain_texts = {half(t): t for t in (f"{base}{i}" for i in range(150_000))}
    pair = next((plain_texts[h], t) for t in (f"{block}{block}{i}" for i in range(200_000)) if (h := half(t)) in plain_texts)
    df = spark.createDataFrame([(None, t) for t in pair], "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in sd.suffix_dedup(df, 100).collect())
    assert got == sorted([(len(pair[0]), 0), (len(pair[1]), 120)])
