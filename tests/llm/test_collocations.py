"""Phrases against a dictionary of all n-grams; the summary against its guarantee."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_rows import SCHEMA, rows

from tideshare.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(given, at_least, top, longest=3, percent=50):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in given:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    wanted = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= at_least}
    longer = Counter()
    for (lang, w), a in wanted.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i:i + k]] = max(longer[lang, w[i:i + k]], a)
    scored = {}
    for (lang, w), a in wanted.items():
        if not longer[lang, w] or 100 * longer[lang, w] < percent * a:
            cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, place, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in scored.items() for place, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def given_rows(seed):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("ab cd Ef é, x.y 日本 q\tr s! t\nu the of".split(" ")) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    return rows(seed) + [(1000 + i, t, rnd.choice(["en", "de", None]), None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("at_least", "top", "waiting", "longest"), [(10, 2000, 1 << 22, 3), (2, 25, 50, 4), (1, 7, 1, 3)])
def test_same_as_all_phrases(spark, monkeypatch, at_least, top, waiting, longest):
    monkeypatch.setattr(co, "WAITING", waiting)
    monkeypatch.setattr(co, "STEP_TEXT", 1000 if top < 2000 else co.STEP_TEXT)
    given = given_rows(at_least)
    got = co.collocations(spark.createDataFrame(given, SCHEMA), range(2, longest + 1), at_least, top)
    got = got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain(given, at_least, top, longest)


def test_colliding_hashes_lose_nothing(spark, monkeypatch):
    """All n-grams in 16 cells of a slice."""
    monkeypatch.setattr(co, "CELLS", 15)
    given = given_rows(5)
    got = co.collocations(spark.createDataFrame(given, SCHEMA), at_least=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain(given, 3, 2000)


def test_summary_keeps_every_frequent_value():
    rnd = np.random.default_rng(3)
    values = np.minimum(rnd.zipf(1.3, 20_000), 5_000).astype(np.uint32)
    true, threshold = Counter(values.tolist()), 25
    whole = co.Summary(len(values) // threshold + 1)
    for some in np.array_split(values, 40):
        own = co.Summary(whole.capacity)
        own.merge(*np.unique(some, return_counts=True))
        whole.merge(own.value, own.count)
    assert whole.lost > 0 and whole.lost <= len(values) / (whole.capacity + 1)
    kept = set(whole.may_reach(threshold).tolist())
    assert {v for v, c in true.items() if c >= threshold} <= kept
    for v, c in zip(whole.value.tolist(), whole.count.tolist(), strict=True):
        assert c <= true[v] <= c + whole.lost


def test_empty_table_nulls_and_clashing_columns(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, None, None, None)] * 3, SCHEMA)
    assert co.collocations(none).collect() == []
    odd = spark.createDataFrame([("a b", "x", 1, "p", 2.0, 3)] * 12, "text string, lang string, a int, phrase string, score double, n int")
    got = co.collocations(odd).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert list(map(tuple, got)) == [("x", 1, "a b", 12, 12, 12, 24, 1000000)]


def test_products_beyond_64_bits(spark):
    """Scores of counts whose products need some 120 bits."""
    big = 10**15
    got = spark.sql(f"select (1000000bd * cast({big - 1}L as decimal(15)) * cast({big - 1}L as decimal(15))) "
                    f"div (cast({big}L as decimal(18)) * cast({big}L as decimal(18)))").first()[0]
    assert got == 1000000 * (big - 1) ** 2 // big**2


def test_texts_are_shuffled_once(spark):
    done = co.phrase_counts(spark.createDataFrame(rows(2), SCHEMA), range(1, 4), 3)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") == 1


def test_long_texts_are_cut_between_pieces(spark):
    """Steps of 50 bytes see the n-grams that whole texts have."""
    import pyarrow as pa

    given = given_rows(8)
    table = pa.table({"lang": ["en"] * len(given), "text": [t for _, t, *_ in given]}).filter(pa.compute.field("text").is_valid())

    def all_grams(most):
        found = Counter()
        for words in co.in_steps(table, most):
            for size in (1, 2, 3):
                found.update(words.grams(size)[1].tolist())
        return found

    steps = sum(1 for _ in co.in_steps(table, 50))
    assert steps > 100 and all_grams(50) == all_grams(1 << 30)
