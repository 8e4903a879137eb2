"""Context-tree weighting against a plain recursion, the base score against its formula."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest
from corpus_rows import SCHEMA, rows

from tideshare.llm.ctw import DEPTH, held_out, score_texts


def path(data, i):
    """Decisions of byte i: place and bit."""
    b = data[i]
    return [(1 << k | b >> (8 - k), b >> (7 - k) & 1) for k in range(8)]


def framed(text):
    return b"\xff" * DEPTH + (text or "").encode() + b"\xff"


def plain_scores(given):
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for i, t, *_ in given:
        if held_out(i):
            continue
        data = framed(t)
        for at in range(DEPTH, len(data)):
            for place, bit in path(data, at):
                for d in range(DEPTH + 1):
                    counts[place, data[at - d:at]][bit] += 1
                    if d:
                        children[place, data[at - d + 1:at]].add(data[at - d:at])

    def estimate(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @cache
    def weight(place, context):
        own = estimate(*counts.get((place, context), (0, 0)))
        if len(context) == DEPTH:
            return own, 1.0
        below = sum(weight(place, c)[0] for c in children.get((place, context), ()))
        top = max(own, below)
        both = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
        return both, math.exp(own - math.log(2) - both)

    out = {}
    for i, t, *_ in given:
        data, total = framed(t), 0.0
        for at in range(DEPTH, len(data)):
            for place, bit in path(data, at):
                chance = 0.5
                for d in range(DEPTH, -1, -1):
                    n = counts.get((place, data[at - d:at]), (0, 0))
                    share = weight(place, data[at - d:at])[1]
                    chance = share * (n[bit] + 0.5) / (sum(n) + 1) + (1 - share) * chance
                total += math.log10(chance)
        out[i] = total
    return out


@pytest.fixture(scope="module")
def given():
    return [r for r in rows(4, 40) if len(r[1] or "") < 1500] + [(None, "null id here", None, None, None)]


def test_scores(spark, given):
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(given, SCHEMA)).collect()}
    want = plain_scores(given)
    sizes = {i: len((t or "").encode()) for i, t, *_ in given}
    assert len(got) == len(given)
    for i, w in want.items():
        assert got[i].score == pytest.approx(w, rel=1e-4, abs=1e-3)
        assert got[i].n_bytes == sizes[i]
        assert got[i].bits_per_byte == pytest.approx(-got[i].score / math.log10(2) / (sizes[i] + 1))
        assert got[i].held_out == (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)


def test_base_score(spark, given):
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(given, SCHEMA)).collect()}
    words = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for i, t, *_ in given}
    count = Counter(w for i, ws in words.items() if not held_out(i) for w in ws)
    total = sum(count.values())
    for i, ws in words.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert got[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws))


def test_trained_text_is_likelier(spark):
    given = [(i, "the cat sat on the mat and the dog ate the hat", None, None, None) for i in range(30)] + [
        (1000, "the dog sat on the hat", None, None, None), (1001, "qzx vvk jjw pqp zzx xkq wv", None, None, None)]
    got = {r.doc_id: r.score for r in score_texts(spark.createDataFrame(given, SCHEMA)).collect()}
    assert got[1000] > got[1001] / 2


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
