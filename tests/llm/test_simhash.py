"""Fingerprints, links and components against plain definitions."""

import random
import re

import numpy as np
import pytest
import xxhash
from corpus_rows import SCHEMA, rows

from tideshare.llm.simhash import components, links, near_duplicates


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if near(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("spread", [0, 24])
def test_links_connect_what_is_near(spark, spread):
    rnd = random.Random(spread)
    centre = rnd.getrandbits(64)
    found = {centre}
    while len(found) < 1500:  # one crowd around a centre, more than a block, and single ones
        x = rnd.choice((centre, rnd.getrandbits(64)) if not spread else (centre, rnd.choice(tuple(found)) if len(found) < 60 else rnd.getrandbits(64)))
        for _ in range(rnd.randint(0, 5)):
            x ^= 1 << rnd.randrange(spread or 64)
        found.add(x)
    signed = np.array(sorted(found), np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = links(distinct)
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 3 for e in edges.collect())
    got = {r.node: r.root for r in components(edges).collect()}
    want = plain_components(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {n: got.get(n, n) for n in signed} == want
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(70)],  # a path
    [(0, i) for i in range(1, 50)] + [(100, i) for i in range(101, 140)] + [(49, 139)],  # two stars
    [(2 * i, 2 * i + 1) for i in range(30)],
    [],
])
def test_components(spark, edges):
    order = list(range(200))
    random.Random(3).shuffle(order)
    renamed = [(order[a], order[b]) for a, b in edges]
    df = spark.createDataFrame(renamed, "a long, b long")
    nodes = sorted({n for e in renamed for n in e})
    joined = {frozenset(e) for e in renamed}
    assert {r.node: r.root for r in components(df).collect()} == plain_components(nodes, lambda a, b: frozenset((a, b)) in joined)


def test_rows_of_every_kind(spark):
    given = [*rows(), (None, "null id", None, None, None), (3, rows()[3][1], "en", None, None)]
    df = spark.createDataFrame(given, SCHEMA)
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    prints = [plain_fingerprint(r[1]) for r in given]
    key = [-1 if r[0] is None else r[0] for r in given]
    roots = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for k, p in zip(key, prints):
        least[roots[p]] = min(least.get(roots[p], k), k)
    want = [(r[0], f"{p:016x}", None if least[roots[p]] < 0 else least[roots[p]]) for r, p in zip(given, prints)]
    assert got == sorted(want, key=repr)
    assert near_duplicates(df.limit(0)).collect() == []
