"""SimHash near-duplicates: fingerprints, a byte-position index with count filtering, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import NO_ID, batch, checkpointed, raw_texts, row_key, steps, stored, tasks

#: Bits of a fingerprint, in bytes that are index positions.
POSITIONS = 8
#: Positions that make one index key. Two fingerprints that differ in at most three bits agree in at
#: least five of eight bytes, so in three bytes of the first four or in three of the last four.
KEYS = tuple(tuple(p for p in half if p != left_out) for half in (range(4), range(4, 8)) for left_out in half)
#: Fingerprints of one key that one task compares with each other at a time.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is one if it is set in over half of the hashes of all word shingles; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first = np.append(0, ends[:-1] + 1)[:n].tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(plain[s:e], seed) for s, e in zip(first, last, strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for s in range(0, n, 4096):  # the bits of some thousand hashes at a time
        ones += np.unpackbits(hashes[s:s + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


LOWER = bytes(range(256)).lower()


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", marked: bool = False) -> DataFrame:
    """``(doc_id, did, fp)``: the fingerprint as a signed long; null texts count as empty.

    With ``marked`` the rows have ``mark``, a hash of the text, before the fingerprint.
    """
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            found = np.array([fingerprint(t, shingle) for t in raw_texts(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in carried), pa.array(found)], names=[*carried, "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *row_key(id_column)[:1 + marked], "text")
    carried = rows.columns[:-1]
    return rows.mapInArrow(go, ", ".join(f"{n} long" for n in [*carried, "fp"]))


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """``(a, b)``, a < b: pairs that connect all fingerprints at ``distance`` bits or fewer.

    ``distinct(fp)`` has each fingerprint once. The index lists fingerprints under (positions, bytes
    there). In a list the shared bytes of a pair are counted, pairs below the guaranteed minimum of
    ``8 - distance`` are dropped, the others verified by their bits. A long list is cut into
    blocks, and each pair of blocks is a group of its own, so no list is held by one task. Of the pairs
    within a group only a spanning forest is returned: at most one row for each fingerprint of it.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the index keys are made for at most three bits")
    least = POSITIONS - distance
    byte = [F.shiftrightunsigned("fp", 8 * (7 - p)).bitwiseAND(255) for p in range(POSITIONS)]
    keys = F.array(*[sum((byte[p] * F.lit(256 ** (2 - i)) for i, p in enumerate(key)), F.lit(number << 24).cast("long"))
                     for number, key in enumerate(KEYS)])
    listed = distinct.select("fp", F.explode(keys).alias("key"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    postings = listed.join(sizes, "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    meeting = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                          lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = postings.select("key", "fp", own.alias("block"), F.explode(meeting).alias("meet")).select(
        "key", "meet.i", "meet.j", "block", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        kept = np.zeros((0, 5), np.int64)

        def forest(group: np.ndarray) -> list[tuple[int, int]]:
            i, j = group[0, 1], group[0, 2]
            left = group[group[:, 3] == i, 4]
            right = left if i == j else group[group[:, 3] == j, 4]
            found = []
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            for x in range(0, len(left), 256):
                differ = left[x:x + 256, None] ^ right[None, :]
                same = (differ.view(np.uint8).reshape(*differ.shape, POSITIONS) == 0).sum(axis=2)
                one, two = np.nonzero(same >= least)
                close = np.bitwise_count(differ[one, two].view(np.uint64)) <= distance
                for p, q in zip(left[x + one[close]].tolist(), right[two[close]].tolist(), strict=True):
                    if p != q and (a := root(p)) != (b := root(q)):
                        parent[a] = b
                        found.append((min(p, q), max(p, q)))
            return found

        def groups(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
                found = [pair for g in np.split(rows, cuts) for pair in forest(g)]
                yield batch(schema, *(list(zip(*found, strict=True)) or [[], []]))

        for b in batches:
            rows = np.concatenate([kept, np.stack([c.to_numpy().astype(np.int64) for c in b.columns], axis=1)])
            if not len(rows):
                continue
            last = (rows[:, :3] == rows[-1, :3]).all(axis=1)
            start = len(rows) if not last.any() else int(np.argmax(last))
            yield from groups(rows[:start])
            kept = rows[start:]  # a group that may go on in the next batch: two blocks at most
        yield from groups(kept)

    order = ["key", "i", "j"]
    return dealt.repartition(tasks(distinct.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(
        compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that each node of an edge reaches, itself included.

    Rounds of large-star and small-star: each node links its larger neighbours, then its smaller ones,
    to the smallest neighbour. Every round is a minimum per node and a join, then a checkpoint; the
    rounds end when no edge changes, after about the square of the logarithm of the longest path.
    """
    def starred(pairs: DataFrame, large: bool) -> DataFrame:
        """``pairs(u, v)``: for each u, its smallest neighbour or itself, linked to the others."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, "u")
        others = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if large:
            return others.filter("u != v")
        down = joined.select("v", "m").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.filter("u != m").select("u", F.col("m").alias("v"))
        return down.unionByName(own)

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(pairs: DataFrame) -> tuple:
        found = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        return tuple(found)

    # larger to smaller; a node keeps its link to the smallest neighbour in each half of a round
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    before = mark(pairs)
    while before[0]:
        large = starred(both_ways(pairs), True).distinct()
        small = starred(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).distinct()
        pairs = checkpointed(small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = mark(pairs)
        if now == before:
            break
        before = now
    # stars by now: every larger node has one link, to the root
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _components_of(rows: DataFrame, least: Column, distance: int) -> DataFrame:
    """``(fp, component)``: the least value that links reach from each fingerprint, its own included."""
    own = rows.groupBy("fp").agg(F.min(least).alias("least"))
    reach = components(links(own.select("fp"), distance))
    rooted = own.join(reach, own.fp == reach.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(smallest, "root").select("fp", "component")


def first_of_near(docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id") -> DataFrame:
    """``(did, mark)`` of one row of each component: that with the smallest identifier, then mark.

    Rows that share an identifier, or have none, are told apart by their text.
    """
    rows = stored(fingerprints(docs, shingle, id_column, marked=True))
    return _components_of(rows, F.struct("did", "mark"), distance).select("component.*").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest identifier that links of ``distance`` bits or fewer reach, its
    own included. Equal fingerprints meet by grouping before any comparison, so copies cost
    nothing more; only distinct fingerprints are indexed. A null text counts as empty, a
    text without words has fingerprint zero and is linked like any other; a null identifier is the
    smallest; repeated rows have equal results; an empty table gives no rows. Other columns are not read.
    """
    rows = stored(fingerprints(docs, shingle, id_column))
    return rows.join(_components_of(rows, F.col("did"), distance), "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
    )
