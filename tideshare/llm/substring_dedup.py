"""Repeated word windows: a count-min prefilter, then exact grouping of what it lets through."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import bucketed, packed, process_cache, tasks, text_bytes, unpacked

#: Text of one bucket of documents.
BUCKET_BYTES = 8 << 20
#: Rows of the sketch, each with its own hash.
ROWS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Cells of one slice of a row, as bits; a slice is what one group merges.
CELL_BITS = 22
#: Cells per byte of text in each row: about eight for a word.
CELLS_PER_BYTE = 1.3
#: Odd bases of the rolling hashes of bytes in a word and of words in a window.
BYTE_BASE, WORD_BASE = 0x5851F42D4C957F2D, 0xD1342543DE82EF95


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    held = process_cache(f"powers:{base}", dict)
    if len(held.get("up", ())) < n:
        for name, b in (("up", base), ("down", pow(base, -1, 2**64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            held[name] = np.cumprod(steps)
    return held["up"][:n], held["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of ``values[start:end]`` for each pair, from one running sum."""
    up, down = powers(base, len(values) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return mixed((total[ends] - total[starts]) * down[starts])


class Windows:
    """All windows of a few documents: where they are, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes], size: int):
        self.size = size
        self.plain = b"\n".join([b" ".join(t.split()) for t in texts]) + b"\n"
        data = np.frombuffer(self.plain, np.uint8)
        ends = np.flatnonzero((data == 32) | (data == 10))
        starts = np.append(0, ends[:-1] + 1)
        doc = np.cumsum(data[ends] == 10) - (data[ends] == 10)
        filled = ends > starts  # an empty text has one empty word
        self.starts, self.ends, self.doc = starts[filled], ends[filled], doc[filled]
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))  # of each document, its first word
        words = rolled(data, self.starts, self.ends, BYTE_BASE)
        at = np.arange(max(0, len(words) - size + 1))
        self.at = at[self.doc[at] == self.doc[at + size - 1]] if len(at) else at
        self.hash = rolled(words, self.at, self.at + size, WORD_BASE)

    def digests(self, which: np.ndarray) -> np.ndarray:
        """16 bytes per chosen window, of its words joined by one space."""
        s, e = self.starts[self.at[which]].tolist(), self.ends[self.at[which] + self.size - 1].tolist()
        plain, blake = self.plain, hashlib.blake2b
        found = b"".join([blake(plain[i:j], digest_size=16).digest() for i, j in zip(s, e, strict=True)])
        return np.frombuffer(found, ">u8").reshape(-1, 2).astype(np.uint64)


def in_steps(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Documents a few megabytes at a time, with the number of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    yield first, texts[first:]


def ordered(docs: pa.Table) -> pa.Table:
    """The rows of a bucket in one order, whatever order they came in."""
    return docs.sort_by([("did", "ascending"), ("mark", "ascending")])


def texts_of(docs: pa.Table) -> list[bytes]:
    return docs.column("text").cast(pa.large_binary()).to_pylist()


def cells(hashes: np.ndarray, row: int, slices: int) -> np.ndarray:
    """Cell of each hash in one row of the sketch: the slice above, the cell in the slice below."""
    x = mixed(hashes * np.uint64(ROWS[row]))
    part = ((x >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
    return part << np.uint64(CELL_BITS) | x & np.uint64((1 << CELL_BITS) - 1)


def by_slice(sorted_cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Slice, first and last place of each run of a slice."""
    part = (sorted_cells >> np.uint64(CELL_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    yield from zip(part[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)])


def gaps(rising: np.ndarray) -> list[bytes]:
    """Differences, low bytes and high bytes apart, which compress better that way."""
    steps = np.diff(rising.astype(np.int64), prepend=0).astype(np.uint32)
    return [np.ascontiguousarray(p).tobytes() for p in steps.view(np.uint8).reshape(-1, 4).T]


def ungapped(planes: list[memoryview]) -> np.ndarray:
    steps = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).copy().view(np.uint32).ravel()
    return np.cumsum(steps.astype(np.int64))


def substring_dedup(docs: DataFrame, size: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``, one row per row of ``docs``.

    Words are runs of characters other than white space. A word goes if a window of ``size``
    words covers it whose words also start earlier: in a smaller identifier, or in the same
    document further ahead. Windows are judged on the input. ``kept`` is the remaining text.

    Documents lie in buckets of some megabytes.

    1. Each bucket sends the cells that its windows hit in a count-min sketch, as sorted gaps.
       The sketch is cut into slices; its width follows the size of the input, so its load does not.
       A slice adds up what all buckets sent and answers each with one bit per cell: hit twice or not.
       Hash collisions let too many windows through, but none that is repeated stays out.
    2. Each bucket digests the words of the windows that are estimated to be repeated. Of equal
       windows within the bucket all but the first are repeats; the first goes on to a group by digest,
       so a hot window sends one entry per bucket. In the group all but the first of all are repeats.
    3. Each bucket covers the words of its repeats and returns the rest.

    Nothing goes through the driver but the number of bytes. Texts are shuffled once; the three
    steps read the same exchange. Null texts have no words. A null identifier is the smallest. Rows
    that repeat an identifier are one document in two versions: of equal windows the earlier start
    stays, and both stay where they start at the same word. An empty table gives no rows.
    """
    total = text_bytes(docs)
    buckets = max(tasks(docs.sparkSession), -(-total // BUCKET_BYTES))
    slices = max(1, -(-int(total * CELLS_PER_BYTE) // (1 << CELL_BITS)))
    rows = bucketed(docs, buckets)
    ask_schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("cells", pa.binary())])
    answer_schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("hot", pa.binary())])

    def hit(texts: list[bytes]) -> np.ndarray:
        return np.concatenate([Windows(own, size).hash for _, own in in_steps(texts)])

    def ask(docs: pa.Table) -> pa.Table:
        bucket = docs.column("bucket")[0].as_py()
        hashes = hit(texts_of(docs))
        out: list[tuple] = []
        for r in range(len(ROWS)):
            own, count = np.unique(cells(hashes, r, slices), return_counts=True)
            low = own & np.uint64((1 << CELL_BITS) - 1)
            out += [(r * slices + part, bucket, packed(np.packbits(count[s:e] > 1), *gaps(low[s:e])))
                    for part, s, e in by_slice(own)]
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], [], []], schema=ask_schema)

    def add(asked: pa.Table) -> pa.Table:
        held, count = [], np.zeros(1 << CELL_BITS, np.uint8)
        for bucket, blob in zip(asked.column("bucket").to_pylist(), asked.column("cells").to_pylist(), strict=True):
            twice, *planes = unpacked(blob)
            own = ungapped(planes)
            more = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(own))
            count[own] = np.minimum(count[own] + 1 + more, 2)
            held.append((bucket, own))
        part = asked.column("slice")[0].as_py()
        return pa.table([[b for b, _ in held], [part] * len(held), [packed(np.packbits(count[own] > 1)) for _, own in held]],
                        schema=answer_schema)

    pass_schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("digests", pa.binary()), ("places", pa.binary())])

    def find(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([[], [], [], []], schema=pass_schema)
        docs = ordered(docs)
        texts, bucket = texts_of(docs), docs.column("bucket")[0].as_py()
        hot = dict(zip(answers.column("slice").to_pylist(), answers.column("hot").to_pylist(), strict=True))
        hashes = hit(texts)
        chosen = np.ones(len(hashes), bool)
        for r in range(len(ROWS)):
            own_cells = cells(hashes, r, slices)
            own = np.unique(own_cells)
            flag = np.concatenate([np.unpackbits(np.frombuffer(unpacked(hot[r * slices + part])[0], np.uint8), count=e - s)
                                   for part, s, e in by_slice(own)] or [np.zeros(0, np.uint8)])
            repeated = own[flag > 0]
            if len(repeated):
                spot = np.minimum(np.searchsorted(repeated, own_cells), len(repeated) - 1)
                chosen &= repeated[spot] == own_cells
            else:
                chosen[:] = False
        digests, row, pos, done = [], [], [], 0
        for first, some in in_steps(texts):
            w = Windows(some, size)
            which = np.flatnonzero(chosen[done:done + len(w.at)])
            done += len(w.at)
            digests.append(w.digests(which))
            at = w.at[which]
            row.append(w.doc[at] + first)
            pos.append(at - w.first[w.doc[at]])
        d, row, pos = np.concatenate(digests), np.concatenate(row), np.concatenate(pos)
        if not len(row):
            return pa.table([[], [], [], []], schema=pass_schema)
        did = docs.column("did").to_numpy()[row]
        order = np.lexsort((pos, did, d[:, 1], d[:, 0]))
        d, row, pos, did = d[order], row[order], pos[order], did[order]
        new = np.append(True, (d[1:] != d[:-1]).any(axis=1))
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (did != did[start]) | (pos != pos[start])
        # repeats within the bucket are known; they take the way of the others, whose groups pass them on
        out = [(bucket % buckets, bucket, None, packed(row[later].astype(np.int32), pos[later].astype(np.int32)))]
        firsts = ~later
        d, row, pos, did = d[firsts], row[firsts], pos[firsts], did[firsts]
        part = ((d[:, 0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for p, s, e in zip(part[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            out.append((p, bucket, d[s:e].tobytes(), packed(row[s:e].astype(np.int32), pos[s:e].astype(np.int32), did[s:e])))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=pass_schema)

    gone_schema = pa.schema([("bucket", pa.int32()), ("places", pa.binary())])

    def decide(found: pa.Table) -> pa.Table:
        out, parts = [], []
        for bucket, digests, places in zip(*(found.column(n).to_pylist() for n in ("bucket", "digests", "places")), strict=True):
            if digests is None:
                out.append((bucket, places))
                continue
            row, pos, did = (np.frombuffer(x, t) for x, t in zip(unpacked(places), (np.int32, np.int32, np.int64), strict=True))
            parts.append((np.full(len(row), bucket), np.frombuffer(digests, np.uint64).reshape(-1, 2), row, pos, did))
        if parts:
            bucket, d, row, pos, did = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((pos, did, d[:, 1], d[:, 0]))
            new = np.append(True, (d[order][1:] != d[order][:-1]).any(axis=1))
            start = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = order[(did[order] != did[start]) | (pos[order] != pos[start])]
            later = later[np.argsort(bucket[later], kind="stable")]
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[later]) != 0)) if len(later) else []
            for own in np.split(later, cuts[1:]) if len(later) else []:
                out.append((int(bucket[own[0]]), packed(row[own], pos[own])))
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], []], schema=gone_schema)

    result_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cover(docs: pa.Table, gone: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([[], [], [], []], schema=result_schema)
        docs = ordered(docs)
        lists = [unpacked(b) for b in gone.column("places").to_pylist()]
        row, pos = (np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x[i], np.int32) for x in lists)]) for i in (0, 1))
        order = np.argsort(row, kind="stable")
        row, pos = row[order], pos[order]
        cuts = np.searchsorted(row, np.arange(docs.num_rows + 1)).tolist()
        out = []
        for i, (given, text) in enumerate(zip(docs.column("id").to_pylist(), texts_of(docs), strict=True)):
            words = text.split()
            left = words
            if cuts[i] < cuts[i + 1]:
                starts = pos[cuts[i]:cuts[i + 1]]
                change = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + size, minlength=len(words) + 1)
                left = [words[k] for k in np.flatnonzero(np.cumsum(change[:len(words)]) == 0).tolist()]
            out.append((given, len(words), len(words) - len(left), b" ".join(left).decode()))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=result_schema)

    def ddl(schema: pa.Schema) -> str:
        names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
        return ", ".join(f"{f.name} {names[f.type]}" for f in schema)

    own = rows.groupBy("bucket")
    asked = own.applyInArrow(ask, ddl(ask_schema))
    answers = asked.repartition(buckets, "slice").groupBy("slice").applyInArrow(add, ddl(answer_schema))
    found = own.cogroup(answers.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(find, ddl(pass_schema))
    gone = found.repartition(buckets, "part").groupBy("part").applyInArrow(decide, ddl(gone_schema))
    return own.cogroup(gone.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(cover, ddl(result_schema))
