"""Repeated byte strings, by a distributed merge sort of suffixes that knows common prefixes.

Only some suffixes are sorted. In each string of ``LENGTH`` bytes the place of the least hash of
``GRAM`` bytes is its anchor; equal strings have it at the same place. Neighbouring strings mostly share
their anchor, so a text has an anchor every forty bytes or so. A suffix starts at an anchor: what follows
up to the end of the last string of that anchor, then what stands before it, read backwards, to the
start of the first. Two equal strings lie in suffixes that agree from the anchor to the ends
of the strings, on both sides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import NO_ID, batch, keyed, packed, planes, steps, tasks, unpacked, unplaned
from tideshare.llm.substring_dedup import mixed, powers, texts_of

#: Bytes of the hashed grams.
GRAM = 20
#: Odd base of their rolling hash.
BASE = 0x5851F42D4C957F2D
#: Text of one bucket of documents, and of one range of the sort.
BUCKET_BYTES = 8 << 20
#: Text that is sorted into one run; longer documents are cut, with an overlap.
RUN_BYTES = 4 << 20
#: Sampled documents, and suffixes of each, per range.
SAMPLE_DOCS, SAMPLE_SUFFIXES = 4, 8
#: Suffixes with a common gram that are compared in memory; strings of larger groups go on by content.
GROUP = 50_000
#: Strings that wait in a task before those that occur again are dropped.
WAITING = 200_000


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbours, from one running sum."""
    up, down = powers(BASE, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    total[1:] = values
    total[1:] += np.uint64(1)
    total[1:] *= up[:-1]
    np.cumsum(total, out=total)
    sums = total[width:] - total[:-width]
    del total
    sums *= down[:len(sums)]
    return mixed(sums)


class Suffixes:
    """The anchored suffixes of some texts, as rows of bytes; all bytes are one higher, 0 is none."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, before = length, length - GRAM
        gap = bytes(length)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = length + np.cumsum(sizes + length) - sizes - length
        data = np.frombuffer(gap + b"".join([x for t in texts for x in (t, gap)]), np.uint8)
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, offsets, 1)
        np.add.at(inside, offsets + sizes, -1)
        data = np.where(np.cumsum(inside[:-1]) > 0, data + 1, 0).astype(np.uint8)
        mask = np.uint64((1 << 24) - 1)
        least = rolling(data, GRAM)
        least &= ~mask
        least |= np.arange(len(least), dtype=np.uint64) & mask
        places, width = length - GRAM + 1, 1
        while 2 * width <= places:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if places > width:
            least = np.minimum(least[:len(least) - (places - width)], least[places - width:])
        change = np.zeros(len(least) + 1, np.int32)
        long = sizes >= length
        np.add.at(change, offsets[long], 1)
        np.add.at(change, (offsets + sizes - length + 1)[long], -1)
        valid = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        anchor = valid + ((least[valid] & mask).astype(np.int64) - valid & (1 << 24) - 1)
        del least
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1))[:len(valid)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(valid))[:len(first)] - 1
        start, end = valid[first], valid[last] + length
        anchor = anchor[first]
        self.after, self.before = end - anchor, anchor - start
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.at = anchor - offsets[self.doc]
        self.rows = np.zeros((len(anchor), length + before), np.uint8)
        if len(anchor):
            self.rows[:, :length] = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(length, np.uint8)), length)[anchor]
            self.rows[:, length:] = np.lib.stride_tricks.sliding_window_view(np.append(data[::-1], np.zeros(before, np.uint8)), before)[len(data) - anchor]
            self.rows[:, :length][np.arange(length) >= self.after[:, None]] = 0
            self.rows[:, length:][np.arange(before) >= self.before[:, None]] = 0

    def keys(self, rows: np.ndarray) -> np.ndarray:
        return rows.view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{rows.shape[1] or 1}")


def parts_of(texts: list[bytes], length: int) -> tuple[list[bytes], list[int], list[int]]:
    """Texts in parts that a run can hold, with the text and the place of each; strings lie in one part."""
    parts, whose, shift = [], [], []
    for i, t in enumerate(texts):
        for s in range(0, max(1, len(t) - length + 1), RUN_BYTES):
            parts.append(t[s:s + RUN_BYTES + length - 1])
            whose.append(i)
            shift.append(s)
    return parts, whose, shift


def front_coded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Bytes shared with the row before, sizes of the rests, and the rests."""
    width = rows.shape[1]
    same = rows[1:] == rows[:-1]
    shared = np.append(0, np.where(same.all(axis=1), width, same.argmin(axis=1))).astype(np.int64)
    shared = np.minimum(shared, sizes)
    column = np.arange(width)
    rest = rows[(column >= shared[:, None]) & (column < sizes[:, None])]
    return shared.astype(np.uint8), (sizes - shared).astype(np.uint8), rest.tobytes()


def compared(a: bytes, b: bytes, known: int) -> tuple[int, bool]:
    """Common prefix of two keys that share ``known`` bytes, and whether a is not larger."""
    while True:
        x, y = a[known:known + 16], b[known:known + 16]
        if x != y:
            differ = int.from_bytes(x.ljust(16, b"\0"), "big") ^ int.from_bytes(y.ljust(16, b"\0"), "big")
            if differ:
                return known + (128 - differ.bit_length() >> 3), x < y
        elif len(x) < 16:
            return known + len(x), True
        known += 16


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """Shared bytes, key and place of each suffix of a run, in order."""
    shared, sizes, rest, doc, at, did, mark = unpacked(blob)
    docs = list(zip(unplaned(did).tolist(), unplaned(mark).tolist(), strict=True))
    rest, place, key = bytes(rest), 0, b""
    for n, size, d, a in zip(bytes(shared), bytes(sizes), unplaned(doc).tolist(), unplaned(at).tolist(), strict=True):
        key = key[:n].ljust(n, b"\0") + rest[place:place + size]
        place += size
        yield n, key, (docs[d][0], a, docs[d])


def merged(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """All suffixes of sorted runs in order, each with the bytes it shares with the one before.

    A loser tree. Each waiting suffix has the number of bytes that it shares with the last winner of
    its match. Of two that meet the one that shares more with the last winner is smaller, without
    looking at it; only on a tie are bytes compared, from the known prefix on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    head: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0 if h else -1 for h in head]  # -1: the run has ended and loses
    loser = [0] * size

    def match(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser remembers what it shares with the winner."""
        if known[i] != known[j]:
            return (i, j) if known[i] > known[j] else (j, i)
        if known[i] < 0:
            return i, j
        shared, first = compared(head[i][1], head[j][1], known[i])
        if not first:
            i, j = j, i
        known[j] = shared
        return i, j

    level = list(range(size))
    while len(level) > 1:
        above = []
        for k in range(0, len(level), 2):
            won, lost = match(level[k], level[k + 1])
            loser[len(level) // 2 + k // 2] = lost
            above.append(won)
        level = above
    best = level[0]
    while known[best] >= 0:
        _, key, place = head[best]
        yield known[best], key, place
        if (following := next(runs[best], None)) is None:
            known[best] = -1
        else:
            head[best] = following
            known[best] = following[0]
        node = (best + size) >> 1
        while node:
            other = loser[node]
            k, o = known[best], known[other]
            if k < o:
                loser[node], best = best, other
            elif k == o and k >= 0:
                best, loser[node] = match(best, other)
            node >>= 1


class Repeats:
    """What one task of the merge finds: spans to remove, and strings that it can't decide."""

    def __init__(self, length: int):
        self.length = length
        self.gone: list[tuple[int, int, int, int]] = []
        self.open: dict[bytes, tuple] = {}

    def remove(self, place: tuple, start: int, end: int) -> None:
        self.gone.append((*place[2], start, end))

    def wait(self, content: bytes, place: tuple, start: int) -> None:
        """One entry per content and earliest place; the others are repeats already."""
        mine = (place[0], start, place)
        held = self.open.setdefault(content, [mine])
        if mine[:2] < held[0][:2]:
            for old in held:
                self.remove(old[2], old[1], old[1] + self.length)
            self.open[content] = [mine]
        elif mine[:2] > held[0][:2]:
            self.remove(place, start, start + self.length)
        elif mine is not held[0]:
            held.append(mine)

    def shape(self, key: bytes) -> tuple[int, int]:
        """Bytes after and before the anchor."""
        end = key.find(0, 0, self.length)
        return (min(len(key), self.length) if end < 0 else end), max(0, len(key) - self.length)

    def whole(self, key: bytes, place: tuple) -> None:
        after, before = self.shape(key)
        self.remove(place, place[1] - before, place[1] + after)

    def group(self, members: list[tuple[int, bytes, tuple]], nearby: list[int], following: int, by_content: bool) -> None:
        """Members share a gram, and each some bytes with the one before; the last ``following`` bytes
        with the one after. ``nearby``: bytes that each may share with suffixes of other ranges."""
        length = self.length
        by_offset: dict[int, list[int]] = {}
        shared = [*(m[0] for m in members), following]
        for i, (_, key, _) in enumerate(members):
            after, before = self.shape(key)
            reach = max(shared[i], shared[i + 1], nearby[i])
            for offset in range(max(length - after, length - reach), before + 1):
                by_offset.setdefault(offset, []).append(i)
        repeated: dict[int, list[int]] = {}
        for offset, own in by_offset.items():
            first: dict[bytes, tuple] = {}
            strings = []
            for i in own:
                _, key, place = members[i]
                content = key[:length - offset] + key[length:length + offset]
                if by_content or length - offset <= nearby[i]:
                    self.wait(offset.to_bytes(1, "big") + content, place, place[1] - offset)
                else:
                    mine = (place[0], place[1])
                    strings.append((i, content, mine))
                    if mine < first.get(content, mine):
                        first[content] = mine
                    else:
                        first.setdefault(content, mine)
            for i, content, mine in strings:
                if first[content] < mine:
                    repeated.setdefault(i, []).append(offset)
        for i, offsets in repeated.items():
            place, offsets = members[i][2], sorted(offsets)
            start = offsets[0]
            for a, b in zip(offsets, [*offsets[1:], -1], strict=True):
                if b != a + 1:  # strings of neighbouring offsets make one span
                    self.remove(place, place[1] - a, place[1] - start + length)
                    start = b


def suffix_dedup(docs: DataFrame, length: int = 100) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, one row per row of ``docs``.

    Texts are bytes. A byte goes if a string of ``length`` bytes covers it that also starts earlier: in
    a smaller identifier, or in the same document further ahead. Strings are judged on the input
    and never cross documents. ``n_spans`` counts the maximal runs removed, ``kept`` is the rest.

    1. Tasks sort the anchored suffixes of some megabytes. Equal ones but the first are repeats
       at once, so a hot text sends one suffix per run. The rest leaves as front-coded runs, cut at
       splitters that a sample of suffixes gives.
    2. Each range merges its runs by a loser tree with known prefixes. The prefix shared with the
       neighbours tells which strings of a suffix can be repeated at all; these are compared within their
       group. Where a group may go on in another range, or is very large, the strings go on by content.
    3. Strings from several ranges meet by content; the first stays.
    4. Buckets of documents take out the spans.

    Null texts count as empty. A null identifier is the smallest. Rows that repeat an identifier are
    one document in two versions: of equal strings the earlier start stays, and both stay where they
    start at the same byte. An empty table gives no rows. Other columns are not read.
    """
    if not GRAM < length < 256 - length + GRAM:
        raise ValueError(f"length must be over {GRAM}, and suffixes shorter than 256 bytes")
    width, spark = 2 * length - GRAM, docs.sparkSession
    total, n_docs = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(tasks(spark), -(-total // BUCKET_BYTES))
    rows = keyed(docs)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary())])
        for b in steps(batches, RUN_BYTES):
            found = Suffixes(parts_of(texts_of(b), length)[0], length)
            step = np.unique(np.linspace(0, len(found.rows) - 1, SAMPLE_SUFFIXES * b.num_rows).astype(int)) if len(found.rows) else []
            yield batch(schema, found.keys(np.ascontiguousarray(found.rows[step])).tolist() if len(step) else [])

    share = max(1, n_docs // (SAMPLE_DOCS * buckets))
    looked = rows.filter(F.pmod(F.xxhash64("mark", "did"), F.lit(share)) == 0).mapInArrow(sample, "key binary")
    keys = sorted({bytes(r["key"]) for r in looked.toArrow().to_pylist()})
    splitters = sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []

    def by_home(did: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Spans by the bucket of their document."""
        home = (did ^ mark) % buckets
        order = np.lexsort((start, did, home))
        cuts = np.flatnonzero(np.diff(home[order])) + 1
        for own in np.split(order, cuts) if len(order) else []:
            yield int(home[own[0]]), packed(*(planes(x[own]) for x in (did, mark, start, end)))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("bucket", pa.int32()), ("run", pa.binary()), ("gone", pa.binary())])
        for b in steps(batches, RUN_BYTES):
            parts, whose, shift = parts_of(texts_of(b), length)
            whose, shift = np.array(whose), np.array(shift)
            did, mark = (b.column(n).to_numpy() for n in ("did", "mark"))
            for s in range(0, len(parts), 1 if b.num_rows == 1 else len(parts)):
                e = len(parts) if b.num_rows > 1 else s + 1
                yield batch(schema, *run(Suffixes(parts[s:e], length), whose[s:e], shift[s:e], did, mark))

    def run(found: Suffixes, whose: np.ndarray, shift: np.ndarray, did: np.ndarray, mark: np.ndarray) -> list[list]:
        doc, at = whose[found.doc], found.at + shift[found.doc]
        order = np.lexsort((at, did[doc]))
        order = order[np.argsort(found.keys(found.rows)[order], kind="stable")]
        table, doc, at, after, before = found.rows[order], doc[order], at[order], found.after[order], found.before[order]
        new = np.append(True, (table[1:] != table[:-1]).any(axis=1))[:len(order)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
        later = (did[doc] != did[doc[first]]) | (at != at[first])
        out = []
        g = np.flatnonzero(later)
        g = g[np.lexsort((at[g], doc[g]))]
        gd, gs, ge = doc[g], at[g] - before[g], at[g] + after[g]
        if len(g):  # overlapping spans of a document make one
            cut = np.flatnonzero(np.append(True, (gd[1:] != gd[:-1]) | (gs[1:] > ge[:-1])))
            gd, gs, ge = gd[cut], gs[cut], np.maximum.reduceat(ge, cut)
            out += [(home, home, None, blob) for home, blob in by_home(did[gd], mark[gd], gs, ge)]
        table, doc, at, sizes = table[~later], doc[~later], at[~later], np.where(before > 0, length + before, after)[~later]
        cuts = [0, *np.searchsorted(found.keys(table), np.array(splitters, f"S{width}"), side="right").tolist(), len(table)]
        for r, (s, e) in enumerate(zip(cuts, cuts[1:])):
            if s < e:
                docs, which = np.unique(doc[s:e], return_inverse=True)
                out.append((r, -1, packed(*front_coded(table[s:e], sizes[s:e]), planes(which), planes(at[s:e]),
                                          planes(did[docs]), planes(mark[docs])), None))
        return list(map(list, zip(*out, strict=True))) if out else [[], [], [], []]

    step_schema = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("strings", pa.binary()), ("gone", pa.binary())])

    def merge(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        low, high = (splitters[r - 1] if r else b""), (splitters[r] if r < len(splitters) else b"")
        found = Repeats(length)
        out = [(home, home, None, blob) for home, blob in zip(table.column("bucket").to_pylist(), table.column("gone").to_pylist(), strict=True) if blob]

        def flush() -> None:
            parts: dict[int, list] = {}
            for content, held in found.open.items():
                parts.setdefault(zlib.crc32(content) % buckets, []).extend((content, *h[2][2], h[1]) for h in held)
            found.open = {}
            for part, own in parts.items():
                contents, did, mark, start = zip(*own, strict=True)
                out.append((part, -1, packed(b"".join(contents), *(planes(np.array(x, np.int64)) for x in (did, mark, start))), None))

        members: list[tuple[int, bytes, tuple]] = []
        nearby: list[int] = []
        split = False  # the group began before the first member

        def close(following: int) -> None:
            nonlocal split
            by_content = split or following >= GRAM
            if by_content or len(members) > 1 or (members and nearby[0] >= GRAM):
                found.group(members, nearby, following, by_content)
                if len(found.open) > WAITING:
                    flush()
            split = following >= GRAM
            members.clear()
            nearby.clear()

        with_low = None
        for shared, key, place in merged([decoded(blob) for blob in table.column("run").to_pylist() if blob]):
            with_low = compared(low, key, 0)[0] if with_low is None else min(with_low, shared)
            if members and key == members[-1][1]:
                last = members[-1][2]
                if place[:2] > last[:2]:
                    found.whole(key, place)
                    continue
                if place[:2] < last[:2]:
                    while members and members[-1][1] == key:
                        shared, _, old = members.pop()
                        nearby.pop()
                        found.whole(key, old)
            elif members and (shared < GRAM or len(members) >= GROUP):
                close(shared if shared >= GRAM else 0)
            members.append((shared, key, place))
            nearby.append(max(with_low, compared(high, key, 0)[0] if key[:GRAM] == high[:GRAM] else 0))
        close(0)
        flush()
        if found.gone:
            out += [(home, home, None, blob) for home, blob in by_home(*np.array(found.gone, np.int64).T)]
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], [], [], []], schema=step_schema)

    gone_schema = pa.schema([("bucket", pa.int32()), ("gone", pa.binary())])

    def decide(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        first: dict[bytes, tuple] = {}
        entries = []
        for home, strings, gone in zip(*(table.column(n).to_pylist() for n in ("bucket", "strings", "gone")), strict=True):
            if gone is not None:
                out.append((home, gone))
                continue
            contents, *numbers = unpacked(strings)
            contents, size = bytes(contents), length + 1
            for k, (did, mark, start) in enumerate(zip(*(unplaned(x).tolist() for x in numbers), strict=True)):
                content = contents[k * size:(k + 1) * size]
                first[content] = min(first.get(content, (did, start)), (did, start))
                entries.append((content, did, mark, start))
        repeats = [(did, mark, start, start + length) for content, did, mark, start in entries if first[content] < (did, start)]
        if repeats:
            out += by_home(*np.array(repeats, np.int64).T)
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], []], schema=gone_schema)

    docs_schema = pa.schema([("bucket", pa.int32()), ("docs", pa.binary())])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by bucket, a few megabytes compressed together."""
        for b in steps(batches, RUN_BYTES):
            did, mark = (b.column(n).to_numpy() for n in ("did", "mark"))
            texts, home, out = texts_of(b), (did ^ mark) % buckets, []
            for own in np.split(order := np.argsort(home, kind="stable"), np.flatnonzero(np.diff(home[order])) + 1):
                mine = [texts[i] for i in own.tolist()]
                out.append((int(home[own[0]]), packed(planes(did[own]), planes(mark[own]), planes(np.array(list(map(len, mine)))), b"".join(mine))))
            yield batch(docs_schema, *zip(*out, strict=True))

    result_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def cover(docs: pa.Table, gone: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([[] for _ in result_schema], schema=result_schema)
        lists = [list(map(unplaned, unpacked(b))) for b in gone.column("gone").to_pylist()]
        did, mark, start, end = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in lists)]) for i in range(4))
        order = np.lexsort((start, mark, did))
        spans: dict[tuple[int, int], list] = {}
        for d, m, s, e in zip(*(x[order].tolist() for x in (did, mark, start, end)), strict=True):
            own = spans.setdefault((d, m), [])
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], e)
            else:
                own.append([s, e])
        out = []
        for blob in docs.column("docs").to_pylist():
            *numbers, plain = unpacked(blob)
            did, mark, sizes = map(unplaned, numbers)
            ends = np.cumsum(sizes)
            for d, m, s, e in zip(did.tolist(), mark.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                text, own = bytes(plain[s:e]), spans.get((d, m), ())
                edges = [0, *(x for span in own for x in span), len(text)]
                kept = b"".join([text[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)])
                out.append((None if d == NO_ID else d, len(text), len(text) - len(kept), len(own), kept))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=result_schema)

    sorted_runs = rows.select("did", "mark", "text").mapInArrow(runs, "range int, bucket int, run binary, gone binary")
    found = sorted_runs.repartition(buckets, "range").groupBy("range").applyInArrow(
        merge, "part int, bucket int, strings binary, gone binary")
    gone = found.repartition(buckets, "part").groupBy("part").applyInArrow(decide, "bucket int, gone binary")
    texts = rows.select("did", "mark", "text").mapInArrow(dealt, "bucket int, docs binary").repartition(buckets, "bucket")
    return texts.groupBy("bucket").cogroup(gone.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(
        cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
