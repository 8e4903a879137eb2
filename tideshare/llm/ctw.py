"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each of the 255 places in a byte (the bits so far) has a context
tree of its own: its nodes are the last 0, 1, ... ``DEPTH`` bytes. A node holds how often the
decision was 0 and 1 and the Krichevsky-Trofimov estimate of them; its weighted
probability is half its own estimate and half the product of its children. After training the counts
stand still, and the probability of a bit mixes the estimates of all depths of its path by the weights
that the training data gave them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import bucketed, packed, planes, stored, tasks, text_bytes, unpacked, unplaned

#: Bytes of context of the deepest nodes.
DEPTH = 4
#: Text of one bucket of documents.
BUCKET_BYTES = 8 << 20
#: Stands before the first and after the last byte of a text; UTF-8 has no such byte.
EDGE = b"\xff"
#: Codes that are ranked by a table of counts instead of a sort, per position.
DENSE = 4
GRAMS, WORDS, TOPS = 0, 1, 2
LOWER = bytes(range(256)).lower()
LOG_HALF = float(np.log(0.5))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: Stirling's series, eight steps up."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability of nodes, and the share of their own estimate in it."""
    both = np.logaddexp(own, children) + LOG_HALF
    return both, np.exp(own + LOG_HALF - both)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes of (context, byte); for each position its code's rank and its document."""
    data = np.frombuffer(b"".join([x for t in texts for x in (EDGE * DEPTH, t, EDGE)]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    start = np.arange(len(doc)) + doc * DEPTH  # of the context of each position
    rank, codes = data[start].astype(np.int64), np.arange(256, dtype=np.int64)
    for k in range(1, DEPTH + 1):
        code = rank << 8 | data[start + k]
        if len(codes) << 8 <= max(DENSE * len(code), 1 << 20):
            present = np.flatnonzero(np.bincount(code, minlength=len(codes) << 8))
            place = np.zeros(len(codes) << 8, np.int32)
            place[present] = np.arange(len(present), dtype=np.int32)
            rank = place[code].astype(np.int64)
        else:
            present, rank = np.unique(code, return_inverse=True)
        codes = codes[present >> 8] << 8 | present & 255
    return codes, rank, doc


def gram_slices(codes: np.ndarray, slices: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the codes by slice, and (slice, first, last) of each run.

    A slice has all codes of some contexts of two bytes, so their whole subtrees.
    """
    near = (codes >> 8 & 0xFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part = ((near >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return order, list(zip(part[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True))


def subtrees(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Depths ``DEPTH`` to 2 of all codes of a slice.

    Returns the probability of each bit of each code as seen at depth 2, and for each (last
    byte, place) the counts and the sum of the log probabilities of the nodes at depth 2.
    """
    seen = np.empty((len(codes), 8), np.float32)
    top = []
    for k in range(8):
        place = 1 << k | (codes & 255) >> (8 - k)
        bit = (codes >> (7 - k) & 1).astype(bool)
        below = None
        for depth in range(DEPTH, 1, -1):
            node = (codes >> 8 & (1 << 8 * depth) - 1) << 8 | place
            names, which = np.unique(node, return_inverse=True)
            ones = np.bincount(which, counts * bit, len(names))
            zeros = np.bincount(which, counts * ~bit, len(names))
            own = log_estimate(zeros, ones)
            guess = (np.where(bit, ones[which], zeros[which]) + 0.5) / (zeros + ones + 1)[which]
            if below is None:
                total, chance = own, guess
            else:
                parent = (below >> 8 & (1 << 8 * depth) - 1) << 8 | below & 255
                total, share = weighted(own, np.bincount(np.searchsorted(names, parent), total, len(names)))
                chance = share[which] * guess + (1 - share[which]) * chance
            below = names
        seen[:, k] = chance
        group, which = np.unique(names & 0xFFFF, return_inverse=True)
        top.append((group, *(np.bincount(which, x, len(group)) for x in (zeros, ones, total))))
    return seen, tuple(map(np.concatenate, zip(*top, strict=True)))


class Top:
    """Depths 1 and 0, which all slices share: at most 65536 nodes."""

    def __init__(self, place: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.zeros, self.ones, logs = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
        self.zeros[place], self.ones[place], logs[place] = zeros, ones, below
        total, self.share = weighted(log_estimate(self.zeros, self.ones), logs)
        self.root_zeros, self.root_ones, logs = (x.reshape(256, 256).sum(axis=0) for x in (self.zeros, self.ones, total))
        _, self.root_share = weighted(log_estimate(self.root_zeros, self.root_ones), logs)

    def log10(self, codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Log probability of the byte of each code, given the chances of its bits at depth 2."""
        out = np.zeros(len(codes))
        for k in range(8):
            place = 1 << k | (codes & 255) >> (8 - k)
            bit = (codes >> (7 - k) & 1).astype(bool)
            chance = seen[:, k].astype(np.float64)
            for node, zeros, ones, share in (((codes >> 8 & 255) << 8 | place, self.zeros, self.ones, self.share),
                                             (place, self.root_zeros, self.root_ones, self.root_share)):
                guess = (np.where(bit, ones[node], zeros[node]) + 0.5) / (zeros[node] + ones[node] + 1)
                chance = share[node] * guess + (1 - share[node]) * chance
            out += np.log10(chance)
        return out


def score_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)``, one row per row.

    Trained on rows whose crc32 of the identifier as text, mod 7, is not 2. ``score`` is the log10
    probability of the bytes of the text and of its end, ``bits_per_byte`` the code length that it stands for, over
    the bytes and the end. ``base_score`` is that of a smoothed word count model over lower-case words and one end.

    Documents lie in buckets of some megabytes. A bucket sends its distinct codes of five bytes and
    its distinct words, with their training counts, to slices; a slice adds up and builds its subtrees.
    The two top levels (at most 65536 nodes) are added up over the slices and handed to all. Then each
    slice answers each bucket what the bucket asked for, and the bucket scores its documents. Counts are
    exact and cover all training rows; no table of the whole model exists in one place.

    A null text counts as empty; a null identifier is trained on; repeated rows count as often as they
    occur; an empty table gives no rows. Other columns are not read.
    """
    total = text_bytes(docs)
    buckets = max(tasks(docs.sparkSession), -(-total // BUCKET_BYTES))
    rows = bucketed(docs, buckets)
    ask_schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("asked", pa.binary())])
    empty = pa.table([[], [], [], []], schema=ask_schema)

    def in_order(docs: pa.Table) -> tuple[pa.Table, list[bytes], np.ndarray]:
        docs = docs.sort_by([("did", "ascending"), ("mark", "ascending")])
        learned = np.array([not held_out(i) for i in docs.column("id").to_pylist()], bool)
        return docs, docs.column("text").cast(pa.large_binary()).to_pylist(), learned

    def word_slices(texts: list[bytes], learned: np.ndarray) -> Iterator[tuple[int, list[bytes], Counter]]:
        count: Counter = Counter()
        others: set[bytes] = set()
        for text, use in zip(texts, learned.tolist(), strict=True):
            words = text.translate(LOWER).split()
            count.update(words) if use else others.update(words)
        lists: dict[int, list[bytes]] = {}
        for w in sorted(others.union(count)):
            lists.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for part, own in lists.items():
            yield part, own, count

    def ask(docs: pa.Table) -> pa.Table:
        docs, texts, learned = in_order(docs)
        bucket = docs.column("bucket")[0].as_py()
        codes, rank, doc = grams(texts)
        counts = np.bincount(rank, learned[doc], len(codes)).astype(np.int64)
        order, runs = gram_slices(codes, buckets)
        out = [(part, bucket, GRAMS, packed(planes(np.diff(codes[order[s:e]], prepend=0)), planes(counts[order[s:e]]))) for part, s, e in runs]
        for part, own, count in word_slices(texts, learned):
            out.append((part, bucket, WORDS, packed(b" ".join(own), planes(np.array([count[w] for w in own], np.int64)))))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=ask_schema)

    def gram_requests(asked: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for bucket, kind, blob in zip(*(asked.column(n).to_pylist() for n in ("bucket", "kind", "asked")), strict=True):
            if kind == GRAMS:
                steps, counts = map(unplaned, unpacked(blob))
                out.append((bucket, np.cumsum(steps), counts))
        return out

    merge_schema = pa.schema([("slice", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("held", pa.binary()),
                              ("words", pa.int64()), ("occurrences", pa.int64())])

    def merge(asked: pa.Table) -> pa.Table:
        part, out = asked.column("slice")[0].as_py(), []
        if requests := gram_requests(asked):
            codes, which = np.unique(np.concatenate([c for _, c, _ in requests]), return_inverse=True)
            counts = np.bincount(which, np.concatenate([n for _, _, n in requests]), len(codes))
            seen, top = subtrees(codes, counts)
            out.append((part, -1, GRAMS, packed(codes, seen), 0, 0))
            out.append((part, -1, TOPS, packed(top[0].astype(np.int64), *top[1:]), 0, 0))
        lists = []
        total: Counter = Counter()
        for bucket, kind, blob in zip(*(asked.column(n).to_pylist() for n in ("bucket", "kind", "asked")), strict=True):
            if kind == WORDS:
                words, counts = unpacked(blob)
                words = bytes(words).split(b" ")
                lists.append((bucket, words))
                for w, n in zip(words, unplaned(counts).tolist(), strict=True):
                    total[w] += n
        for bucket, words in lists:
            out.append((part, bucket, WORDS, packed(planes(np.array([total[w] for w in words], np.int64))), 0, 0))
        known = [n for n in total.values() if n]
        out.append((part, -1, WORDS, None, len(known), sum(known)))
        return pa.table(list(map(list, zip(*out, strict=True))), schema=merge_schema)

    asked = stored(rows.groupBy("bucket").applyInArrow(ask, "slice int, bucket int, kind int, asked binary"))
    merged = stored(asked.repartition(buckets, "slice").groupBy("slice").applyInArrow(
        merge, "slice int, bucket int, kind int, held binary, words long, occurrences long"))

    def open_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("held").to_pylist():
                place, *sums = (np.frombuffer(x, t) for x, t in zip(unpacked(blob), (np.int64, *[np.float64] * 3), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(place), *map(pa.array, sums)], names=["place", "zeros", "ones", "below"])

    tops = merged.filter(F.col("kind") == TOPS).select("held").mapInArrow(
        open_tops, "place long, zeros double, ones double, below double").groupBy("place").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow().sort_by("place")
    top = Top(*(tops.column(n).to_numpy() for n in ("place", "zeros", "ones", "below")))
    is_learned = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2, F.lit(True))
    ends = docs.filter(is_learned).count()
    n_words, n_seen = merged.filter(F.col("bucket") == -1).agg(
        F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("occurrences"), F.lit(0))).first()
    distinct, train_tokens = n_words + (ends > 0), n_seen + ends
    whole = train_tokens + distinct + 1
    answer_schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("slice", pa.int32()), ("held", pa.binary())])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            codes, seen = unpacked(held.column("held")[0].as_py())
            codes = np.frombuffer(codes, np.int64)
            logs = top.log10(codes, np.frombuffer(seen, np.float32).reshape(-1, 8)).astype(np.float32)
            for bucket, own, _ in gram_requests(asked):
                out.append((bucket, GRAMS, asked.column("slice")[0].as_py(), packed(logs[np.searchsorted(codes, own)])))
        return pa.table(list(map(list, zip(*out, strict=True))) if out else [[], [], [], []], schema=answer_schema)

    gram_asks = asked.filter(F.col("kind") == GRAMS).repartition(buckets, "slice").groupBy("slice")
    gram_held = merged.filter(F.col("kind") == GRAMS).select("slice", "held").repartition(buckets, "slice").groupBy("slice")
    answers = gram_asks.cogroup(gram_held).applyInArrow(answer, "bucket int, kind int, slice int, held binary").unionByName(
        merged.filter((F.col("kind") == WORDS) & (F.col("bucket") >= 0)).select("bucket", "kind", "slice", "held"))
    result_schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                               ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()),
                               ("bits_per_byte", pa.float64())])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([[] for _ in result_schema], schema=result_schema)
        docs, texts, learned = in_order(docs)
        got = {(k, s): h for k, s, h in zip(*(answers.column(n).to_pylist() for n in ("kind", "slice", "held")), strict=True)}
        codes, rank, doc = grams(texts)
        order, runs = gram_slices(codes, buckets)
        logs = np.empty(len(codes))
        for part, s, e in runs:
            logs[order[s:e]] = np.frombuffer(unpacked(got[GRAMS, part])[0], np.float32)
        scores = np.bincount(doc, logs[rank], len(texts))
        count: dict[bytes, int] = {}
        for part, own, _ in word_slices(texts, learned):
            count.update(zip(own, unplaned(unpacked(got[WORDS, part])[0]).tolist(), strict=True))
        n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
        known, base, size = [], [], []
        for text in texts:
            c = np.array([*map(count.__getitem__, text.translate(LOWER).split()), ends], np.float64)
            size.append(len(c))
            known.append(int((c > 0).sum()))
            base.append(float(np.log10((c + 1) / whole).sum()))
        return pa.table([docs.column("id").cast(pa.int64()), pa.array(~learned), pa.array(size), pa.array(known),
                         pa.array(np.full(len(texts), train_tokens)), pa.array(base), pa.array(scores), pa.array(n_bytes),
                         pa.array(-scores * np.log2(10) / (n_bytes + 1))], schema=result_schema)

    return rows.groupBy("bucket").cogroup(answers.repartition(buckets, "bucket").groupBy("bucket")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
               "n_bytes long, bits_per_byte double")
