"""Byte-level BPE: merges from a rank file by a bitmap queue of ranks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import batch, process_cache, steps
from tideshare.llm.pieces import Memory


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Buckets of list positions by merge rank; three levels of bitmaps tell which ranks have one."""

    def __init__(self):
        self.bucket: dict[int, list] = {}
        self.top, self.middle, self.low = 0, {}, {}

    def add(self, rank: int, position, put=heappush) -> None:
        if rank in self.bucket:
            put(self.bucket[rank], position)
            return
        self.bucket[rank] = [position]
        a, b = rank >> 12, rank >> 6
        self.low[b] = self.low.get(b, 0) | 1 << (rank & 63)
        self.middle[a] = self.middle.get(a, 0) | 1 << (b & 63)
        self.top |= 1 << a

    def lowest(self) -> int:
        """Find-first-set, level by level."""
        a = (self.top & -self.top).bit_length() - 1
        bits = self.middle[a]
        b = a << 6 | (bits & -bits).bit_length() - 1
        bits = self.low[b]
        return b << 6 | (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        del self.bucket[rank]
        a, b = rank >> 12, rank >> 6
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.middle[a] &= ~(1 << (b & 63))
            if not self.middle[a]:
                self.top &= ~(1 << a)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token of any length.

    Tokens are a linked list over byte positions, pairs wait in a ``RankQueue``, the leftmost of a
    rank first. A merge changes the ranks of two pairs at most; their old entries stay and are
    skipped when they come up. The time is in proportion to the length of the word, but for the
    order within a bucket.
    """
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    rank_at = [get(word[i:i + 2], -1) for i in range(n - 1)] + [-1]
    queue = RankQueue()
    for i, r in enumerate(rank_at):
        if r >= 0:
            queue.add(r, i)
    while queue.top:
        r = queue.lowest()
        bucket = queue.bucket[r]
        i = heappop(bucket)
        if not bucket:
            queue.close(r)
        if rank_at[i] != r:
            continue
        rank_at[after[i]] = -1
        j = after[i] = after[after[i]]
        before[j] = i
        rank_at[i] = get(word[i:after[j]], -1) if j < n else -1
        if rank_at[i] >= 0:
            queue.add(rank_at[i], i)
        if (p := before[i]) >= 0:
            rank_at[p] = get(word[p:j], -1)
            if rank_at[p] >= 0:
                queue.add(rank_at[p], p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:after[i]]])
        i = after[i]
    return ids


class Pairs:
    """Merge rank of two neighbouring tokens, for arrays of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 24 | b] = rank
        self.codes = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[c] for c in self.codes.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 24 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)


def merged_together(words: list[bytes], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many short pre-tokens, one after another, and the ends of each word's ids.

    One linked list and one ``RankQueue`` hold all words; no pair crosses a word. The lowest rank of
    the queue is the lowest of every word that has it, and one round merges the leftmost such
    pair of each of these words, so each word goes the same way as alone.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    total = int(sizes.sum())
    owner = np.append(np.repeat(np.arange(len(words)), sizes), -1)
    token = np.append(pairs.byte[np.frombuffer(b"".join(words), np.uint8)], 0)
    after = np.arange(1, total + 2)
    before = np.arange(-1, total)
    rank_at = np.full(total + 1, -1, np.int64)
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    rank_at[inside] = pairs.rank(token[inside], token[inside + 1])
    queue = RankQueue()

    def push(at: np.ndarray) -> None:
        new = rank_at[at]
        at, new = at[new >= 0], new[new >= 0]
        if len(at):
            order = np.argsort(new, kind="stable")
            at, new = at[order], new[order]
            starts = np.flatnonzero(np.append(True, new[1:] != new[:-1])).tolist()
            for s, e, r in zip(starts, [*starts[1:], len(at)], new[starts].tolist(), strict=True):
                queue.add(r, at[s:e], list.append)

    push(inside)
    while queue.top:
        r = queue.lowest()
        bucket = queue.bucket[r]
        at = np.unique(np.concatenate(bucket))
        at = at[rank_at[at] == r]
        whose = owner[at]
        first = np.append(True, whose[1:] != whose[:-1])[:len(at)]
        if first.all():
            queue.close(r)
        else:
            queue.bucket[r] = [at[~first]]
            at, whose = at[first], whose[first]
        if not len(at):
            continue
        gone = after[at]
        rank_at[gone] = -1
        token[gone] = -1
        right = after[gone]
        after[at] = right
        before[right] = at
        token[at] = r
        follows = owner[right] == whose
        rank_at[at] = -1
        rank_at[at[follows]] = pairs.rank(token[at[follows]], token[right[follows]])
        left = before[at]
        has = (left >= 0) & (owner[left] == whose)
        left = left[has]
        rank_at[left] = pairs.rank(token[left], token[at[has]])
        push(np.concatenate([at, left]))
    kept = np.flatnonzero(token[:-1] >= 0)
    return token[kept], np.cumsum(np.bincount(owner[kept], minlength=len(words)))


#: Longer pre-tokens go through the queue alone.
SHORT = 64


class Coder:
    """Encodes texts and decodes ids; remembers pieces of text."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pairs = Pairs(self.ranks)
        self.tokens = {str(rank): token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.memory = Memory(self.learn)

    def learn(self, new: list[str]) -> list[str]:
        """The ids of each piece, in decimal with single spaces."""
        cut = [[w.encode() for w in self.pattern.findall(p)] for p in new]
        todo = {w for words in cut for w in words}
        done = {w: str(self.ranks[w]) for w in todo if w in self.ranks}
        short = [w for w in todo if w not in done and len(w) <= SHORT]
        done |= {w: " ".join(map(str, merged(w, self.ranks))) for w in todo if w not in done and len(w) > SHORT}
        if short:
            ids, ends = merged_together(short, self.pairs)
            ids = list(map(str, ids.tolist()))
            start = 0
            for w, end in zip(short, ends.tolist(), strict=True):
                done[w] = " ".join(ids[start:end])
                start = end
        return [" ".join([done[w] for w in words]) for words in cut]

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal with single spaces."""
        return list(map(" ".join, self.memory.results(texts)))

    def digests(self, found: list[str], most: int = 1 << 13) -> tuple[int, str, str]:
        """Number of ids, digest of the ids and of the decoded bytes, ``most`` pieces at a time."""
        n, written, back = 0, hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(found), most):
            text = " ".join(found[at:at + most])
            written.update(b" " * (at > 0) + text.encode())
            ids = text.split()
            n += len(ids)
            back.update(self.decode(ids))
        return n, written.hexdigest(), back.hexdigest()

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(path: str, pattern: str) -> Coder:
    return process_cache(f"coder:{path}:{pattern}", lambda: Coder(path, pattern))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)``: token ids of each whole text.

    A null or empty text has no ids; identifiers may be null or repeated; an empty table gives no
    rows; other columns are not read. A task holds the ids of a few megabytes of text at a time.
    """
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in steps(batches):
            yield batch(schema, b.column("doc_id"), [list(map(int, ids.split())) for ids in coder(ranks_path, pattern).encode(b.column("text").to_pylist())])

    return _rows(docs, id_column, text_column).mapInArrow(go, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes)`` of rows as ``encode`` returns them; null ids give no bytes."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])
        for b in batches:
            yield batch(schema, b.column("doc_id"), [coder(ranks_path, pattern).decode(list(map(str, i or []))) for i in b.column("ids").to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(go, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encoded and decoded in one pass.

    Rows as in ``encode``. The digests are of the decimal ids with single spaces and of the decoded bytes.
    """
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        use = coder(ranks_path, pattern)
        for b in steps(batches):
            done = map(use.digests, use.memory.results(b.column("text").to_pylist()))
            yield batch(schema, b.column("doc_id"), *zip(*done, strict=True))

    return _rows(docs, id_column, text_column).mapInArrow(go, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
