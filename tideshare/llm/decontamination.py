"""Benchmark passages in documents, found through a distributed positional inverted index."""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideshare.llm.common import NO_ID, batch, packed, row_key, shared_folder, steps, stored, tasks, unpacked

#: Bytes that no word holds become spaces, A-Z become a-z: words are digits, letters and all above ASCII.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in bytes(range(256)).lower())
#: Text of one shard of the index.
SHARD_BYTES = 8 << 20
#: The row of a shard that lists its documents; no word is empty.
DOCUMENTS = b""
#: Hashes of words. A word whose hash no item has is left out of the index.
HASHES = 1 << 20
#: Windows that are looked up at a time, about: a part of the benchmark, which driver and tasks hold.
PART_WINDOWS = 1 << 19
#: Windows and bytes of one piece of an item. Pieces are dealt to parts, so a long item is cut.
PIECE_WINDOWS, PIECE_BYTES = 1 << 12, 1 << 18
#: Pieces that a task hands on at a time.
PIECES = 256


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % HASHES


def asked(hashes: np.ndarray) -> bytes:
    """One bit for each hash of a word."""
    out = np.zeros(HASHES, np.uint8)
    out[hashes] = 1
    return np.packbits(out).tobytes()


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases as term numbers, and which item has which phrase."""

    terms: dict[bytes, int]
    by_size: dict[int, np.ndarray]  # size -> rows of term numbers, distinct
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # size -> item numbers by row, and where those of each row start

    @staticmethod
    def of(texts: list[bytes], window: int) -> Phrases:
        """All windows of each text; a shorter text that has words is one phrase."""
        terms: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        found: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in enumerate(texts):
            own = words_of(text)
            if own:
                ids = np.fromiter(map(terms.__getitem__, own), np.int32, len(own))
                size = min(window, len(ids))
                found.setdefault(size, []).append((item, np.lib.stride_tricks.sliding_window_view(ids, size)))
        by_size, items = {}, {}
        for size, views in found.items():
            rows = np.concatenate([v for _, v in views])
            order = np.lexsort(rows.T)
            rows = rows[order]
            new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
            owner = np.repeat([i for i, _ in views], [len(v) for _, v in views])[order]
            owned = np.unique((np.cumsum(new) - 1) * len(texts) + owner)
            by_size[size] = rows[new]
            items[size] = owned % len(texts), np.searchsorted(owned // len(texts), np.arange(new.sum() + 1))
        return Phrases(dict(terms), by_size, items)


def item_pieces(benchmark: DataFrame, window: int = 13, piece_windows: int = PIECE_WINDOWS) -> DataFrame:
    """``(item_id, text, weight)``: the words of the items, cut so that each window lies in one piece.

    Equal pieces of an item appear once; items without words or identifier have none. ``weight`` is the
    number of windows, with a window more for each 64 bytes.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.string()), ("text", pa.binary()), ("weight", pa.int64())])
        out: list[tuple[str, bytes, int]] = []
        for b in steps(batches):
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = words_of(text.encode())
                ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
                windows = max(len(own) - window + 1, min(len(own), 1))
                at = 0
                while at < windows:
                    fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, side="right"))
                    till = min(max(at + 1, min(at + piece_windows, fit)), windows)
                    piece = b" ".join(own[at:till + window - 1])
                    out.append((item, piece, till - at + len(piece) // 64))
                    at = till
                    if len(out) == PIECES:
                        yield batch(schema, *zip(*out, strict=True))
                        out = []
        if out:
            yield batch(schema, *zip(*out, strict=True))

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna()
    return rows.mapInArrow(cut, "item_id string, text binary, weight long").distinct()


def asked_words(pieces: DataFrame) -> bytes:
    """The hashes that the words of the pieces have, as bits."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hash", pa.int64())])
        for b in steps(batches):
            words = {w for text in b.column("text").to_pylist() for w in text.split()}
            yield batch(schema, np.unique(hashes_of(list(words))))

    found = pieces.select("text").mapInArrow(go, "hash long").distinct().toArrow()  # HASHES numbers at most
    return asked(found.column("hash").to_numpy())


def build_index(docs: DataFrame, words: bytes, id_column: str = "doc_id", marked: bool = False) -> DataFrame:
    """``(shard, term, postings)``: word positions of each term in each shard of documents.

    A shard is some megabytes of documents, whose words are numbered through, with a gap between two
    documents. ``postings`` are the rising positions of the term as differences; the row of the empty term
    lists the documents with their first position and number of words, and a hash of their text if ``marked``.
    Only terms whose hash has a bit in ``words`` are stored.
    """
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("postings", pa.binary())])
        wanted = np.unpackbits(np.frombuffer(words, np.uint8)).view(bool)
        gap = np.full(1, -1, np.int32)
        for number, b in enumerate(steps(batches, SHARD_BYTES)):
            starts, sizes, found, at = [], [], [], 0
            terms: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
            for text in b.column("text").to_pylist():
                own = words_of(text.encode())
                found.append(np.fromiter(map(terms.__getitem__, own), np.int32, len(own)))
                starts.append(at)
                sizes.append(len(own))
                at += len(own) + 1
            names = list(terms)
            stays = np.append(wanted[hashes_of(names)], False)  # the last is for the gap
            every = np.concatenate([x for f in found for x in (f, gap)])
            where = np.flatnonzero(stays[every])
            order = where[np.argsort(every[where], kind="stable")]
            of = every[order]
            cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            keys, lists = [DOCUMENTS], [packed(b.column("did").to_numpy(), np.array(starts, np.int64), np.array(sizes, np.int64),
                                                *(b.column(n).to_numpy() for n in b.schema.names if n == "mark"))]
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)]):
                keys.append(names[of[s]])
                lists.append(np.diff(order[s:e], prepend=0).astype(np.uint32).tobytes())
            shard = TaskContext.get().partitionId() << 32 | number
            yield batch(schema, [shard] * len(lists), keys, lists)

    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(*row_key(id_column)[:1 + marked], text).mapInArrow(
        index, "shard long, term binary, postings binary")


def _documents(blob: bytes) -> tuple[np.ndarray, ...]:
    """Identifiers, first positions, numbers of words and, if stored, marks of the documents of a shard."""
    return tuple(np.frombuffer(x, np.int64) for x in unpacked(blob))


def _starts(phrases: np.ndarray, lists: dict[int, np.ndarray], near: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row of the phrase, starts in the shard, and how many of its terms stand at their place.

    The list of the rarest term, moved by its offset, is intersected with the list of the next rarest,
    and so on. With ``near`` a start needs that many terms: it then holds one of the
    ``size - near + 1`` rarest, whose moved lists are united first and counted against the others.
    """
    size = phrases.shape[1]
    need = size if near is None else min(near, size)
    length = np.zeros(int(phrases.max()) + 1, np.int64)
    for term, own in lists.items():
        if term < len(length):
            length[term] = len(own)
    often = length[phrases]
    none = np.zeros(0, np.int64)
    for row in np.flatnonzero((often > 0).sum(axis=1) >= need).tolist():
        order = np.argsort(often[row], kind="stable").tolist()
        first = order[:size - need + 1]
        at = [lists.get(int(phrases[row, k]), none) - k for k in first]
        at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
        seen = np.zeros(len(at), np.int64)
        for k in order:
            own = lists.get(int(phrases[row, k]), none)
            if len(own):
                spot = np.minimum(np.searchsorted(own, at + k), len(own) - 1)
                seen += own[spot] == at + k
            left = size - 1 - order.index(k)
            keep = seen + left >= need
            at, seen = at[keep], seen[keep]
            if not len(at):
                break
        if len(at):
            yield row, at, seen


def _found(table: pa.Table, phrases: Phrases, near: int | None = None) -> tuple[tuple[np.ndarray, ...], Iterator[tuple]]:
    """The documents of a shard, and (document, first word, words, exact, item numbers) of each match."""
    lists: dict[int, np.ndarray] = {}
    for term, blob in zip(table.column("term").to_pylist(), table.column("postings").to_pylist(), strict=True):
        if term == DOCUMENTS:
            documents = _documents(blob)
        elif (number := phrases.terms.get(term)) is not None:
            lists[number] = np.cumsum(np.frombuffer(blob, np.uint32).astype(np.int64))
    _, starts, sizes, *_ = documents

    def go() -> Iterator[tuple]:
        for size, rows in phrases.by_size.items():
            items, firsts = phrases.items[size]
            for row, at, seen in _starts(rows, lists, near):
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = (doc >= 0) & (at >= starts[doc]) & (at + size <= starts[doc] + sizes[doc])
                owners = items[firsts[row]:firsts[row + 1]].tolist()
                for d, a, full in zip(doc[inside].tolist(), (at - starts[doc])[inside].tolist(), (seen == size)[inside].tolist(), strict=True):
                    yield d, a, size, full, owners

    return documents, go()


def _by_shard(index: DataFrame) -> DataFrame:
    return index.repartition(tasks(index.sparkSession), "shard").groupBy("shard")


def matches(docs: DataFrame, items: list[bytes], window: int = 13, near: int | None = None,
            id_column: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: which word spans hold phrases of which items.

    ``(doc_id, n_words, starts, ends, exact, items)``: a match each in the four arrays; ``starts``
    and ``ends`` are word numbers, ``items`` the number of the item in the given list, ``exact`` false for a
    proximity match (``near`` of the words of a phrase or more at their places). A row without matches has empty
    arrays. A span never leaves its document. Null texts have no words; identifiers may be null or
    repeated; an empty table gives no rows; other columns are not read.
    """
    phrases = Phrases.of(items, window)
    index = stored(build_index(docs, asked(hashes_of(list(phrases.terms))), id_column))

    def search(table: pa.Table) -> pa.Table:
        (ids, _, sizes, *_), spans = _found(table, phrases, near)
        found = {n: [[] for _ in ids] for n in ("starts", "ends", "exact", "items")}
        for d, a, size, full, owners in spans:
            for item in owners:
                found["starts"][d].append(a)
                found["ends"][d].append(a + size)
                found["exact"][d].append(full)
                found["items"][d].append(item)
        kinds = {"starts": pa.int32(), "ends": pa.int32(), "exact": pa.bool_(), "items": pa.int32()}
        return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(sizes),
                         *(pa.array(found[n], pa.list_(k)) for n, k in kinds.items())],
                        names=["doc_id", "n_words", *kinds])

    return _by_shard(index).applyInArrow(
        search, "doc_id long, n_words long, starts array<int>, ends array<int>, exact array<boolean>, items array<int>")


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Rising spans that neither meet nor overlap and cover the same words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


HITS = "shard long, place int, starts array<int>, ends array<int>, items array<string>"


def hits(index: DataFrame, names: list[str], texts: list[bytes], window: int) -> DataFrame:
    """``HITS``, a row per document with exact matches of the given pieces.

    ``place`` is the number of the document in its shard. Only the postings of the words of
    the pieces are moved.
    """
    spark = index.sparkSession
    phrases = Phrases.of(texts, window)
    terms = spark.createDataFrame(pa.table({"term": pa.array([DOCUMENTS, *phrases.terms], pa.binary())}))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        spans: defaultdict[int, set[tuple[int, int]]] = defaultdict(set)
        items: defaultdict[int, set[str]] = defaultdict(set)
        for d, a, size, _, owners in _found(table, phrases)[1]:
            spans[d].add((a, a + size))
            items[d].update(names[i] for i in owners)
        ends = {d: united(own) for d, own in spans.items()}
        return pa.table([pa.array([key[0].as_py()] * len(ends), pa.int64()), pa.array(list(ends), pa.int32()),
                         *(pa.array([[x[k] for x in own] for own in ends.values()], pa.list_(pa.int32())) for k in (0, 1)),
                         pa.array([sorted(items[d]) for d in ends], pa.list_(pa.string()))],
                        names=["shard", "place", "starts", "ends", "items"])

    return _by_shard(index.join(F.broadcast(terms), "term", "left_semi")).applyInArrow(search, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, id_column: str = "doc_id",
                  part_windows: int = PART_WINDOWS, piece_windows: int = PIECE_WINDOWS, marked: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    A word inside any exact match of a window of an item is hit. A document is contaminated when at least
    one word in ``share`` is. Items without words or identifier match nothing; items that repeat an
    identifier count once. With ``marked`` there is a last column ``mark``, a hash of the text, which tells
    rows apart that share an identifier.

    The benchmark is looked up in parts of about ``part_windows`` windows, one after the other, in one
    stored index. Driver and tasks hold one part at a time; what the parts find is united per document.
    """
    spark = docs.sparkSession
    pieces = stored(item_pieces(benchmark, window, piece_windows))
    weight = pieces.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    parts = -(-weight // part_windows)
    index = stored(build_index(docs, asked_words(pieces), id_column, marked))
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    found = spark.createDataFrame([], HITS)
    for part in range(parts):
        own = pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).select("item_id", "text").toArrow()
        if own.num_rows:
            found = stored(hits(index, own.column("item_id").to_pylist(), own.column("text").to_pylist(), window), path)

    def judge(table: pa.Table) -> pa.Table:
        spans: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        items: defaultdict[int, set[str]] = defaultdict(set)
        for blob, place, starts, ends, own in zip(*(table.column(n).to_pylist() for n in ("postings", "place", "starts", "ends", "items")), strict=True):
            if blob is not None:
                ids, _, sizes, *marks = _documents(blob)
            else:
                spans[place] += zip(starts, ends, strict=True)
                items[place].update(own)
        hit = np.array([sum(e - s for s, e in united(spans.get(d, ()))) for d in range(len(ids))], np.int64)
        owners = [sorted(items.get(d, ())) for d in range(len(ids))]
        return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(sizes), pa.array(hit), pa.array(list(map(len, owners)), pa.int64()),
                         pa.array([hashlib.sha256(",".join(o).encode()).hexdigest() for o in owners]),
                         pa.array((hit > 0) & (share * hit >= sizes)), *map(pa.array, marks)],
                        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *["mark"] * marked])

    documents = index.filter(F.col("term") == F.lit(DOCUMENTS)).select("shard", "postings")
    return _by_shard(documents.unionByName(found, allowMissingColumns=True)).applyInArrow(
        judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", mark long" * marked)
