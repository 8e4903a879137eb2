"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places.

Files of a store, all in the folder of ``write_store``:

* ``ids-*.bin``: the ids of one shard, little-endian, two bytes each where the vocabulary allows it,
  else four; documents in ascending order of their identifier, shards too.
* ``lengths-*.bin``: ids per document of that shard, four bytes each, in the same order.
* ``shards/``: Parquet table ``(shard, name, docs, ids, start, width)``; ``start`` counts the ids of all
  shards before it. Only files that this table names belong to the store.
* ``index-*.bin``: minimal perfect hash of one bucket of identifiers, see ``PerfectHash``; ``buckets/``
  is the Parquet table ``(bucket, name, keys)`` of these files.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.llm.common import NO_ID, batch, copy_numbers, process_cache, raw_texts, released, shared_folder, steps, stored, tasks, text_bytes

#: Text that the ids of one shard come from, about. The number of shards follows the size of the input.
SHARD_BYTES = 64 << 20
#: Identifiers in one bucket of the index, about.
BUCKET_KEYS = 1 << 20
#: Ids that a reading task holds at a time; a longer document stands alone.
READ_IDS = 4 << 20
#: Strings between white space that a Python worker remembers in its newer and in its older half.
REMEMBERED = 200_000
#: Fixed value: the split pattern of tokenizers that drop white space, whose matches never cross it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

GOLDEN = 0x9E3779B97F4A7C15
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


# --- encoding ---------------------------------------------------------------------------------

def drops_white_space(path: str) -> bool:
    """Whether strings between ASCII white space can be encoded apart: nothing crosses it or looks beyond."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    before = conf.get("pre_tokenizer") or {}
    first = (before.get("pretokenizers") or [{}])[0]
    split = (first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed"
             and first.get("pattern") == {"Regex": WORD_PATTERN})
    known = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
    norm = conf.get("normalizer")
    parts = norm.get("normalizers", [norm]) if norm else []
    added = all(not any(c.isspace() for c in t["content"]) for t in conf.get("added_tokens") or [])
    return bool(split and added and all(p in known for p in parts))


#: Bytes by how they cut: 0 white space, 1 letters, 2 marks that no alternative of the pattern joins with
#: letters, 3 digits, each a match of its own, 4 all else, next to which nothing is cut.
KIND = np.full(256, 4, np.uint8)
KIND[list(b" \t\n\x0b\x0c\r")] = 0
KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = 2
KIND[list(b"0123456789")] = 3
#: Whether a string may be cut between two kinds.
CUT = np.zeros((5, 5), bool)
CUT[1, 2] = CUT[2, 1] = True
CUT[3, 1:4] = CUT[1:4, 3] = True


class Encoder:
    """Texts to ids by the tokenizers library, without added begin or end tokens.

    Where ``drops_white_space`` holds, texts are lower-cased in A-Z and cut where the pattern cuts
    them anyway, and a string that was encoded before is not encoded again. Texts that hold an added
    token in some spelling are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.apart = drops_white_space(path)
        self.added = [t.content.lower().encode() for t in self.model.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self.dtype = np.dtype("<u2" if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        ids = [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        ends = (np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * self.dtype.itemsize).tolist()
        raw = np.fromiter(chain.from_iterable(ids), self.dtype).tobytes()
        return [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)]

    def _known(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.new.get, words))
        unknown = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = ids = self.old.get(words[i])
            if ids is None:
                unknown.append(i)
            else:
                self.new[words[i]] = ids
        for at in range(0, len(unknown), 10_000):
            some = unknown[at:at + 10_000]
            for i, ids in zip(some, self._ids([words[i].decode() for i in some]), strict=True):
                self.new[words[i]] = found[i] = ids
        if len(self.new) > REMEMBERED:
            self.old, self.new = self.new, {}
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Raw ids of each text, the end id last."""
        end = np.array([self.end_id], self.dtype).tobytes()
        if not self.apart:
            return [ids + end for ids in self._ids(texts.to_pylist())]
        lower = [t.lower() for t in raw_texts(texts)]  # of bytes, so A-Z only
        whole = [i for i, t in enumerate(lower) if any(a in t for a in self.added)]
        for i in whole:
            lower[i] = b""
        out = [ids + end for ids in self._cut(lower)]
        for i, ids in zip(whole, self._ids([texts[i].as_py() for i in whole]) if whole else [], strict=True):
            out[i] = ids + end
        return out

    def _cut(self, texts: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        kind = KIND[raw]
        inside = kind > 0
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | CUT[kind[:-1], kind[1:]]
        start = np.flatnonzero(opens)
        # lengths without white space: bytes inside up to the next start
        offsets = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64)
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        coded = flat.dictionary_encode()
        own = self._known(coded.dictionary.to_pylist())
        count = np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize
        ids, first = np.frombuffer(b"".join(own), self.dtype), np.cumsum(count) - count
        code = coded.indices.to_numpy(zero_copy_only=False)
        length = count[code]
        till = np.cumsum(length)
        at = np.arange(till[-1] if len(till) else 0) + np.repeat(first[code] - (till - length), length)
        tokens = ids[at]
        ends = np.append(0, till)[np.searchsorted(start, np.cumsum(size + 1) - 1)].tolist()
        return [tokens[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]


# --- minimal perfect hash ---------------------------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 bits that depend on every bit of the key and the seed; a bijection for each seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(GOLDEN * (seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to the numbers 0 .. n-1, by levels of bit arrays.

    On each level a key that has a place for itself sets its bit; the others go to the next level.
    The number of a key is the rank of its bit, so that no number stays free. About three bits a key.
    """

    #: Bits of a level per key that reaches it.
    ROOM = 2.0

    def __init__(self, levels: list[np.ndarray]):
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        counts = [np.cumsum(b) for b in self.bits]
        before = np.cumsum([0, *(int(c[-1]) for c in counts)])
        self.ranks = [c + k - 1 for c, k in zip(counts, before, strict=False)]
        self.keys = int(before[-1])

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys, level) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> list[np.ndarray]:
        """The packed bits of each level."""
        levels, left = [], np.unique(keys)
        while len(left):
            size = -(-int(len(left) * cls.ROOM + 1) // 64) * 64
            at = cls.place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
        return levels

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; a key that was not built in has any number or -1."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = self.place(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits that are independent of the places."""
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


RUN = np.dtype([("shard", "<i4"), ("ordinal", "<i4"), ("copies", "<i4"), ("offset", "<i8")])


class Index:
    """One bucket: perfect hash, per number a fingerprint and the first of its runs, then the runs.

    A run is a place in one shard where ``copies`` documents of that key follow each other.
    """

    def __init__(self, raw: bytes):
        head = np.frombuffer(raw, "<i8", 3)
        levels, keys, runs = map(int, head)
        sizes = np.frombuffer(raw, "<i8", levels, 24)
        at, bits = 24 + 8 * levels, []
        for n in sizes.tolist():
            bits.append(np.frombuffer(raw, np.uint8, n, at))
            at += n
        self.hash = PerfectHash(bits)
        self.prints = np.frombuffer(raw, "<u4", keys, at)
        self.first = np.frombuffer(raw, "<i8", keys + 1, at + 4 * keys)
        self.runs = np.frombuffer(raw, RUN, runs, at + 4 * keys + 8 * (keys + 1))

    @staticmethod
    def packed(keys: np.ndarray, runs: np.ndarray) -> bytes:
        """``runs`` holds one row per element of ``keys``; keys may repeat."""
        levels = PerfectHash.build(keys)
        slot = PerfectHash(levels).slots(keys)
        order = np.lexsort((runs["shard"], slot))
        n = int(slot.max()) + 1 if len(slot) else 0
        first = np.searchsorted(slot[order], np.arange(n + 1)).astype("<i8")
        prints = np.zeros(n, "<u4")
        prints[slot] = fingerprint(keys)
        head = np.array([len(levels), n, len(runs), *map(len, levels)], "<i8")
        return b"".join([head.tobytes(), *(x.tobytes() for x in levels), prints.tobytes(), first.tobytes(), runs[order].tobytes()])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which, run)``: numbers of the keys that are in, once per run, and the rows of ``runs``."""
        if not len(self.prints) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        slot = self.hash.slots(keys)
        which = np.flatnonzero((slot >= 0) & (self.prints[slot] == fingerprint(keys)))
        own = slot[which]
        count = self.first[own + 1] - self.first[own]
        till = np.cumsum(count)
        run = np.arange(till[-1] if len(till) else 0) + np.repeat(self.first[own] - (till - count), count)
        return np.repeat(which, count), run


# --- files ------------------------------------------------------------------------------------

def place_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a shared folder."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def written(fs: pyarrow.fs.FileSystem, path: str, parts: list[bytes]) -> None:
    with fs.open_output_stream(path) as out:
        for p in parts:
            out.write(p)


@dataclass
class Store:
    """A store in a folder: the tables that name its files."""

    folder: str
    shards: DataFrame
    buckets: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        return cls(folder, spark.read.parquet(f"{folder}/shards"), spark.read.parquet(f"{folder}/buckets"))


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None,
                id_column: str = "doc_id", text_column: str = "text") -> Store:
    """Encode every text, append ``end_id`` and write the shards and their index.

    Documents are range-partitioned by identifier with splitters from the identifiers alone; the rows
    of an identifier that fills several shards are dealt among them by a hash of text and copy number,
    so neither a hot identifier nor a hot text fills one. Ids are shuffled once, as raw bytes; Spark
    sorts them and each task writes its shards as the rows come. Files have names of their own, and a
    shard counts once its row is in the table: a task that runs again leaves a file that no table names.
    Nothing but the splitters, one number per shard, goes through the driver.

    Null texts are empty and have the end id only. A null identifier is the smallest. Identifiers may
    repeat: their documents stand next to each other. An empty table makes a store without shards.
    Other columns are not read. The folder must be one that ``pyarrow.fs`` can open in the tasks.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    fs, path = place_of(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("did"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    count = max(1, -(-text_bytes(rows) // SHARD_BYTES), min(tasks(spark), rows.count() // 1000))
    shares = F.array(*[F.lit(i / count) for i in range(1, count)]) if count > 1 else None
    splitters = (rows.agg(F.percentile_approx("did", shares, min(100 * count, 1 << 20))).first()[0] or []) if count > 1 else []
    cuts = np.sort(np.array(splitters, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("did", pa.int64()), ("tie", pa.int64()), ("payload", pa.binary())])
        encoder = process_cache(f"encoder:{tokenizer_path}:{end_id}", lambda: Encoder(tokenizer_path, end_id))
        numbered = copy_numbers()
        for b in steps(batches):
            did = b.column("did").to_numpy()
            tie = numbered(b.column("text"), did)
            low, high = np.searchsorted(cuts, did, "left"), np.searchsorted(cuts, did, "right")
            share = (tie >> np.uint64(11)).astype(np.float64) / 2.0**53
            shard = low + ((high - low + 1) * share).astype(np.int64)
            yield batch(schema, shard.astype(np.int32), did, (tie >> np.uint64(1)).astype(np.int64), encoder.encode(b.column("text")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_width = process_cache(f"encoder:{tokenizer_path}:{end_id}", lambda: Encoder(tokenizer_path, end_id)).dtype.itemsize
        fs, path = place_of(folder)
        schema = pa.schema([("did", pa.int64()), ("shard", pa.int32()), ("ordinal", pa.int32()), ("copies", pa.int32()),
                            ("offset", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])
        shard, name, out, lengths, done, keys = None, "", None, [], 0, []

        def finish() -> pa.RecordBatch:
            out.close()
            length = np.concatenate(lengths)
            written(fs, f"{path}/lengths-{name}.bin", [length.astype("<u4").tobytes()])
            did = np.concatenate(keys)
            start = np.flatnonzero(np.append(True, did[1:] != did[:-1]))
            offset = (np.cumsum(length) - length)[start]
            n = len(start)
            copies = np.diff(np.append(start, len(did)))
            none = [None] * n
            runs = batch(schema, did[start], [shard] * n, start, copies, offset, none, none, none, none)
            line = batch(schema, [None], [shard], [None], [None], [None], [name], [len(did)], [int(length.sum())], [encoder_width])
            return pa.Table.from_batches([runs, line]).combine_chunks().to_batches()[0]

        for b in batches:
            part = b.column("shard").to_numpy()
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []
            for s, e in zip(at, [*at[1:], len(part)], strict=True):
                if shard != int(part[s]):
                    if out is not None:
                        yield finish()
                    shard, name, lengths, keys = int(part[s]), f"{int(part[s]):08d}-{uuid.uuid4().hex}", [], []
                    out = fs.open_output_stream(f"{path}/ids-{name}.bin")
                some = b.slice(s, e - s)
                column = some.column("payload")
                for blob in column:
                    out.write(blob.as_buffer())
                lengths.append(pc.binary_length(column).to_numpy().astype(np.int64) // encoder_width)
                keys.append(some.column("did").to_numpy())
        if out is not None:
            yield finish()
        released()

    encoded = rows.mapInArrow(encode, "shard int, did long, tie long, payload binary")
    in_order = encoded.repartition(count, "shard").sortWithinPartitions("shard", "did", "tie")
    made = stored(in_order.mapInArrow(
        write, "did long, shard int, ordinal int, copies int, offset long, name string, docs long, ids long, width int"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = made.filter("name is not null").select(
        "shard", "name", "docs", "ids", "width", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    shards.write.parquet(f"{folder}/shards")
    _write_index(made.filter("name is null").select("did", "shard", "ordinal", "copies", "offset"), folder)
    return Store.open(spark, folder)


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("did"), F.lit(buckets)).cast("int")


def _write_index(runs: DataFrame, folder: str) -> None:
    """One file per bucket of identifiers. A bucket holds one row per identifier and shard."""
    buckets = max(1, -(-runs.count() // BUCKET_KEYS))

    def index(group: pa.Table) -> pa.Table:
        fs, path = place_of(folder)
        keys = group.column("did").to_numpy()
        runs = np.empty(len(keys), RUN)
        for n in RUN.names:
            runs[n] = group.column(n).to_numpy()
        bucket = group.column("bucket")[0].as_py()
        name = f"index-{bucket:08d}-{uuid.uuid4().hex}.bin"
        written(fs, f"{path}/{name}", [Index.packed(keys, runs)])
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "name": [name], "keys": pa.array([len(np.unique(keys))], pa.int64()),
                         "buckets": pa.array([buckets], pa.int32())})

    made = runs.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(
        index, "bucket int, name string, keys long, buckets int")
    made.write.parquet(f"{folder}/buckets")


def lookup(store: Store, keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(did, shard, ordinal, copies, offset)`` of every distinct identifier in ``keys`` that the store has.

    An identifier meets the one index file of its bucket: hash, compare the fingerprint, read the runs;
    the time does not depend on the size of the store. A null identifier is a key like others. One that
    the store does not have gives no row, but for one in 2^32 whose fingerprint agrees.
    """
    spark = keys.sparkSession
    some = store.buckets.select("buckets").first()
    buckets = some[0] if some else 1
    folder = store.folder
    own = keys.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("did")).distinct().withColumn("bucket", bucket_of(buckets))
    # keys of a bucket may be dealt to several tasks: each needs the index file and no other key
    parts = max(tasks(spark), buckets)
    split = F.pmod(F.xxhash64("did", F.lit(1)), F.lit(max(1, parts // buckets))).cast("int")
    asked = own.join(store.buckets.select("bucket", "name"), "bucket").withColumn("split", split)
    schema = pa.schema([("did", pa.int64()), ("shard", pa.int32()), ("ordinal", pa.int32()), ("copies", pa.int32()), ("offset", pa.int64())])

    def find(group: pa.Table) -> pa.Table:
        fs, path = place_of(folder)
        with fs.open_input_file(f"{path}/{group.column('name')[0].as_py()}") as f:
            index = Index(f.read())
        did = group.column("did").to_numpy()
        which, run = index.find(did)
        runs = index.runs[run]
        return pa.table([did[which], *(runs[n].astype(np.int64 if n == "offset" else np.int32) for n in schema.names[1:])], schema=schema)

    return asked.groupBy("bucket", "split").applyInArrow(find, "did long, shard int, ordinal int, copies int, offset long")


def read_documents(store: Store, keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the documents of all identifiers in ``keys``, read from the files.

    Places come from ``lookup``; places of one shard go to one task in file order, which reads what it needs
    in one sweep. ``ids`` is little-endian, four bytes an id; ``start`` counts the ids of all documents before.
    An identifier that repeats in the store gives each of its documents once, however often it is asked for.
    """
    folder = store.folder
    named = store.shards.select("shard", "name", "width", F.col("start").alias("before"))
    places = lookup(store, keys, id_column).join(named, "shard")
    in_order = places.repartition("shard").sortWithinPartitions("shard", "ordinal")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = place_of(folder)
        name, lengths, payload = None, None, None
        for b in batches:
            columns = [b.column(n).to_pylist() for n in ("name", "did", "ordinal", "copies", "offset", "before", "width")]
            out, size = [], 0
            for own, did, ordinal, copies, offset, before, width in zip(*columns, strict=True):
                if own != name:
                    if payload is not None:
                        payload.close()
                    name = own
                    with fs.open_input_file(f"{path}/lengths-{name}.bin") as f:
                        lengths = np.frombuffer(f.read(), "<u4").astype(np.int64)
                    payload = fs.open_input_file(f"{path}/ids-{name}.bin")
                for n in lengths[ordinal:ordinal + copies].tolist():
                    payload.seek(offset * width)
                    ids = np.frombuffer(payload.read(n * width), f"<u{width}").astype("<u4")
                    out.append((None if did == NO_ID else did, before + offset, n, ids.tobytes()))
                    offset, size = offset + n, size + n
                    if size >= READ_IDS:
                        yield batch(schema, *zip(*out, strict=True))
                        out, size = [], 0
            if out:
                yield batch(schema, *zip(*out, strict=True))
        if payload is not None:
            payload.close()
        released()

    return in_order.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
