"""Helpers that the corpus operators share: tables, shared storage, row batches, buckets."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row without an identifier is ordered before all others.
NO_ID = -(2**63)
#: Text that one step of a task works on at a time.
STEP_BYTES = 4 << 20
#: Text that one bucket of documents holds, about.
BUCKET_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one, a folder below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_tables"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage; the files outlive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write as compressed Parquet to the shared folder and read back; to a given path rows are added."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one sum over a column scan."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def row_key(id_column: str = "doc_id") -> list[Column]:
    """``did`` and ``mark``: identifiers with an order, and a mark that tells rows apart that repeat one with another text."""
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("did"),
            F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark")]


def keyed(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, did, mark, text)``: texts without nulls, identifiers with an order, a mark per text.

    ``mark`` tells rows apart that repeat an identifier with another text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("did"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
    )


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """``keyed`` rows dealt to buckets by identifier and text, so that no hot value fills one."""
    rows = keyed(docs)
    bucket = F.pmod(F.xxhash64("did", "mark"), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).repartition(buckets, "bucket")


def bucket_count(docs: DataFrame) -> int:
    return max(tasks(docs.sparkSession), -(-text_bytes(docs) // BUCKET_BYTES))


def steps(batches: Iterator[pa.RecordBatch], most: int = STEP_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in record batches of about ``most`` bytes of text; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(batch.column(column).cast(pa.large_binary()).buffers() and
                                    pa.compute.binary_length(batch.column(column)).fill_null(0)))
        at, done = 0, 0
        while at < batch.num_rows:
            till = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, till - at)
            at, done = till, int(ends[till - 1])
    released()


def released() -> None:
    """Give memory that this Python worker no longer needs back; the worker lives on for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def raw_texts(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def copy_numbers() -> Callable[[pa.Array, np.ndarray], np.ndarray]:
    """A function that gives each row of a task 64 bits by its text, a number and how often it came before.

    Equal rows of a task get different bits, so that they can be dealt apart, and all rows of the task
    get the same set of bits in whatever order they come.
    """
    seen: dict[tuple[int, int], int] = {}

    def bits(texts: pa.Array, numbers: np.ndarray) -> np.ndarray:
        out = np.empty(len(texts), np.uint64)
        for i, (text, number) in enumerate(zip(raw_texts(texts), numbers.tolist(), strict=True)):
            key = (xxhash.xxh3_64_intdigest(text), number)
            seen[key] = copy = seen.get(key, -1) + 1
            out[i] = xxhash.xxh3_64_intdigest(b"%d %d" % (number, copy), seed=key[0])
        return out

    return bits


def process_cache(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as this Python worker."""
    held = sys.__dict__.setdefault("_tideshare_held", {})
    if name not in held:
        held[name] = make()
    return held[name]


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays in one compressed value: their count and lengths, then their bytes."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpacked(blob: bytes) -> list[memoryview]:
    plain = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    count = int(np.frombuffer(plain, np.int64, 1)[0])
    sizes = np.frombuffer(plain, np.int64, count, 8)
    ends = 8 * (count + 1) + np.cumsum(sizes)
    return [plain[int(e - s):int(e)] for s, e in zip(sizes, ends, strict=True)]


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compress better that way."""
    return np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(blob: memoryview) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
