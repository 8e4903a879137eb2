"""From raw documents to token ids: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.llm.bpe import round_trip
from tideshare.llm.common import NO_ID, row_key, stored, table
from tideshare.llm.decontamination import contamination
from tideshare.llm.exact_dedup import exact_dedup, normalised
from tideshare.llm.simhash import first_of_near
from tideshare.llm.toxicity import with_scores, fit, learnable


def _only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose identifier and text are (``left_semi``) or are not (``left_anti``) in ``rows(did, mark)``."""
    did, mark = row_key()
    keyed = docs.withColumns({"_did": did, "_mark": mark})
    chosen = rows.select(F.col("did").alias("_did"), F.col("mark").alias("_mark")).distinct()
    return keyed.join(chosen, ["_did", "_mark"], how).select(*docs.columns, "_did", "_mark")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under one half. Each row is judged by its own text; null texts are scored as empty."""
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return with_scores(docs, model, "_score").filter("_score < 0.5").drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that the exact dedup keeps; of rows that repeat identifier and text, one."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_kept"))
    same = W.partitionBy("doc_id", "_sha").orderBy(F.desc(F.char_length(F.coalesce("text", F.lit("")))))
    rows = docs.withColumn("_sha", F.sha2(normalised("text"), 256))
    found = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_kept")), "left_semi")
    return found.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1").drop("_copy", "_sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, with the smallest identifier; of rows that repeat identifier and text, one."""
    found = _only(docs, first_of_near(docs, shingle=3, distance=3), "left_semi")
    same = W.partitionBy("_did", "_mark").orderBy("_did")
    return found.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1").drop("_copy", "_did", "_mark")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without contamination. Each row is judged by its own text."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), marked=True).filter("contaminated")
    rows = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "mark")
    return _only(docs, rows, "left_anti").drop("_did", "_mark")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each row, and the digest of what they decode to."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: Learning a classifier has no SQL form; the stages are tested one by one against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
