"""Exact duplicates by content sort, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideshare.llm.common import NO_ID, stored, tasks

#: The characters that normalisation deletes.
SPACE = " \t\n\x0b\x0c\r"
#: Leading characters of a text that the splitters see.
LEAD = 32
#: A text with more than one row in this many rows per task is hot.
HOT_SHARE = 4


def normalised(text_column: str = "text") -> Column:
    """The text without white space; a null text counts as empty."""
    return F.translate(F.coalesce(F.col(text_column), F.lit("")), SPACE, "")


def in_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_share: int | None = None) -> DataFrame:
    """``(doc_id, did, length, text_sha256, hot, salt, place, best_did, best_length, size)``, the rows of a run of equals.

    The order of the sort is (leading characters, 64-bit hash, whole normalised text, salt, longest, smallest
    identifier). Splitters are sampled on the leading characters, the hash and the salt, so that no
    text reaches the driver, and the ranges already are what the window asks for: the texts move once. The window
    compares the whole text of each row with that of its neighbour.

    The salt is 0 but for hot texts, which have more than one row in ``hot_share`` (four times the number
    of tasks); there are fewer such hashes than ``hot_share``, which bounds the broadcast. A hot text makes one run per salt.
    """
    spark = docs.sparkSession
    share = hot_share or HOT_SHARE * tasks(spark)
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        normalised(text_column).alias("norm"),
        F.char_length(text).alias("length"),
    ).withColumns({"did": F.coalesce("doc_id", F.lit(NO_ID)), "hash": F.xxhash64("norm"), "lead": F.substring("norm", 1, LEAD)})
    often = max(docs.count() // share, 1)
    hot = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > often).select("hash", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("did", "length"), F.lit(tasks(spark)))).otherwise(0)
    run = W.partitionBy("lead", "hash", "norm", "salt").orderBy(F.desc("length"), "did")
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        rows.join(F.broadcast(hot), "hash", "left")
        .withColumns({"hot": F.coalesce("hot", F.lit(False)), "salt": salt})
        .repartitionByRange(tasks(spark), "lead", "hash", "salt")
        .select("doc_id", "did", "length", F.unhex(F.sha2("norm", 256)).alias("text_sha256"), "hot", "salt",
                F.row_number().over(run).alias("place"),
                F.first("did").over(whole).alias("best_did"),
                F.first("length").over(whole).alias("best_length"),
                F.count(F.lit(1)).over(whole).alias("size"))
    )


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hot_share: int | None = None) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Texts are equal when identical without white space. Rows are range-partitioned by sampled splitters and
    sorted, so equal texts are neighbours and are compared in full (``in_runs``). A hot text lies in
    one run per salt; the first rows of its runs meet by digest, and what they agree on is broadcast to
    the short rows, which are written down before that.

    Of equal texts the one with most code points stays, then the smallest identifier. A null text
    counts as empty; a null identifier counts as the smallest; of rows that repeat identifier and
    text one is kept; an empty table gives no rows. Other columns are not read.
    """
    rows = stored(in_runs(docs, id_column, text_column, hot_share))
    heads = rows.filter("hot and place = 1").groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("length")).alias("shortness"), "did")).alias("best"), F.sum("size").alias("all_size"))
    joined = rows.join(F.broadcast(heads), "text_sha256", "left")
    best_did = F.coalesce("best.did", "best_did")
    best_length = F.coalesce(-F.col("best.shortness"), "best_length")
    return joined.select(
        "doc_id",
        F.when(best_did != NO_ID, best_did).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        ((F.col("place") == 1) & (F.col("did") == best_did) & (F.col("length") == best_length)).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )
