"""Daily counts from a stream of rows, for the batch operators to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideshare.functions.numbers import col


def stream_counts(rows: DataFrame, ts: str, variant: Column | str, series: Column | str,
                  lateness: str = "2 days") -> DataFrame:
    """Count table of a stream: a day is final once the watermark has passed its end.

    Days are cut in the time zone of the session, as in the batch counts. The watermark stands on
    the start of the day, so the day itself is added to the lateness.
    """
    return (
        rows.withColumn("_day", F.date_trunc("day", F.col(ts).cast("timestamp")))
        .withWatermark("_day", f"{lateness} 24 hours")
        .groupBy("_day", col(series).cast("string").alias("series_id"), col(variant).alias("variant"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("series_id", F.to_date("_day").alias("date_from"), F.to_date("_day").alias("date_till"), "variant", "n")
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append final days to a parquet table; the checkpoint folder makes it exactly once."""
    return (
        counts.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
