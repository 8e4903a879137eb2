"""Readers and writers for count, parameter, score and estimate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideshare.operators.counts import to_long
from tideshare.sources.checks import check_counts, check_params

PARAMS_SCHEMA = "variant string, date date, c double, k double, qt double"
SCORES_SCHEMA = "maxll double, num_pars bigint, AIC double"


def read_counts(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None,
                series_col: str | None = None) -> DataFrame:
    """Wide count table to long counts; with ``schema`` the types need no extra pass."""
    wide = read_wide(spark, path, fmt, schema)
    check_counts(wide, series_col)
    return to_long(wide, series_col)


def read_wide(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame:
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter table ``variant, date, c, k, qt``; the first row is the baseline."""
    df = spark.read.option("header", True).schema(PARAMS_SCHEMA).csv(path)
    check_params(df)
    return df


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(SCORES_SCHEMA).csv(path)


def read_estimates(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Any report table written by ``write_table``."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, name: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write ``df`` below ``path`` and return its location."""
    target = f"{path.rstrip('/')}/{name}"
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target)
    return target
