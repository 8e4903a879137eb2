"""Input contracts. Schema checks raise at once; data checks return a table of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideshare.functions.partitions import is_rgs

BIN_COLUMNS = ["date_from", "date_till"]
PARAM_COLUMNS = ["variant", "date", "c", "k", "qt"]
MAX_TIME_SCALE_BIN = 7


def check_counts(df: DataFrame, series_col: str | None = None) -> None:
    """The first two columns (after an optional series key) are the dates of the bin."""
    fields = [f for f in df.schema.fields if f.name != series_col]
    for field, name in zip(fields[:2], BIN_COLUMNS, strict=True):
        if not isinstance(field.dataType, T.DateType):
            raise ValueError(f"column {field.name} must hold dates")
        if field.name != name:
            raise ValueError(f"column {field.name} must be named {name}")


def check_params(df: DataFrame) -> None:
    if df.columns[:5] != PARAM_COLUMNS:
        raise ValueError(f"columns must start with {', '.join(PARAM_COLUMNS)}")
    if not isinstance(df.schema["date"].dataType, T.DateType):
        raise ValueError("column date must hold dates")


def require_empty(violations: DataFrame) -> None:
    """Raise with the first violation, if there is any."""
    bad = violations.take(1)
    if bad:
        raise ValueError(f"contract violated: {bad[0].asDict()}")


def variant_violations(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ``(series_id, variant)`` names that the counts do not have."""
    return wanted.join(counts.select("series_id", "variant").distinct(),
                       ["series_id", "variant"], "left_anti")


def window_violations(counts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Series whose window is not made of bin edges, or is empty."""
    seen = counts.groupBy("series_id").agg(
        F.max(F.col("date_from") == start).alias("has_start"),
        F.max(F.col("date_till") == end).alias("has_end"),
        F.max(start < end).alias("ordered"),
    )
    return seen.filter(~(F.col("has_start") & F.col("has_end") & F.col("ordered")))


def block_violations(candidates: DataFrame, variants: Column | int) -> DataFrame:
    """Candidates whose ``rgs`` is not a label string over ``variants`` categories."""
    n = F.lit(variants) if isinstance(variants, int) else variants
    problem = (
        F.when(F.size("rgs") != n, "length")
        .when(F.array_max("rgs") > n - 1, "too many blocks")
        .when(F.array_min("rgs") != 0, "lowest label")
        .when(~is_rgs("rgs"), "label order")
    )
    return candidates.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def bin_width_violations(counts: DataFrame) -> DataFrame:
    """Series with bins too wide to estimate time scales."""
    width = counts.groupBy("series_id").agg(
        F.max(F.datediff("date_till", "date_from")).alias("max_width")
    )
    return width.filter(F.col("max_width") >= MAX_TIME_SCALE_BIN)
