"""Reading the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One fact table as Parquet under `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def symbols(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """One row per symbol id. Rows that repeat an id agree on everything except
    ``updated_at``, so columns other than that are de-duplicated by value on the
    id alone, with the smallest value where rows disagree after all."""
    return one_per_id(table(spark, base, "symbols").select("id", *columns))


def files(spark: SparkSession, base: str, *columns: str) -> DataFrame:
    """One row per file id (see `symbols`)."""
    return one_per_id(table(spark, base, "files").select("id", *columns))


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Distinct rows by key: the smallest non-null value of each other column.
    Rows with a null key are left out."""
    rest = [c for c in df.columns if c != key]
    df = df.where(F.col(key).isNotNull())
    if not rest:
        return df.distinct()
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in rest])
