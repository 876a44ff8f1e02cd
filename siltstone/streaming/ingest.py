"""Streaming ingestion: latest version per key, and windowed counts with late data."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.ingest import latest_wins
from siltstone.session import Stage

BUCKETS = 64


def upsert_stream(stream: DataFrame, table: str, key: list[str], version: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Each batch is merged into the Parquet folder `table`, which is partitioned
    by a hash of the key: only the partitions that the batch touches are read and
    overwritten. The greatest version of a key wins, whatever the order of
    arrival, so a batch that is repeated after a failure, and late rows, change
    nothing."""
    spark = stream.sparkSession
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        stage = Stage(spark, "upsert")
        new = stage.write(batch.withColumn("bucket", place), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        old = _folder(spark, table)
        both = new if old is None else old.where(F.col("bucket").isin(touched)).unionByName(new, allowMissingColumns=True)
        merged = stage.write(latest_wins(both, ["bucket", *key], [version]), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)
        stage.drop()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, table: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(table)
    except AnalysisException:  # nothing is there yet
        return None


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of a folder written by `upsert_stream`, null before the first batch."""
    df = _folder(spark, table)
    return None if df is None else df.drop("bucket")


def windowed_counts(events: DataFrame, stamp: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per window and type, late rows accepted up to the watermark."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, size), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n"
    )
