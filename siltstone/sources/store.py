"""Fact tables as Parquet folders by repository: append, replace, upsert, delete.

A table is rewritten one repository folder at a time (dynamic partition
overwrite), so a change touches only the repositories it names. New columns
are added by writing them; readers merge schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ingest import latest_wins
from siltstone.session import Stage


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(name))

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").partitionBy("repository_id").parquet(self.path(name))

    def get_or_create(self, name: str, df: DataFrame, key: list[str]) -> DataFrame:
        """Appends the rows whose key the table does not hold yet, and returns the
        stored row of every key of `df`."""
        keys = df.dropDuplicates(key)
        stage = Stage(self.spark, "create")
        self.append(name, stage.write(keys.join(self.read(name).select(*key).distinct(), key, "left_anti"), "new"))
        stage.drop()
        return self.read(name).join(keys.select(*key), key, "left_semi")

    def replace(self, name: str, df: DataFrame) -> None:
        """The repositories in `df` are replaced by its rows, others stay."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(self.path(name))

    def upsert(self, name: str, df: DataFrame, key: list[str], keep_first: str | None = None) -> None:
        """New rows win over stored ones with the same key in the repositories
        of `df`; `keep_first` keeps its smallest value."""
        touched = df.select("repository_id").distinct()  # joined as its size asks for
        old = self.read(name).join(touched, "repository_id", "left_semi")
        both = old.withColumn("_v", F.lit(0)).unionByName(df.withColumn("_v", F.lit(1)), allowMissingColumns=True)
        # read whole before the folders are overwritten
        stage = Stage(self.spark, "upsert")
        self.replace(name, stage.write(latest_wins(both, key, ["_v"], keep_first).drop("_v"), "merged"))
        stage.drop()

    def delete_repository(self, repository_id: str, names: list[str]) -> None:
        """Drop the repository's folder of every table."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path(n)}/repository_id={repository_id}")
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
