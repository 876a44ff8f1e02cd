"""Session helpers: building a local session and cutting lineage in a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    conf = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session sets none and runs on this machine alone (tests, a
    laptop) a folder of this machine is made, and kept for the session.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    where = spark.conf.get("siltstone.shared.dir", conf)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("siltstone.shared.dir", where)
    return where.rstrip("/")


class Stage:
    """Tables written during one query into the shared folder, to cut lineage.

    A written table survives the loss of executors and can be read many times
    without running its plan again. ``drop`` removes a table that no later
    step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/siltstone/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def partitions_for(spark: SparkSession, units: float, per_partition: float) -> int:
    """Partitions so that each holds about `per_partition` units; never fewer
    than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(units / per_partition) + 1)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session whose workers would
    not find it: neither PYTHONPATH nor the working directory leads to it."""
    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    ways = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or root.parent in [*ways, Path.cwd().resolve()]:
        return
    target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
