"""Scanning a source tree into rows: path, language, size, time, hash, content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import blake2b_bytes, detect_language
from siltstone.operators.ingest import MAX_BYTES, in_ignored_dir, is_built_name

PROBE = 1 << 16


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """Ignore patterns of a root ``.gitignore`` as (regular expression, ignored),
    in order; the last that matches decides, a ``!`` takes a path back."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^]]*\])", line.lstrip("/")):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") else re.escape(part))
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", not keep))
    return out


def ignored_by(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last matching rule ignores a path; stays inside the JVM."""
    out = F.lit(False)
    for pattern, ignored in rules:
        out = F.when(F.rlike(path, F.lit(pattern)), F.lit(ignored)).otherwise(out)
    return out


IGNORE_FILES = (".gitignore", ".git/info/exclude")


def root_ignores(spark: SparkSession, root: str) -> str:
    """The ignore files of a tree's root, in the order they apply; those of
    folders below are not read."""
    jvm, out = spark.sparkContext._jvm, []
    for name in IGNORE_FILES:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):  # one small file, and a hidden one, which readers of tables pass over
            stream = fs.open(path)
            try:
                out.append(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
    return "\n".join(out)


def scan_tree(spark: SparkSession, root: str, gitignore: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every file under `root` with ``path, language, size_bytes, mtime, hash,
    content, skip_reason``. The reason is ignored, unsupported, large or binary
    for files that are left out, and null for those that are kept; a hash and
    content exist only for kept files. The rules are `gitignore` or, where that is
    null, the ignore files of the root; an empty text ignores nothing. Size and time come from the listing, so
    a filter on them reads no content."""
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    bare = base.removeprefix("file://").removeprefix("file:")
    f = f.withColumn("path", F.substring("path", F.instr("path", bare) + len(bare), F.length("path")))
    binary = F.instr(F.decode(F.substring("content", 1, PROBE), "ISO-8859-1"), "\0") > 0
    rules = ignore_rules(root_ignores(spark, root) if gitignore is None else gitignore)
    reason = (
        F.when(in_ignored_dir(F.col("path")) | ignored_by(F.col("path"), rules) | is_built_name(F.col("path")), "ignored")
        .when(detect_language(F.col("path")).isNull(), "unsupported").when(F.col("length") > max_bytes, "large").when(binary, "binary")
    )
    kept = F.col("skip_reason").isNull()
    return f.withColumn("skip_reason", reason).select(
        "path", detect_language(F.col("path")).alias("language"), F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"),
        F.when(kept, blake2b_bytes("content")).alias("hash"), F.when(kept, F.make_valid_utf8(F.col("content").cast("string"))).alias("content"), "skip_reason",
    )


def skip_counters(scan: DataFrame) -> DataFrame:
    """Files by skip reason, kept for those without one."""
    return scan.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
