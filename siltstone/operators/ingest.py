"""Incremental ingestion: eligibility of files, manifest diffs and keyed DML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import detect_language

# Directories that are never descended into, name endings of built files, the size cap.
IGNORED_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "vendor", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "dist", "build", "out", ".output", ".svelte-kit", ".turbo", ".parcel-cache", ".vercel", "target", ".next", ".nuxt", ".idea",
    ".vscode", "coverage", ".gradle",
)
BUILT_ENDINGS = (".min.js", ".min.mjs", ".min.cjs", ".min.css", ".bundle.js")
MAX_BYTES = 5_000_000


def in_ignored_dir(path: Column, ignored: tuple[str, ...] = IGNORED_DIRS) -> Column:
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*ignored))


def is_built_name(path: Column, endings: tuple[str, ...] = BUILT_ENDINGS) -> Column:
    low = F.lower(path)
    return reduce(lambda a, b: a | b, [F.endswith(low, F.lit(e)) for e in endings])


def skip_reason(path: Column, size: Column, binary: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is skipped (ignored, unsupported, large, binary), null if it is kept."""
    return (
        F.when(in_ignored_dir(path) | is_built_name(path), "ignored")
        .when(detect_language(path).isNull(), "unsupported")
        .when(size > max_bytes, "large")
        .when(binary, "binary")
    )


def manifest_diff(scan: DataFrame, manifest: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Full outer diff by key: status added, changed, unchanged or removed.
    A null digest on either side counts as changed unless both are null."""
    a = scan.select(*key, F.col(digest).alias("new_hash"), F.lit(True).alias("_new"))
    b = manifest.select(*key, F.col(digest).alias("old_hash"), F.lit(True).alias("_old"))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.equal_null("new_hash", "old_hash"), "unchanged").otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(*key, "old_hash", "new_hash", status.alias("status"))


def index_report(diff: DataFrame, *by: str) -> DataFrame:
    """Counts by status, files indexed and files touched."""
    n = {s: F.count_if(F.col("status") == s) for s in ("added", "changed", "unchanged", "removed")}
    return diff.groupBy(*by).agg(
        *[c.alias(s) for s, c in n.items()],
        (n["added"] + n["changed"] + n["unchanged"]).alias("total_indexed"),
        (n["added"] + n["changed"] + n["removed"]).alias("touched"),
    )


def latest_wins(df: DataFrame, key: list[str], version: list[str], keep_first: str | None = None) -> DataFrame:
    """One row per key, that of the greatest version; with the smallest value
    of `keep_first` if named. Partially aggregated before the shuffle, so a key
    with many versions sends one row per task."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*version)).alias("_row"), *([F.min(keep_first).alias("_first")] if keep_first else [])
    )
    cols = [F.col("_first").alias(c) if c == keep_first else F.col(f"_row.{c}").alias(c) for c in rest]
    return out.select(*key, *cols)


def apply_delta(manifest: DataFrame, scan: DataFrame, key: list[str]) -> DataFrame:
    """The manifest after a scan: scanned rows replace or add, the rest is gone;
    ``created_at`` of rows that stay is kept."""
    old = manifest.select(*key, F.col("created_at").alias("_created"))
    return scan.join(old, key, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")


def cascade_delete(child: DataFrame, gone: DataFrame, foreign_key: str, key: str) -> DataFrame:
    """Rows of `child` whose parent row is not in `gone`."""
    return child.join(gone.select(F.col(key).alias(foreign_key)).distinct(), foreign_key, "left_anti")


def changed_only(current: DataFrame, stored: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Rows whose key and digest are not stored yet: the work left to do."""
    return current.join(stored.select(*key, digest).distinct(), [*key, digest], "left_anti")
