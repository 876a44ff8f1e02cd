"""Shared inputs of the queries, and the same inputs as SQL."""

from pyspark.sql import functions as F

from siltstone.functions.text import HASH_LANGUAGES, SCRIPT_LANGUAGES, TEXT_FORMS, base_name
from siltstone.operators import graph
from siltstone.sources.tables import one_per_id, table


def sym(spark, base, *cols, where=None):
    """One row per symbol, with an empty parent as null. Repeated rows agree on
    all but ``updated_at``, so a condition is applied before they are merged and
    reaches the scan."""
    df = table(spark, base, "symbols")
    if where is not None:
        df = df.where(where)
    if not cols or "parent_id" in cols:
        df = df.withColumn("parent_id", F.when(F.col("parent_id") != "", F.col("parent_id")))
    return one_per_id(df.select("id", *(cols or [c for c in df.columns if c not in ("id", "created_at")])))


def per_symbol(spark, base, **columns):
    """One row per symbol of expressions over its columns, computed where the
    rows are read: wide columns such as the code are not shuffled."""
    df = table(spark, base, "symbols")
    return one_per_id(df.select("id", *[c.alias(n) for n, c in columns.items()]))


def fil(spark, base, *cols):
    df = table(spark, base, "files")
    if not cols or "language" in cols:
        df = df.withColumn("language", F.lower(F.trim("language")))
    return one_per_id(df.select("id", *(cols or [c for c in df.columns if c != "id"])))


def texts(spark, base):
    """Files with contents: repository_id, path, language, content."""
    return fil(spark, base, "repository_id", "path", "language").withColumnRenamed("id", "file_id").join(
        table(spark, base, "file_contents").where("content is not null"), "file_id"
    )


def flat_texts(spark, base):
    """Files with contents in one flat tree: every path is its last part. No import
    of the tables names a file of its own repository, so the modules of all
    repositories meet by file name."""
    return texts(spark, base).withColumn("repository_id", F.lit("all")).withColumn("path", base_name(F.col("path")))


def flat_files(spark, base):
    f = fil(spark, base, "path")
    return f.select(F.lit("all").alias("repository_id"), base_name(F.col("path")).alias("path")).distinct()


def _listed(words):
    return ", ".join(f"'{w}'" for w in words)


def bare(code: str, language: str) -> str:
    """SQL for code without comments and literals."""
    form = {k: "regexp_replace(" + code + ", '" + v.replace("'", "''") + "', ' ', 'g')" for k, v in TEXT_FORMS.items()}
    return (
        f"CASE WHEN lower(trim({language})) IN ({_listed(HASH_LANGUAGES)}) THEN {form['hash']} "
        f"WHEN lower(trim({language})) IN ({_listed(SCRIPT_LANGUAGES)}) THEN {form['script']} ELSE {form['char']} END"
    )


def raw_calls(spark, base):
    """Calls of each symbol; extracted per row, so the code is not shuffled."""
    return graph.extract_calls(table(spark, base, "symbols").where("id is not null")).distinct()


def calls(spark, base):
    return graph.resolved_calls(raw_calls(spark, base), sym(spark, base, "repository_id", "name"))


S = """s AS (SELECT id, min(repository_id) AS repository_id, min(file_id) AS file_id, min(name) AS name, min(type) AS type,
min(language) AS language, min(path) AS path, min(start_line) AS start_line, min(end_line) AS end_line, min(signature) AS signature,
min(visibility) AS visibility, min(nullif(parent_id, '')) AS parent_id, min(code) AS code, min(hash) AS hash, min(decorators) AS decorators,
min(updated_at) AS updated_at FROM symbols WHERE id IS NOT NULL GROUP BY id)"""
FI = """f AS (SELECT id, min(repository_id) AS repository_id, min(path) AS path, min(lower(trim(language))) AS language, min(hash) AS hash,
min(size_bytes) AS size_bytes, min(mtime) AS mtime, min(created_at) AS created_at, min(updated_at) AS updated_at FROM files WHERE id IS NOT NULL GROUP BY id)"""
TX = FI + """, x AS (SELECT f.id AS file_id, f.repository_id, f.path, f.language, c.content FROM f JOIN file_contents c ON c.file_id = f.id WHERE c.content IS NOT NULL)"""
FLAT = """, fx AS (SELECT 'all' AS repository_id, regexp_extract(path, '[^/]*$') AS path, language, content FROM x),
ff AS (SELECT DISTINCT 'all' AS repository_id, regexp_extract(path, '[^/]*$') AS path FROM f)"""
_NOT = ", ".join(f"'{w}'" for w in graph.NOT_CALLS)
CALLS = S + f""", raw AS (SELECT DISTINCT repository_id, id AS caller, name, unnest(regexp_extract_all({bare("code", "language")}, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS callee_name
FROM s WHERE type IN ('function', 'method') AND code IS NOT NULL),
c AS (SELECT repository_id, caller, callee_name FROM raw WHERE callee_name <> name AND callee_name NOT IN ({_NOT})
AND (repository_id, callee_name) IN (SELECT repository_id, name FROM s))"""
INDEG = CALLS + """, d AS (SELECT repository_id, callee_name AS name, count(DISTINCT caller) AS callers FROM c GROUP BY ALL),
deg AS (SELECT s.id, coalesce(d.callers, 0) AS callers FROM s LEFT JOIN d USING (repository_id, name))"""
DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"
BASE = "regexp_extract(path, '[^/]*$')"
