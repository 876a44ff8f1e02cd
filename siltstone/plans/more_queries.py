"""Extraction, enrichment, comprehension look-ups, answers and event windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import enrich as E
from siltstone.operators.extract import extract_symbols
from siltstone.operators.graph import contains_edges
from siltstone.operators.retrieval import graph_signal
from siltstone.operators.search import row_numbers, top_per
from siltstone.operators.search import symbol_search as symbol_search_op
from siltstone.plans.graph_queries import EDGES
from siltstone.plans.registry import query
from siltstone.plans.views import DIR, S, fil, sym, texts
from siltstone.sources.tables import table
from siltstone.streaming.ingest import windowed_counts


@query("extract_symbols")
def extracted_symbols(spark, base):
    return extract_symbols(texts(spark, base))


@query("extract_symbol_counts")
def extract_symbol_counts(spark, base):
    return extract_symbols(texts(spark, base)).groupBy("language", "type").agg(F.count("*").alias("n"))


@query("symbols_ordered", f"WITH {S} SELECT id, row_number() OVER (PARTITION BY repository_id ORDER BY path, start_line, id) AS seq FROM s")
def symbols_ordered(spark, base):
    s = sym(spark, base, "repository_id", "path", "start_line")
    return row_numbers(s, ["repository_id"], ["path", "start_line", "id"]).select("id", "seq")


@query("symbols_for_file", f"WITH {S} SELECT file_id, count(*) AS n, array_to_string(list_transform(list_sort(list(struct_pack(a := start_line, b := id, c := name))), lambda x: x.c), ',') AS names FROM s GROUP BY 1")
def symbols_for_file(spark, base):
    s = sym(spark, base, "file_id", "start_line", "name")
    names = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", "name"))), lambda x: x["name"])
    return s.groupBy("file_id").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("names"))


@query("pk_get", f"WITH {S} SELECT id, name, type, path FROM s WHERE id = (SELECT min(id) FROM symbols)")
def pk_get(spark, base):
    s = table(spark, base, "symbols")
    first = s.agg(F.min("id").alias("id"))
    return s.join(F.broadcast(first), "id", "left_semi").groupBy("id").agg(*[F.min(c).alias(c) for c in ("name", "type", "path")])


@query("explain_module", f"WITH {S} SELECT repository_id, path, type || ' ' || name || ' (line ' || start_line || ')' AS detail FROM s WHERE (repository_id, path) IN (SELECT repository_id, min(path) FROM s GROUP BY 1)")
def explain_module(spark, base):
    s = sym(spark, base, "repository_id", "path", "type", "name", "start_line")
    first = s.groupBy("repository_id").agg(F.min("path").alias("path"))
    detail = F.concat("type", F.lit(" "), "name", F.lit(" (line "), F.col("start_line").cast("string"), F.lit(")"))
    return s.join(first, ["repository_id", "path"], "left_semi").select("repository_id", "path", detail.alias("detail"))


@query("understanding_lookup", f"WITH {S}, m AS (SELECT repository_id, path, count(*) AS n FROM s GROUP BY 1, 2) SELECT r.id, m.path, m.n, m.path IS NOT NULL AS available FROM repositories r LEFT JOIN m ON m.repository_id = r.id")
def understanding_lookup(spark, base):
    m = sym(spark, base, "repository_id", "path").groupBy(F.col("repository_id").alias("id"), "path").agg(F.count("*").alias("n"))
    return table(spark, base, "repositories").select("id").join(m, "id", "left").withColumn("available", F.col("path").isNotNull())


@query("known_summaries", "SELECT doc_id, title FROM documents WHERE title IS NOT NULL AND title <> 'Unknown'")
def known_summaries(spark, base):
    return table(spark, base, "documents").where("title is not null and title <> 'Unknown'").select("doc_id", "title")


@query("llm_overlay", "SELECT doc_id, coalesce(nullif(title, 'Unknown'), 'Untitled ' || coalesce(source, '?')) AS summary FROM documents WHERE doc_id IS NOT NULL")
def llm_overlay(spark, base):
    d = table(spark, base, "documents").where("doc_id is not null")
    plain = d.select("doc_id", F.concat(F.lit("Untitled "), F.coalesce("source", F.lit("?"))).alias("summary"))
    return E.overlay(plain, d.select("doc_id", F.col("title").alias("summary")), "doc_id", ["summary"])


_METRIC_SQL = ", ".join(f"least(1.0, greatest(0.0, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) / {10.0 * (i + 1)})) AS {m}" for i, m in enumerate(E.METRICS))


@query("metrics_struct", f"SELECT event_id, {_METRIC_SQL} FROM events")
def metrics_struct(spark, base):
    """The ten scores of a model's reply, each a share of the event's number."""
    reply = F.to_json(F.struct(*[(F.coalesce("j.k", F.lit(0.0)) / (10.0 * (i + 1))).alias(m) for i, m in enumerate(E.METRICS)]))
    e = table(spark, base, "events").select("event_id", F.from_json("props", "k double").alias("j"))
    e = e.select("event_id", F.from_json(reply, E.METRIC_SCHEMA).alias("m"))
    return e.select("event_id", E.metrics(F.col("m")).alias("m")).select("event_id", "m.*")


@query("retrieve_filtered", f"WITH {S} SELECT id FROM s WHERE lower(trim(language)) = 'rust'  AND type = 'method'")
def retrieve_filtered(spark, base):
    return sym(spark, base, "type", where=(F.lower(F.trim("language")) == "rust") & (F.col("type") == "method")).select("id")


@query("qa_citations", f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY end_line - start_line DESC, path, start_line, id) AS rn FROM s)
SELECT repository_id, '[' || rn || '] ' || path || ':' || start_line || ' ' || type || ' ' || name AS citation FROM r WHERE rn <= 6""")
def qa_citations(spark, base):
    s = sym(spark, base, "repository_id", "path", "start_line", "end_line", "type", "name")
    rn = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc(F.col("end_line") - F.col("start_line")), "path", "start_line", "id"))
    text = lambda c: F.col(c).cast("string")
    return s.withColumn("rn", rn).where("rn <= 6").select(
        "repository_id", F.concat(F.lit("["), text("rn"), F.lit("] "), "path", F.lit(":"), text("start_line"), F.lit(" "), "type", F.lit(" "), "name").alias("citation"))


@query("qa_context", f"""WITH {S}, r AS (SELECT repository_id, path, id, signature, row_number() OVER (PARTITION BY repository_id, path ORDER BY start_line, id) AS rn FROM s)
SELECT repository_id, path, array_to_string(list_transform(list_sort(list(struct_pack(a := rn, b := coalesce(signature, '')))), lambda x: x.b), chr(10)) AS context FROM r WHERE rn <= 6 GROUP BY 1, 2""")
def qa_context(spark, base):
    s = sym(spark, base, "repository_id", "path", "start_line", "signature")
    first = top_per(s, ["repository_id", "path"], [F.col("start_line"), F.col("id")], 6)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "id", F.coalesce("signature", F.lit("")).alias("t")))), lambda x: x["t"])
    return first.groupBy("repository_id", "path").agg(F.array_join(lines, "\n").alias("context"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def event_windows(spark, base):
    return windowed_counts(table(spark, base, "events").where("ts is not null"))


@query("language_by_directory", f"WITH f AS (SELECT id, min(repository_id) AS repository_id, min(path) AS path, min(lower(trim(language))) AS language FROM files WHERE id IS NOT NULL GROUP BY id) SELECT repository_id, {DIR} AS package, language, count(*) AS n FROM f GROUP BY ALL")
def language_by_directory(spark, base):
    from siltstone.functions.text import dir_name

    return fil(spark, base, "repository_id", "path", "language").groupBy("repository_id", dir_name(F.col("path")).alias("package"), "language").agg(F.count("*").alias("n"))


_NAMED = """n AS (SELECT id, name, path, start_line, lower(name) AS low FROM s), sc AS (SELECT *, CASE WHEN low = 'load' THEN 1.0
WHEN starts_with(low, 'load') THEN round(0.9 - 0.1 * (length(low) - 4) / greatest(length(low), 1), 4) WHEN contains(low, 'load') THEN 0.7 END AS score FROM n),
named AS (SELECT id, name, CAST(score AS DOUBLE) AS score FROM sc WHERE score IS NOT NULL ORDER BY score DESC, length(name), path, start_line, id LIMIT 20)"""


def _named(spark, base):
    s = sym(spark, base, "name", "type", "path", "start_line", "language")
    return symbol_search_op(s, "load", fuzzy=False)


@query("symbol_search", f"WITH {S}, {_NAMED} SELECT id, name, score FROM named")
def symbol_search(spark, base):
    return _named(spark, base).select("id", "name", "score")


@query("graph_proximity", f"WITH {EDGES}, {_NAMED}, seeds AS (SELECT id FROM named ORDER BY score DESC, id LIMIT 5) SELECT DISTINCT id, 0.5::DOUBLE AS score FROM (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM seeds) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM seeds))")
def graph_proximity(spark, base):
    merged = _named(spark, base).select("id", F.col("score").alias("symbol"), F.lit(0.0).alias("vector"))
    edges = contains_edges(table(spark, base, "repositories"), fil(spark, base, "repository_id"), sym(spark, base, "file_id", "parent_id"))
    return graph_signal(merged, edges)
