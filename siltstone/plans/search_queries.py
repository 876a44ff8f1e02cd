"""Keyword, name, vector and hybrid search."""

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import retrieval as R
from siltstone.operators import search as Q
from siltstone.operators import vectors as V
from siltstone.operators.graph import contains_edges
from siltstone.plans.graph_queries import EDGES
from siltstone.plans.ingest_queries import LINES
from siltstone.plans.registry import query
from siltstone.plans.views import S, fil, sym, texts
from siltstone.sources.tables import table


def _lines(spark, base):
    return Q.explode_lines(texts(spark, base), "file_id", "content")


@query("keyword_search", f"WITH {LINES} SELECT file_id, line_no, line FROM l WHERE contains(lower(line), 'password')")
def keyword_search(spark, base):
    return Q.keyword_hits(_lines(spark, base), "Password").select("file_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("keyword_regex", f"WITH {LINES} SELECT file_id, line_no, line FROM l WHERE regexp_matches(line, '(?i)return [a-z]+, fmt')")
def keyword_regex(spark, base):
    return Q.keyword_hits(_lines(spark, base), "return [a-z]+, fmt", regex=True).select("file_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query("keyword_case_sensitive", f"WITH {LINES} SELECT file_id, line_no FROM l WHERE contains(line, 'TODO')")
def keyword_case_sensitive(spark, base):
    return Q.keyword_hits(_lines(spark, base), "TODO", case_sensitive=True).select("file_id", F.col("line_no").cast("long").alias("line_no"))


@query("keyword_lang_filter", f"WITH {LINES} SELECT l.file_id, line_no FROM l JOIN f ON f.id = l.file_id WHERE f.language IN ('python', 'go') AND contains(lower(line), 'todo')")
def keyword_lang_filter(spark, base):
    some = texts(spark, base).where(F.col("language").isin("python", "go"))
    return Q.keyword_hits(Q.explode_lines(some, "file_id", "content"), "todo").select("file_id", F.col("line_no").cast("long").alias("line_no"))


@query("keyword_context", f"""WITH {LINES}, w AS (SELECT file_id, line_no, line, lag(line) OVER v AS b, lead(line) OVER v AS a FROM l WINDOW v AS (PARTITION BY file_id ORDER BY line_no))
SELECT file_id, line_no, line, coalesce(b, '') AS before, coalesce(a, '') AS after FROM w WHERE contains(lower(line), 'password')""")
def keyword_context(spark, base):
    lines = _lines(spark, base)
    got = Q.with_context(lines, Q.keyword_hits(lines, "password"), "file_id", 1)
    return got.select("file_id", F.col("line_no").cast("long").alias("line_no"), "line", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query("keyword_page", f"WITH {LINES}, h AS (SELECT file_id, line_no, line FROM l WHERE contains(lower(line), 'return') ORDER BY file_id, line_no LIMIT 100), w AS (SELECT l.file_id, l.line_no, b.line AS b, a.line AS a FROM h JOIN l USING (file_id, line_no) LEFT JOIN l b ON b.file_id = l.file_id AND b.line_no = l.line_no - 1 LEFT JOIN l a ON a.file_id = l.file_id AND a.line_no = l.line_no + 1) SELECT file_id, line_no, coalesce(b, '') AS before, coalesce(a, '') AS after FROM w")
def keyword_page(spark, base):
    """The first hundred hits, and only their lines around."""
    lines = _lines(spark, base)
    got = Q.with_context(lines, Q.first_hits(Q.keyword_hits(lines, "return"), "file_id"), "file_id", 1)
    return got.select("file_id", F.col("line_no").cast("long").alias("line_no"), F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


@query("enclosing_symbol", f"""WITH {LINES}, h AS (SELECT f.repository_id || '/' || f.path AS path, line_no FROM l JOIN f ON f.id = l.file_id WHERE contains(lower(line), 'password')), {S},
j AS (SELECT h.path, h.line_no, s.id, row_number() OVER (PARTITION BY h.path, h.line_no ORDER BY end_line - start_line, start_line, s.id) AS rn
FROM h JOIN s ON h.path = s.repository_id || '/' || s.path AND h.line_no BETWEEN s.start_line AND s.end_line)
SELECT path, line_no, id AS symbol_id FROM j WHERE rn = 1""")
def enclosing_symbol(spark, base):
    whole = F.concat_ws("/", "repository_id", "path")
    where = fil(spark, base, "repository_id", "path").select(F.col("id").alias("file_id"), whole.alias("path"))
    hits = Q.keyword_hits(_lines(spark, base), "password").join(where, "file_id").select("path", F.col("line_no").cast("long").alias("line_no"))
    s = sym(spark, base, "repository_id", "path", "start_line", "end_line").withColumn("path", whole)
    return Q.enclosing_symbol(hits, s)


_SCORE = """n AS (SELECT id, name, path, start_line, type, lower(name) AS low FROM s), sc AS (SELECT *, CASE WHEN low = 'parse' THEN 1.0
WHEN starts_with(low, 'parse') THEN round(0.9 - 0.1 * (length(low) - 5) / greatest(length(low), 1), 4) WHEN contains(low, 'parse') THEN 0.7 END AS score FROM n)"""


@query("symbol_search_exact_prefix", f"WITH {S}, {_SCORE} SELECT id, name, CAST(score AS DOUBLE) AS score FROM sc WHERE score IS NOT NULL ORDER BY score DESC, length(name), path, start_line, id LIMIT 20")
def symbol_search_exact_prefix(spark, base):
    s = sym(spark, base, "name", "type", "path", "start_line", "language")
    return Q.symbol_search(s, "parse", fuzzy=False).select("id", "name", "score")


@query("symbol_search_fuzzy")
def symbol_search_fuzzy(spark, base):
    return Q.symbol_search(sym(spark, base, "name", "type", "path", "start_line", "language"), "valdateBallot")


_PAGE = "SELECT id, name, type, path, start_line, end_line - start_line + 1 AS loc FROM s"


@query("symbols_page_loc", f"WITH {S} {_PAGE} ORDER BY loc DESC, path, start_line, id LIMIT 500")
def symbols_page_loc(spark, base):
    return Q.symbols_page(sym(spark, base, "name", "type", "path", "start_line", "end_line"))


@query("symbols_page_name", f"WITH {S} {_PAGE} ORDER BY name, path, start_line, id LIMIT 200")
def symbols_page_name(spark, base):
    return Q.symbols_page(sym(spark, base, "name", "type", "path", "start_line", "end_line"), sort="name", order="asc", limit=200)


@query("symbols_page_search", f"WITH {S} {_PAGE} WHERE contains(lower(concat_ws(' ', name, type, language, path, signature, array_to_string(decorators, ' '))), 'harbor') ORDER BY loc DESC, path, start_line, id LIMIT 500")
def symbols_page_search(spark, base):
    return Q.symbols_page(sym(spark, base, "name", "type", "path", "start_line", "end_line", "language", "signature", "decorators"), needle="Harbor")


@query("biggest_symbols", f"WITH {S} SELECT id, end_line - start_line + 1 AS loc FROM s WHERE type IN ('function', 'method') ORDER BY loc DESC, path, start_line, id LIMIT 5")
def biggest_symbols(spark, base):
    s = sym(spark, base, "path", "start_line", "end_line", where=F.col("type").isin("function", "method"))
    return s.withColumn("loc", F.col("end_line") - F.col("start_line") + 1).orderBy(F.desc("loc"), "path", "start_line", "id").limit(5).select("id", "loc")


@query("biggest_files", f"WITH {S} SELECT repository_id, path, max(end_line) AS lines, count(*) AS n_symbols FROM s GROUP BY 1, 2 ORDER BY lines DESC, path, repository_id LIMIT 5")
def biggest_files(spark, base):
    s = sym(spark, base, "repository_id", "path", "end_line")
    return s.groupBy("repository_id", "path").agg(F.max("end_line").alias("lines"), F.count("*").alias("n_symbols")).orderBy(F.desc("lines"), "path", "repository_id").limit(5)


@query("locate_symbols", f"""WITH {S}, w AS (SELECT * FROM (VALUES (0, 'harbor'), (1, 'ledger')) v(word, w)),
d AS (SELECT DISTINCT word, name, type, path, start_line, end_line FROM s, w WHERE contains(lower(name), w) OR contains(lower(path), w)),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY end_line - start_line DESC, path, start_line, name, type, end_line) AS rn FROM d),
g AS (SELECT path, start_line, name, min(struct_pack(word := word, span := start_line - end_line, type := type)) AS first FROM r WHERE rn <= 5 GROUP BY ALL)
SELECT name, first.type AS type, path, start_line FROM g ORDER BY first, path, start_line, name LIMIT 10""")
def locate_symbols(spark, base):
    return Q.locate_symbols(sym(spark, base, "name", "type", "path", "start_line", "end_line"), "Where is the Harbor and the Ledger implemented?")


@query("question_intent", """WITH q AS (SELECT doc_id, lower(text) AS q FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, q,
regexp_matches(q, 'biggest|largest|longest|greatest|larger|longer|most lines|how big') AS big FROM q)
SELECT CASE WHEN big AND regexp_matches(q, 'file|module') THEN 'biggest_files' WHEN big AND regexp_matches(q, 'class|struct|interface') THEN 'biggest_classes'
WHEN big AND regexp_matches(q, 'function|method|def ') THEN 'biggest_functions' WHEN big AND regexp_matches(q, 'symbol|unit') THEN 'biggest_symbols'
WHEN regexp_matches(q, 'where is|where''s|where are|where does|located|location of|defined|definition of|implemented|logic of|logic for|locate|find the') THEN 'locate' END AS intent, count(*) AS n FROM h GROUP BY 1""")
def question_intent(spark, base):
    d = table(spark, base, "documents").where("text is not null")
    return d.groupBy(Q.question_intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


_VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


@query("vector_topk", f"""WITH {_VEC}, p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def vector_topk(spark, base):
    v = table(spark, base, "embeddings")
    return V.knn(v.where("vec_id % 50 = 0"), v, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("vector_search_filtered", f"""WITH {_VEC}, q AS (SELECT e FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)) SELECT vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score
FROM v, q WHERE label = 1 ORDER BY list_cosine_similarity(v.e, q.e) DESC, vec_id LIMIT 10""")
def vector_search_filtered(spark, base):
    v = table(spark, base, "embeddings")
    first = v.groupBy().agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("q"))  # one query vector
    hit = v.where("label = 1").crossJoin(F.broadcast(first))
    score = T.cosine(F.col("embedding").cast("array<double>"), F.col("q"))
    return hit.select("vec_id", score.alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 6).alias("score"))


@query("cosine_pair", f"""WITH {_VEC}, c AS (SELECT label, min(vec_id) AS head FROM v GROUP BY 1) SELECT v.vec_id, round(list_cosine_similarity(v.e, h.e), 6) AS score
FROM v JOIN c USING (label) JOIN v h ON h.vec_id = c.head""")
def cosine_pair(spark, base):
    v = table(spark, base, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    head = v.groupBy("label").agg(F.min_by("e", "vec_id").alias("h"))
    return v.join(head, "label").select("vec_id", F.round(T.cosine(F.col("e"), F.col("h")), 6).alias("score"))


@query("l2_normalize", f"WITH {_VEC} SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round(e[-1] / sqrt(list_dot_product(e, e)), 6) AS last FROM v")
def l2_normalize(spark, base):
    v = table(spark, base, "embeddings").select("vec_id", T.l2_normalize(F.col("embedding").cast("array<double>")).alias("e"))
    return v.select("vec_id", F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", -1), 6).alias("last"))


@query("vector_upsert", "SELECT vec_id, CASE WHEN label = 1 THEN -1 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, base):
    v = table(spark, base, "embeddings").select("vec_id", "label")
    return V.vector_upsert(v, v.where("label = 1").withColumn("label", F.lit(-1)))


@query("vector_delete", "SELECT vec_id, label FROM embeddings WHERE label <> 1")
def vector_delete(spark, base):
    v = table(spark, base, "embeddings").select("vec_id", "label")
    return V.vector_delete(v, v.where("label = 1"))


@query("vector_live_hits", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)")
def vector_live_hits(spark, base):
    live = table(spark, base, "documents").select(F.col("doc_id").alias("vec_id"))
    return table(spark, base, "embeddings").join(live, "vec_id", "left_semi").select("vec_id", "label")


@query("hash_embedding", """WITH t AS (SELECT id, unnest(list_transform(regexp_extract_all(signature, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS t FROM (SELECT id, min(signature) AS signature FROM symbols WHERE id IS NOT NULL GROUP BY id)),
n AS (SELECT id, t, count(*) AS n FROM t GROUP BY ALL), b AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 256 AS bucket,
sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS BIGINT) % 2 = 0 THEN n ELSE -n END) AS v FROM n GROUP BY ALL), l AS (SELECT id, sqrt(sum(v * v)) AS len FROM b GROUP BY 1)
SELECT id, bucket, round(v / len, 6) AS value FROM b JOIN l USING (id) WHERE v <> 0""")
def hash_embedding(spark, base):
    return V.hash_embedding(sym(spark, base, "signature"), "id", "signature").withColumn("value", F.round("value", 6))


@query("embedding_delta", """WITH d AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS h FROM documents WHERE doc_id IS NOT NULL), e AS (SELECT vec_id AS id, CASE WHEN label = 1 THEN d.h ELSE 'old' END AS h, CASE WHEN label = 2 THEN 'other' ELSE 'hash-256' END AS m FROM embeddings JOIN d ON d.id = vec_id)
SELECT d.id, CASE WHEN e.id IS NULL THEN 'new' ELSE 'changed' END AS reason FROM d LEFT JOIN e ON e.id = d.id WHERE e.id IS NULL OR e.h <> d.h OR e.m <> 'hash-256'""")
def embedding_delta(spark, base):
    """Documents to embed: those without a vector, of another text or of another
    model; the vectors' hashes and models are made of their labels."""
    units = table(spark, base, "documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    stored = table(spark, base, "embeddings").select(F.col("vec_id").alias("id"), "label").join(units, "id").select(
        "id", F.when(F.col("label") == 1, F.col("content_hash")).otherwise("old").alias("content_hash"), F.when(F.col("label") == 2, "other").otherwise("hash-256").alias("model"))
    return V.embedding_delta(units.withColumn("model", F.lit("hash-256")), stored).select("id", "reason")


def _code_hits(spark, base):
    """Lines of code with a call to parse, each once however many rows a symbol has."""
    lines = Q.explode_lines(table(spark, base, "symbols").where("id is not null and code is not null"), "id", "code")
    return Q.keyword_hits(lines, "parse(").dropDuplicates(["id", "line_no"])


def _sources(spark, base):
    s = sym(spark, base, "name", "type", "path", "start_line", "language", "repository_id", "end_line", "updated_at", "file_id", "parent_id")
    named = Q.symbol_search(s, "parse", limit=R.SYMBOL_LIMIT, fuzzy=False).select("id", "score")
    t = V.hash_embedding(s, "id", "name")
    q = V.hash_embedding(spark.createDataFrame([("q", "parse harbor ledger")], "id string, name string"), "id", "name").select("bucket", F.col("value").alias("w"))
    near = t.join(F.broadcast(q), "bucket").groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("w")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(25)
    hits = _code_hits(spark, base).orderBy("id", "line_no").limit(R.KEYWORD_LIMIT).withColumnRenamed("id", "symbol_id")
    return s, named, near, R.keyword_signal(hits)


_HASHED = """CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 256 AS bucket, CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END AS sign"""
_BLEND = f"""{EDGES}, {_SCORE}, named AS (SELECT id, score FROM sc WHERE score IS NOT NULL ORDER BY score DESC, length(name), path, start_line, id LIMIT 25),
tk AS (SELECT id, unnest(list_transform(regexp_extract_all(name, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS t FROM s), tn AS (SELECT id, t, count(*) AS n FROM tk GROUP BY ALL),
tb AS (SELECT id, bucket, CAST(sum(sign * n) AS DOUBLE) AS v FROM (SELECT *, {_HASHED} FROM tn) GROUP BY ALL), tl AS (SELECT id, sqrt(sum(v * v)) AS len FROM tb GROUP BY 1),
qb AS (SELECT bucket, CAST(sum(sign) AS DOUBLE) AS w FROM (SELECT *, {_HASHED} FROM (SELECT unnest(['parse', 'harbor', 'ledger']) AS t)) GROUP BY 1), ql AS (SELECT sqrt(sum(w * w)) AS len FROM qb),
near AS (SELECT tb.id, round(sum(tb.v / tl.len * qb.w / (SELECT len FROM ql)), 6) AS score FROM tb JOIN tl USING (id) JOIN qb USING (bucket) WHERE tb.v <> 0 AND qb.w <> 0 GROUP BY 1 ORDER BY score DESC, 1 LIMIT 25),
cl AS (SELECT id, unnest(string_split(regexp_replace(code, '\\n$', ''), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(code, '\\n$', ''), chr(10)), 1) AS no FROM s WHERE code <> ''),
ch AS (SELECT id FROM cl WHERE contains(lower(line), 'parse(') ORDER BY id, no LIMIT 50), kw AS (SELECT id, least(1.0, 0.34 * count(*)) AS score FROM ch GROUP BY 1),
u AS (SELECT id, 'symbol' AS source, CAST(score AS DOUBLE) AS score FROM named UNION ALL SELECT id, 'vector', score FROM near UNION ALL SELECT id, 'keyword', CAST(score AS DOUBLE) FROM kw)"""


def _merged(of, names):
    pick = ", ".join(f"coalesce(max(score) FILTER (WHERE source = '{n}'), 0.0) AS {n}" for n in names)
    return f"SELECT id, {pick}, list_sort(list(DISTINCT source)) AS sources FROM {of} GROUP BY 1"


@query("merge_sources", f"WITH {_BLEND} SELECT id, symbol, vector, keyword, array_to_string(sources, ',') AS sources FROM ({_merged('u', ('symbol', 'vector', 'keyword'))})")
def merge_sources(spark, base):
    _, named, near, keyword = _sources(spark, base)
    merged = R.merge_sources({"symbol": named, "vector": near, "keyword": keyword})
    return merged.withColumn("sources", F.array_join("sources", ","))


_RANKED = f"""{_BLEND}, m1 AS ({_merged('u', ('symbol', 'vector', 'keyword'))}), seeds AS (SELECT id FROM m1 ORDER BY symbol + vector DESC, id LIMIT 5),
u2 AS (SELECT * FROM u UNION ALL SELECT id, 'graph', 0.5 FROM (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM seeds) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM seeds)) WHERE id IN (SELECT id FROM s)),
m2 AS (SELECT m.*, s.name, s.path, s.start_line, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE (row_number() OVER (ORDER BY s.updated_at NULLS FIRST, m.id) - 1) / (count(*) OVER () - 1) END AS recency
FROM ({_merged('u2', ('symbol', 'vector', 'keyword', 'graph'))}) m JOIN s USING (id))
SELECT id, name, path, start_line, round((0.30 * symbol + 0.35 * vector + 0.20 * keyword + 0.15 * graph + 0.05 * recency) * (1 + 0.08 * (len(sources) - 1)), 4) AS score, array_to_string(sources, ',') AS sources
FROM m2 ORDER BY score DESC, path, start_line, id LIMIT 10"""


@query("hybrid_retrieve", f"WITH {_RANKED}")
def hybrid_retrieve(spark, base):
    s, named, near, keyword = _sources(spark, base)
    edges = contains_edges(table(spark, base, "repositories"), fil(spark, base, "repository_id"), s)
    return R.hybrid_retrieve(s, edges, named, near, keyword).withColumn("sources", F.array_join("sources", ","))


@query("vector_count", "SELECT len(embedding) AS dimension, count(*) AS n FROM embeddings GROUP BY 1")
def vector_count(spark, base):
    return V.dimensions(table(spark, base, "embeddings"))


@query("vector_table", "SELECT vec_id, len(embedding) AS dimension FROM embeddings")
def vector_table(spark, base):
    """The vector table with its dimension checked row by row."""
    v = V.of_dimension(table(spark, base, "embeddings"), 64)
    return v.select("vec_id", F.size("embedding").alias("dimension"))


@query("keyword_signal", f"""WITH {S}, u AS (SELECT id, string_split(code, chr(10)) AS ls FROM s WHERE code <> ''), n AS (SELECT id, len(list_filter(ls, lambda x: contains(lower(x), 'parse('))) AS n FROM u)
SELECT id, CAST(least(1.0, 0.34 * n) AS DOUBLE) AS score FROM n WHERE n > 0""")
def keyword_signal(spark, base):
    return R.keyword_signal(_code_hits(spark, base).withColumnRenamed("id", "symbol_id"))


@query("recency_rank", """SELECT id, round((row_number() OVER (ORDER BY coalesce(updated_at, created_at), id) - 1) / (count(*) OVER () - 1), 6) AS recency FROM repositories""")
def recency_rank(spark, base):
    r = table(spark, base, "repositories").select("id", F.coalesce("updated_at", "created_at").alias("updated_at"))
    return R.recency(r).select("id", F.round("recency", 6).alias("recency"))
