"""Sources, table access, DML and scalar functions."""

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.text import blake2b
from siltstone.operators import ingest as I
from siltstone.operators import search as Q
from siltstone.plans.registry import query
from siltstone.plans.views import BASE, FI, S, TX, fil, per_symbol, sym, texts
from siltstone.sources.tables import table

_LANG = "CASE " + " ".join(f"WHEN ext = '{k}' THEN '{v}'" for k, v in T.LANGUAGE_BY_SUFFIX.items()) + " " + " ".join(
    f"WHEN base = '{k}' THEN '{v}'" for k, v in T.LANGUAGE_BY_NAME.items()) + " END"
_EXT = f"(SELECT *, lower({BASE}) AS base, regexp_extract(lower({BASE}), '[^.]\\.([^.]+)$', 1) AS ext FROM f)"
_DIRS = ", ".join(f"'{d}'" for d in I.IGNORED_DIRS)
_BUILT = " OR ".join(f"lower(path) LIKE '%{e}'" for e in I.BUILT_ENDINGS)
_IGNORED = f"len(list_filter(string_split(path, '/')[1:-2], lambda d: d IN ({_DIRS}))) > 0"


@query("manifest_scan", f"WITH {TX} SELECT repository_id, path, octet_length(encode(content)) AS size_bytes, md5(content) AS hash FROM x")
def manifest_scan(spark, base):
    return texts(spark, base).select("repository_id", "path", F.octet_length("content").cast("long").alias("size_bytes"), F.md5("content").alias("hash"))


@query("detect_language", f"WITH {FI} SELECT id, path, {_LANG} AS detected FROM {_EXT}")
def detect_language(spark, base):
    return fil(spark, base, "path").select("id", "path", T.detect_language(F.col("path")).alias("detected"))


@query("ignored_dir_filter", f"WITH {FI} SELECT id, path FROM f WHERE NOT ({_IGNORED})")
def ignored_dir_filter(spark, base):
    return fil(spark, base, "path").where(~I.in_ignored_dir(F.col("path")))


@query("generated_filter", f"WITH {FI} SELECT id, path FROM f WHERE NOT ({_BUILT})")
def generated_filter(spark, base):
    return fil(spark, base, "path").where(~I.is_built_name(F.col("path")))


@query(
    "scan_skip_counters",
    f"""WITH {TX}, e AS (SELECT x.*, lower({BASE}) AS base, regexp_extract(lower({BASE}), '[^.]\\.([^.]+)$', 1) AS ext FROM x)
SELECT coalesce(CASE WHEN {_IGNORED} OR {_BUILT} THEN 'ignored' WHEN ({_LANG}) IS NULL THEN 'unsupported'
WHEN octet_length(encode(content)) > 20000 THEN 'large' WHEN contains(content, chr(0)) THEN 'binary' END, 'kept') AS reason, count(*) AS n FROM e GROUP BY 1""",
)
def scan_skip_counters(spark, base):
    why = I.skip_reason(F.col("path"), F.octet_length("content"), F.contains("content", F.lit("\0")), max_bytes=20_000)
    return texts(spark, base).groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("content_hash", f"WITH {TX} SELECT file_id, md5(content) AS hash, sha256(content) AS sha FROM x")
def content_hash(spark, base):
    return texts(spark, base).select("file_id", F.md5("content").alias("hash"), F.sha2("content", 256).alias("sha"))


@query("file_hash", f"WITH {TX} SELECT x.file_id, f.hash FROM x JOIN f ON f.id = x.file_id WHERE f.hash IS NOT NULL")
def file_hash(spark, base):
    """BLAKE2b-128 of the contents; the SQL reads the hashes the table holds."""
    known = fil(spark, base, "hash").where("hash is not null").select(F.col("id").alias("file_id"))
    return texts(spark, base).join(known, "file_id", "left_semi").select("file_id", blake2b("content").alias("hash"))


def _scan_and_manifest(spark, base):
    """The files now, and as they were with unified line ends."""
    x = texts(spark, base)
    scan = x.select("repository_id", "path", F.md5("content").alias("hash"))
    old = fil(spark, base, "repository_id", "path").join(x.select(F.col("file_id").alias("id"), "content"), "id", "left")
    return scan, old.select("repository_id", "path", F.md5(F.replace("content", F.lit("\r\n"), F.lit("\n"))).alias("hash"))


_DIFF = TX + """, n AS (SELECT repository_id, path, md5(content) AS new_hash FROM x),
o AS (SELECT f.repository_id, f.path, md5(replace(x.content, chr(13) || chr(10), chr(10))) AS old_hash FROM f LEFT JOIN x ON x.file_id = f.id),
diff AS (SELECT coalesce(n.repository_id, o.repository_id) AS repository_id, coalesce(n.path, o.path) AS path, old_hash, new_hash,
CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN old_hash IS NOT DISTINCT FROM new_hash THEN 'unchanged' ELSE 'changed' END AS status
FROM n FULL JOIN o ON n.repository_id = o.repository_id AND n.path = o.path)"""


@query("manifest_diff", f"WITH {_DIFF} SELECT * FROM diff")
def manifest_diff(spark, base):
    return I.manifest_diff(*_scan_and_manifest(spark, base), ["repository_id", "path"], "hash")


@query(
    "index_report",
    f"""WITH {_DIFF} SELECT repository_id, count_if(status = 'added') AS added, count_if(status = 'changed') AS changed,
count_if(status = 'unchanged') AS unchanged, count_if(status = 'removed') AS removed, count_if(status <> 'removed') AS total_indexed,
count_if(status <> 'unchanged') AS touched FROM diff GROUP BY 1""",
)
def index_report(spark, base):
    return I.index_report(manifest_diff(spark, base), "repository_id")


@query("incremental_skip", f"WITH {_DIFF} SELECT repository_id, path, new_hash AS hash FROM diff WHERE status IN ('added', 'changed')")
def incremental_skip(spark, base):
    scan, manifest = _scan_and_manifest(spark, base)
    return I.changed_only(scan, manifest, ["repository_id", "path"], "hash")


@query(
    "upsert_latest_wins",
    """SELECT id, arg_max(size_bytes, updated_at) AS size_bytes, max(updated_at) AS updated_at, min(created_at) AS created_at
FROM files WHERE id IS NOT NULL AND updated_at IS NOT NULL GROUP BY id""",
)
def upsert_latest_wins(spark, base):
    f = table(spark, base, "files").where("id is not null and updated_at is not null").select("id", "size_bytes", "updated_at", "created_at")
    return I.latest_wins(f, ["id"], ["updated_at"], keep_first="created_at").select("id", "size_bytes", "updated_at", "created_at")


@query("cascade_delete", f"WITH {S} SELECT id, file_id FROM s WHERE file_id NOT IN (SELECT id FROM files WHERE size_bytes > 4000)")
def cascade_delete(spark, base):
    gone = fil(spark, base, "size_bytes").where("size_bytes > 4000")
    return I.cascade_delete(sym(spark, base, "file_id"), gone, "file_id", "id").select("id", "file_id")


@query(
    "manifest_apply_delta",
    f"""WITH {FI} SELECT f.id, f.path, f.size_bytes, least(f.created_at, coalesce(m.c, f.created_at)) AS created_at FROM f
LEFT JOIN (SELECT id, min(created_at) AS c FROM files GROUP BY id) m ON m.id = f.id""",
)
def manifest_apply_delta(spark, base):
    old = table(spark, base, "files").where("id is not null").groupBy("id").agg(F.min("created_at").alias("created_at"))
    return I.apply_delta(old, fil(spark, base, "path", "size_bytes", "created_at"), ["id"]).select("id", "path", "size_bytes", "created_at")


@query("count_files", f"WITH {FI} SELECT repository_id, count(*) AS n FROM f GROUP BY 1")
def count_files(spark, base):
    return fil(spark, base, "repository_id").groupBy("repository_id").agg(F.count("*").alias("n"))


@query("manifest_projection", f"WITH {FI} SELECT repository_id, path, id, hash FROM f")
def manifest_projection(spark, base):
    return fil(spark, base, "repository_id", "path", "hash").select("repository_id", "path", "id", "hash")


@query("files_ordered", f"WITH {FI} SELECT repository_id, path, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS seq FROM f")
def files_ordered(spark, base):
    return Q.row_numbers(fil(spark, base, "repository_id", "path"), ["repository_id"], ["path"]).select("repository_id", "path", "seq")


@query("repo_lookup", "SELECT id, path, name FROM repositories WHERE path = (SELECT min(path) FROM repositories)")
def repo_lookup(spark, base):
    r = table(spark, base, "repositories")
    return r.join(F.broadcast(r.agg(F.min("path").alias("path"))), "path", "left_semi").select("id", "path", "name")


@query("registry_list", "SELECT name, path, coalesce(updated_at, created_at) AS last_indexed FROM repositories ORDER BY last_indexed DESC, name")
def registry_list(spark, base):
    r = table(spark, base, "repositories")
    return r.select("name", "path", F.coalesce("updated_at", "created_at").alias("last_indexed")).orderBy(F.desc("last_indexed"), "name")


@query("symbols_by_name", f"WITH {S} SELECT id, repository_id, path, start_line FROM s WHERE name = 'parse'")
def symbols_by_name(spark, base):
    return sym(spark, base, "repository_id", "path", "start_line", where="name = 'parse'")


@query("symbol_candidates_filter", f"WITH {S} SELECT id, name, path FROM s WHERE lower(trim(language)) IN ('python', 'go') AND type IN ('function', 'method') AND path ILIKE 'Services/%'")
def symbol_candidates_filter(spark, base):
    some = F.lower(F.trim("language")).isin("python", "go") & F.col("type").isin("function", "method") & F.col("path").ilike("Services/%")
    return sym(spark, base, "name", "path", where=some)


@query("symbol_detail", f"WITH {S} SELECT s.id, s.name, s.end_line - s.start_line + 1 AS loc, p.name AS parent FROM s LEFT JOIN s p ON s.parent_id = p.id")
def symbol_detail(spark, base):
    s = sym(spark, base, "name", "start_line", "end_line", "parent_id")
    return s.join(s.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select(
        "id", "name", (F.col("end_line") - F.col("start_line") + 1).alias("loc"), "parent"
    )


@query("symbols_in_file_with_parent", f"WITH {S} SELECT s.id, s.file_id, s.name, p.name AS parent FROM s LEFT JOIN s p ON s.parent_id = p.id AND s.file_id = p.file_id")
def symbols_in_file_with_parent(spark, base):
    s = sym(spark, base, "file_id", "name", "parent_id")
    p = s.select(F.col("id").alias("parent_id"), "file_id", F.col("name").alias("parent"))
    return s.join(p, ["parent_id", "file_id"], "left").select("id", "file_id", "name", "parent")


@query("decode_decorators", f"WITH {S} SELECT id, array_to_string(list_transform(decorators, lambda d: regexp_replace(regexp_replace(d, '^@', ''), '\\(.*$', '')), ',') AS names FROM s WHERE len(decorators) = 1")
def decode_decorators(spark, base):
    s = sym(spark, base, "decorators").where("size(decorators) = 1")
    return s.select("id", F.array_join(T.decorator_names(F.col("decorators")), ",").alias("names"))


@query("identifier_keywords", f"""WITH {S}, n AS (SELECT DISTINCT name FROM s) SELECT name, array_to_string(list_sort(list_distinct(list_filter(
string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ', 'g')), ' +'), lambda x: x <> ''))), ' ') AS keywords FROM n""")
def identifier_keywords(spark, base):
    n = sym(spark, base, "name").select("name").distinct()
    return n.select("name", F.array_join(T.identifier_keywords(F.col("name")), " ").alias("keywords"))


@query("signature", f"""WITH {S} SELECT id, coalesce(left(list_filter(list_transform(string_split(code, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], 200), '') AS line FROM s""")
def signature(spark, base):
    return per_symbol(spark, base, line=T.first_line(F.col("code")))


@query("visibility", f"""WITH {S}, l AS (SELECT id, name, signature, lower(trim(language)) AS lang, CASE WHEN contains(signature, name) THEN string_split(signature, name)[1] ELSE signature END AS lead FROM s)
SELECT id, CASE WHEN contains(lead, 'private') THEN 'private' WHEN contains(lead, 'protected') THEN 'protected' WHEN contains(lead, 'public') THEN 'public' WHEN contains(lead, 'internal') THEN 'internal'
WHEN lang = 'python' THEN CASE WHEN NOT starts_with(name, '_') OR (starts_with(name, '__') AND ends_with(name, '__')) THEN 'public' ELSE 'private' END
WHEN lang = 'go' THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'public' ELSE 'private' END
WHEN lang = 'rust' THEN CASE WHEN starts_with(ltrim(signature), 'pub') THEN 'public' ELSE 'private' END ELSE 'unknown' END AS visible FROM l""")
def visibility(spark, base):
    return sym(spark, base, "name", "signature", "language").select("id", T.visibility(F.col("language"), F.col("name"), F.col("signature")).alias("visible"))


@query("tokenize", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n_tokens, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)), ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def tokenize(spark, base):
    d = table(spark, base, "documents").where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("llm_json_parse", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def llm_json_parse(spark, base):
    e = table(spark, base, "events").select("event_id", F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done")).alias("raw"))
    return e.select("event_id", T.model_json(F.col("raw"), "k bigint")["k"].alias("k"))


@query("llm_coercion", "SELECT event_id, coalesce(nullif(trim(event_type), ''), 'Unknown') AS kind, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k FROM events")
def llm_coercion(spark, base):
    e = table(spark, base, "events")
    kind = F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("Unknown"))
    return e.select("event_id", kind.alias("kind"), F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as double)"), F.lit(0.0)).alias("k"))


@query("clamp_scores", "SELECT event_id, least(1.0, greatest(0.0, value / 100.0)) AS score FROM events WHERE value IS NOT NULL")
def clamp_scores(spark, base):
    return table(spark, base, "events").where("value is not null").select("event_id", T.clamp(F.col("value") / 100.0).alias("score"))


@query("vocab_filter", f"""WITH {S}, w AS (SELECT repository_id, list_sort(list(DISTINCT type)) AS kinds FROM s GROUP BY 1)
SELECT repository_id, array_to_string(CASE WHEN len(list_filter(kinds, lambda x: x IN ('class', 'enum', 'trait'))) > 0 THEN list_filter(kinds, lambda x: x IN ('class', 'enum', 'trait')) ELSE ['Unknown'] END, ',') AS kept FROM w""")
def vocab_filter(spark, base):
    w = sym(spark, base, "repository_id", "type").groupBy("repository_id").agg(F.array_sort(F.collect_set("type")).alias("kinds"))
    return w.select("repository_id", F.array_join(T.keep_vocabulary(F.col("kinds"), ["class", "enum", "trait"], "Unknown"), ",").alias("kept"))


@query("embedding_text", f"WITH {S} SELECT id, md5(concat_ws(chr(10), type, name, language, signature, left(code, 2000))) AS digest FROM s")
def embedding_text(spark, base):
    return per_symbol(spark, base, digest=F.md5(F.concat_ws("\n", "type", "name", "language", "signature", F.left("code", F.lit(2000)))))


@query("payload_struct", f"WITH {S} SELECT id, name, coalesce(parent_id, '') AS parent, length(left(code, 2000)) AS code_chars FROM s")
def payload_struct(spark, base):
    payload = F.struct("name", F.coalesce("parent_id", F.lit("")).alias("parent"), F.length(F.left("code", F.lit(2000))).cast("long").alias("code_chars"))
    return per_symbol(spark, base, payload=payload).select("id", "payload.*")


@query("symbol_summary", f"WITH {S} SELECT id, md5(type || ' `' || name || '` - ' || signature) AS summary FROM s WHERE signature IS NOT NULL")
def symbol_summary(spark, base):
    s = sym(spark, base, "type", "name", "signature").where("signature is not null")
    return s.select("id", F.md5(F.concat("type", F.lit(" `"), "name", F.lit("` - "), "signature")).alias("summary"))


@query("file_snippet", f"""WITH {TX} SELECT file_id, array_to_string(string_split(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[3:7], chr(10)) AS snippet FROM x""")
def file_snippet(spark, base):
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    return texts(spark, base).select("file_id", F.array_join(F.slice(lines, 3, 5), "\n").alias("snippet"))


LINES = TX + """, u AS (SELECT file_id, regexp_replace(regexp_replace(content, '\\r\\n|[\\r\\x0b\\f\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), '\\n$', '') AS t FROM x WHERE content <> ''),
l AS (SELECT file_id, generate_subscripts(string_split(t, chr(10)), 1) AS line_no, unnest(string_split(t, chr(10))) AS line FROM u)"""


@query("explode_lines", f"WITH {LINES} SELECT file_id, count(*) AS n_lines, sum(length(line)) AS n_chars, max(line_no) AS last_line FROM l GROUP BY 1")
def explode_lines(spark, base):
    return Q.explode_lines(texts(spark, base), "file_id", "content").groupBy("file_id").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.max("line_no").cast("long").alias("last_line")
    )



