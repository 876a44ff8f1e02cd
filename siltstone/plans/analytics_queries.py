"""Code health, summaries and comprehension."""

from pyspark.sql import functions as F

from siltstone.functions.text import base_name, dir_name
from siltstone.operators import analytics as A
from siltstone.operators import graph as G
from siltstone.operators.search import top_per
from siltstone.plans.graph_queries import file_dependencies
from siltstone.plans.registry import query
from siltstone.plans.views import BASE, CALLS, DIR, FI, INDEG, S, TX, bare, calls, fil, sym, texts


@query("language_breakdown", f"WITH {FI} SELECT repository_id, language, count(*) AS n FROM f GROUP BY 1, 2")
def language_breakdown(spark, base):
    return fil(spark, base, "repository_id", "language").groupBy("repository_id", "language").agg(F.count("*").alias("n"))


@query("type_breakdown", f"WITH {S} SELECT type, count(*) AS n FROM s GROUP BY 1 ORDER BY n DESC, type")
def type_breakdown(spark, base):
    return sym(spark, base, "type").groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


_DUP = """dup AS (SELECT repository_id, hash, count(*) AS copies, list_sort(list(DISTINCT name)) AS names, list_sort(list(DISTINCT path)) AS paths FROM s
WHERE type IN ('function', 'method') AND end_line - start_line >= 4 AND hash IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY count(*) DESC, hash) <= 10)"""
_SYM = ("repository_id", "name", "type", "path", "start_line", "end_line", "hash")


@query("duplicate_groups", f"""WITH {S} SELECT hash, count(*) AS copies, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM s
WHERE type IN ('function', 'method') AND end_line - start_line >= 4 AND hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, hash LIMIT 10""")
def duplicate_groups(spark, base):
    g = A.duplicate_groups(sym(spark, base, *_SYM), [])
    return g.select("hash", "copies", F.array_join("names", ",").alias("names"), F.array_join("paths", ",").alias("paths"))


IDENT = f"""ident AS (SELECT repository_id, name, count(*) AS occurrences FROM (SELECT repository_id, unnest(regexp_extract_all({bare("content", "language")}, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM x) GROUP BY 1, 2)"""


def _identifiers(spark, base):
    return G.identifiers(texts(spark, base))


@query("identifier_counts", f"WITH {TX}, {IDENT} SELECT repository_id, name, occurrences FROM ident")
def identifier_counts(spark, base):
    return _identifiers(spark, base)


@query("group_fingerprint", f"WITH {S} SELECT repository_id, path, md5(array_to_string(list_sort(list(hash)), ',')) AS fingerprint FROM s WHERE hash IS NOT NULL GROUP BY 1, 2")
def group_fingerprint(spark, base):
    s = sym(spark, base, "repository_id", "path", "hash").where("hash is not null")
    return s.groupBy("repository_id", "path").agg(F.md5(F.array_join(F.array_sort(F.collect_list("hash")), ",")).alias("fingerprint"))


_DEAD = f"""{INDEG}, {TX}, {IDENT}, defd AS (SELECT repository_id, name, count(*) AS defined FROM s GROUP BY 1, 2),
dead AS (SELECT s.repository_id, s.id, s.name, s.path, s.start_line FROM s JOIN deg ON deg.id = s.id AND deg.callers = 0 JOIN defd USING (repository_id, name)
LEFT JOIN ident USING (repository_id, name) WHERE s.type IN ('function', 'method') AND s.name NOT IN ('main', 'constructor') AND NOT starts_with(s.name, 'test')
AND NOT (starts_with(s.name, '__') AND ends_with(s.name, '__')) AND len(list_filter(coalesce(s.decorators, []), lambda d: regexp_replace(regexp_replace(d, '^@', ''), '\\(.*$', '') NOT IN ('staticmethod', 'classmethod'))) = 0
AND coalesce(occurrences, 0) <= defined)"""


def _dead(spark, base):
    s = sym(spark, base, "repository_id", "name", "type", "path", "start_line", "decorators")
    return A.dead_code(s, G.call_in_degree(calls(spark, base), s), _identifiers(spark, base))


@query("dead_code", f"WITH {_DEAD} SELECT repository_id, id, name, path, start_line FROM dead")
def dead_code(spark, base):
    return _dead(spark, base)


# No symbol of the tables is called main and no file is an entry file: names that
# begin with load, start, run or init are read as main, files named after a
# ledger as main.py.
_MAIN = "^(load|start|run|init)"
_PLANTED = f"""p AS (SELECT * REPLACE (CASE WHEN regexp_matches(name, '{_MAIN}') AND type IN ('function', 'method') THEN 'main' ELSE name END AS name,
regexp_replace(path, '[^/]*ledger[^/]*$', 'main.py') AS path) FROM s)"""


def _entries(spark, base):
    s = sym(spark, base, "repository_id", "path", "start_line", "name", "type")
    named = F.when(A.is_callable() & F.rlike("name", F.lit(_MAIN)), "main").otherwise(F.col("name"))
    return s.withColumn("name", named).withColumn("path", F.regexp_replace("path", "[^/]*ledger[^/]*$", "main.py"))


@query("entry_points", f"WITH {S}, {_PLANTED} SELECT repository_id, path, start_line FROM p WHERE name = 'main' AND type IN ('function', 'method')")
def entry_points(spark, base):
    return A.entry_names(_entries(spark, base)).select("repository_id", "path", "start_line")


@query("shared_utilities", f"""WITH {INDEG}, h AS (SELECT repository_id, name FROM s GROUP BY 1, 2 HAVING count(*) <= 3)
SELECT repository_id, name, max(callers) AS callers FROM s JOIN deg USING (id) WHERE type IN ('function', 'method') AND callers > 1 AND length(name) >= 3 AND (repository_id, name) IN (SELECT repository_id, name FROM h)
GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY max(callers) DESC, name) <= 10""")
def shared_utilities(spark, base):
    s = sym(spark, base, "repository_id", "name", "type")
    return A.shared_utilities(s, G.call_in_degree(calls(spark, base), s))


@query("dependency_report_counts", f"""WITH {INDEG} SELECT s.repository_id, count(*) AS symbols, count(DISTINCT path) AS files, count_if(callers > 0) AS called, any_value(coalesce(n, 0)) AS edges
FROM s JOIN deg USING (id) LEFT JOIN (SELECT repository_id, count(*) AS n FROM c GROUP BY 1) e ON e.repository_id = s.repository_id GROUP BY 1""")
def dependency_report_counts(spark, base):
    s = sym(spark, base, "repository_id", "name", "path")
    c = calls(spark, base)
    edges = c.groupBy("repository_id").agg(F.count("*").alias("edges"))
    per = s.join(G.call_in_degree(c, s), "id").groupBy("repository_id").agg(
        F.count("*").alias("symbols"), F.countDistinct("path").alias("files"), F.count_if(F.col("callers") > 0).alias("called"))
    return per.join(edges, "repository_id", "left").select("repository_id", "symbols", "files", "called", F.coalesce("edges", F.lit(0)).alias("edges"))


_SHARED = """hm AS (SELECT repository_id, name FROM s GROUP BY 1, 2 HAVING count(*) <= 3), shared AS (SELECT repository_id, name, max(callers) AS callers FROM s JOIN deg USING (id)
WHERE type IN ('function', 'method') AND callers > 1 AND length(name) >= 3 AND (repository_id, name) IN (SELECT repository_id, name FROM hm) GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY max(callers) DESC, name) <= 10)"""
_FEW_CYCLES = """fd AS (SELECT DISTINCT u.repository_id, cs.path AS src, d.path AS dst FROM c u JOIN s cs ON cs.id = u.caller JOIN hm ON hm.repository_id = u.repository_id AND hm.name = u.callee_name
JOIN s d ON d.repository_id = u.repository_id AND d.name = u.callee_name WHERE cs.path <> d.path),
two AS (SELECT a.repository_id, [a.src, a.dst] AS cycle FROM fd a JOIN fd b ON a.repository_id = b.repository_id AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst
QUALIFY row_number() OVER (PARTITION BY a.repository_id ORDER BY [a.src, a.dst]) <= 10)"""


def mutual_files(spark, base):
    """Cycles of two files that call each other, the first ten of a repository."""
    e = file_dependencies(spark, base)
    back = e.select("repository_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = e.where("src < dst").join(back, ["repository_id", "src", "dst"], "left_semi")
    return top_per(both, ["repository_id"], [F.col("src"), F.col("dst")], 10).select("repository_id", F.array("src", "dst").alias("cycle"))


_REPORT = f"""{_DEAD}, {_DUP}, {_SHARED}, {_FEW_CYCLES},
mods AS (SELECT repository_id, src, dst FROM fd), n1 AS (SELECT repository_id, count(*) AS files, count(DISTINCT language) AS languages FROM f GROUP BY 1)"""


@query("dependency_report", f"""WITH {_REPORT} SELECT n1.repository_id, n1.files, n1.languages, coalesce(a.n, 0) AS symbols, coalesce(b.n, 0) AS call_edges, coalesce(m.n, 0) AS module_edges, coalesce(d.n, 0) AS duplicate_groups,
coalesce(t.n, 0) AS cycles, coalesce(x.n, 0) AS dead_code, n1.files - coalesce(o.n, 0) AS orphans, coalesce(h.n, 0) AS shared FROM n1
LEFT JOIN (SELECT repository_id, count(*) AS n FROM s GROUP BY 1) a USING (repository_id) LEFT JOIN (SELECT repository_id, count(*) AS n FROM c GROUP BY 1) b USING (repository_id)
LEFT JOIN (SELECT repository_id, count(*) AS n FROM mods GROUP BY 1) m USING (repository_id) LEFT JOIN (SELECT repository_id, count(*) AS n FROM dup GROUP BY 1) d USING (repository_id)
LEFT JOIN (SELECT repository_id, count(*) AS n FROM two GROUP BY 1) t USING (repository_id) LEFT JOIN (SELECT repository_id, count(*) AS n FROM dead GROUP BY 1) x USING (repository_id)
LEFT JOIN (SELECT repository_id, count(DISTINCT dst) AS n FROM mods GROUP BY 1) o USING (repository_id) LEFT JOIN (SELECT repository_id, count(*) AS n FROM shared GROUP BY 1) h USING (repository_id)""")
def dependency_report(spark, base):
    """The report of a repository as one row: files, languages, symbols, edges of
    calls and between files, duplicates, cycles, dead code, files that nothing
    depends on and shared names; module edges are those of the calls."""
    s = sym(spark, base, *_SYM, "signature", "parent_id", "decorators")
    c = calls(spark, base)
    callers = G.call_in_degree(c, s)
    mods = file_dependencies(spark, base)
    files = fil(spark, base, "repository_id", "language").groupBy("repository_id").agg(F.count("*").alias("files"), F.countDistinct("language").alias("languages"))
    return A.report(files, {
        "symbols": s, "call_edges": c, "module_edges": mods, "duplicate_groups": A.duplicate_groups(s, ["repository_id"]), "cycles": mutual_files(spark, base),
        "dead_code": A.dead_code(s, callers, _identifiers(spark, base)), "used": mods.select("repository_id", "dst").distinct(), "shared": A.shared_utilities(s, callers),
    }).withColumn("orphans", F.col("files") - F.col("used")).drop("used")


_CLASSES = """m AS (SELECT parent_id AS id, count(*) AS methods, bool_or(lower(name) IN ('get_instance', 'getinstance', 'instance', 'shared')) AS singleton, list_sort(list(DISTINCT name)) AS method_names FROM s WHERE type = 'method' AND parent_id IS NOT NULL GROUP BY 1),
k AS (SELECT s.id, s.repository_id, s.name, s.path, s.start_line, s.signature, s.end_line - s.start_line + 1 AS loc, coalesce(methods, 0) AS methods, coalesce(singleton, false) AS singleton, coalesce(method_names, []) AS method_names
FROM s LEFT JOIN m ON m.id = s.id WHERE s.type IN ('class', 'struct', 'interface'))"""
_PATTERN = "CASE " + " ".join(
    f"WHEN regexp_matches(name, '{e}')" + (f" AND len(list_filter(method_names, lambda x: regexp_matches(x, '{r}'))) > 0" if r else "") + f" THEN '{w}'" for e, w, _c, r in A.PATTERNS) + " END"
_CLS = ("repository_id", "name", "type", "path", "start_line", "end_line", "signature", "parent_id")


@query("design_pattern", f"WITH {S}, {_CLASSES} SELECT id, name, {_PATTERN} AS pattern FROM k WHERE {_PATTERN} IS NOT NULL")
def design_pattern(spark, base):
    k = A.class_methods(sym(spark, base, *_CLS))
    label, _ = A.design_pattern(F.col("name"))
    return k.select("id", "name", label.alias("pattern")).where("pattern is not null")


# The classes of the tables are small: the rules run with thresholds they reach,
# and classes named after a shard or a locker are read as utilities.
_SMALL = dict(god_methods=4, god_loc=80, large_methods=3)
_UTILITY = "(Shard|Locker|Ledger|Harbor|Depot)$"


@query("god_object", f"WITH {S}, {_CLASSES} SELECT id, methods, loc FROM k WHERE methods >= 4 OR loc >= 80")
def god_object(spark, base):
    return A.size_smells(A.class_methods(sym(spark, base, *_CLS)), **_SMALL).where("god").select("id", "methods", "loc")


@query("large_class", f"WITH {S}, {_CLASSES} SELECT id, methods FROM k WHERE methods >= 3 AND NOT (methods >= 4 OR loc >= 80) AND NOT regexp_matches(coalesce(signature, ''), '\\b(Protocol|ABC|ABCMeta|Interface)\\b')")
def large_class(spark, base):
    return A.size_smells(A.class_methods(sym(spark, base, *_CLS)), **_SMALL).where("large").select("id", "methods")


@query("utility_abuse", f"WITH {S}, {_CLASSES}, u AS (SELECT id, regexp_replace(name, '{_UTILITY}', 'Utils') AS name, methods FROM k) SELECT id, name, methods FROM u WHERE regexp_matches(name, '(Utils?|Helpers?|Common|Misc)$') AND methods >= 2")
def utility_abuse(spark, base):
    k = A.class_methods(sym(spark, base, *_CLS)).withColumn("name", F.regexp_replace("name", _UTILITY, "Utils"))
    return A.utility_classes(k, least=2).select("id", "name", "methods")


@query("long_functions", f"WITH {S} SELECT id, end_line - start_line + 1 AS loc FROM s WHERE type IN ('function', 'method') AND end_line - start_line + 1 >= 60")
def long_functions(spark, base):
    return sym(spark, base, "start_line", "end_line", where=A.is_callable()).select("id", A.loc().alias("loc")).where(f"loc >= {A.LONG_LOC}")


_SURE = "CASE " + " ".join(
    f"WHEN regexp_matches(name, '{e}')" + (f" AND len(list_filter(method_names, lambda x: regexp_matches(x, '{r}'))) > 0" if r else "") + f" THEN {c}" for e, w, c, r in A.PATTERNS) + " END"
_FINDINGS = f"""{_DEAD}, {_CLASSES}, {_DUP}, {_SHARED}, {_FEW_CYCLES}, findings AS (
SELECT repository_id, 'duplicate_logic' AS category, 'Duplicate implementation' AS title, array_to_string(paths[1:3], ', ') AS target, 0.85 AS confidence FROM dup
UNION ALL SELECT repository_id, 'dead_code', 'Dead-code candidate', path || ':' || start_line || ' ' || name, 0.5 FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY path || ':' || start_line || ' ' || name, id) AS rn FROM dead) WHERE rn <= 50
UNION ALL SELECT repository_id, 'circular_dependency', 'Circular dependency', cycle[1], 0.9 FROM two
UNION ALL SELECT repository_id, 'hotspot', 'Shared utility (hotspot)', name, 0.7 FROM shared
UNION ALL SELECT repository_id, 'design_pattern', {_PATTERN} || ' pattern: ' || name, name, {_SURE} FROM k WHERE {_PATTERN} IS NOT NULL
UNION ALL SELECT repository_id, 'design_pattern', 'Singleton pattern: ' || name, name, 0.6 FROM k WHERE singleton
UNION ALL SELECT repository_id, 'god_object', 'God object: ' || name, name, 0.7 FROM k WHERE methods >= 15 OR loc >= 300
UNION ALL SELECT repository_id, 'large_class', 'Large class: ' || name, name, 0.55 FROM k WHERE methods >= 12 AND NOT (methods >= 15 OR loc >= 300) AND NOT regexp_matches(coalesce(signature, ''), '\\b(Protocol|ABC|ABCMeta|Interface)\\b')
UNION ALL SELECT repository_id, 'utility_abuse', 'Utility class abuse: ' || name, name, 0.5 FROM k WHERE regexp_matches(name, '(Utils?|Helpers?|Common|Misc)$') AND methods >= 5
UNION ALL SELECT repository_id, 'long_function', 'Long function', name, 0.55 FROM s WHERE type IN ('function', 'method') AND end_line - start_line + 1 >= 60)"""


def _findings(spark, base):
    s = sym(spark, base, *_SYM, "signature", "parent_id", "decorators")
    callers = G.call_in_degree(calls(spark, base), s)
    hot = A.shared_utilities(s, callers)
    dead = A.dead_code(s, callers, _identifiers(spark, base))
    return A.findings(s, A.duplicate_groups(s, ["repository_id"]), dead, mutual_files(spark, base), hot)


@query("findings_union", f"WITH {_FINDINGS} SELECT repository_id, category, title, target, CAST(confidence AS DOUBLE) AS confidence FROM findings")
def findings_union(spark, base):
    return _findings(spark, base)


@query("findings_by_category", f"WITH {_FINDINGS} SELECT category, count(*) AS n FROM findings GROUP BY 1")
def findings_by_category(spark, base):
    return _findings(spark, base).groupBy("category").agg(F.count("*").alias("n"))


@query("findings_ordered", f"WITH {_FINDINGS} SELECT category, title, target, CAST(confidence AS DOUBLE) AS confidence FROM findings ORDER BY confidence DESC, category, title, target, repository_id LIMIT 40")
def findings_ordered(spark, base):
    return _findings(spark, base).orderBy(F.desc("confidence"), "category", "title", "target", "repository_id").limit(40).select("category", "title", "target", "confidence")


_LONGEST = "SELECT DISTINCT repository_id, 'long_function' AS category, 'Long function' AS title, name AS target FROM s WHERE type IN ('function', 'method') AND end_line - start_line + 1 >= 20"


@query("findings_diff", f"""WITH {S}, now AS ({_LONGEST} AND type = 'method'), old AS ({_LONGEST} AND end_line - start_line + 1 < 40)
SELECT *, 'new' AS change FROM (SELECT * FROM now EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'resolved' FROM (SELECT * FROM old EXCEPT SELECT * FROM now)""")
def findings_diff(spark, base):
    """Findings by category, target and title that differ between two readings of
    the symbols: long methods now, and callables that were long up to 40 lines."""
    s = sym(spark, base, "repository_id", "name", "type", "start_line", "end_line")
    row = lambda c: s.where(A.is_callable() & (A.loc() >= 20) & c).select(
        "repository_id", F.lit("long_function").alias("category"), F.lit("Long function").alias("title"), F.col("name").alias("target"))
    return A.findings_diff(row(F.col("type") == "method"), row(A.loc() < 40), ["repository_id", "category", "title", "target"])


@query("module_summary", f"""WITH {S}, h AS (SELECT repository_id, path, type, count(*) AS n FROM s GROUP BY ALL),
hs AS (SELECT repository_id, path, string_agg(n || ' ' || type, ', ' ORDER BY n DESC, type) AS kinds FROM h GROUP BY 1, 2)
SELECT s.repository_id, s.path, count(*) AS n_symbols, array_to_string(list_sort(list(DISTINCT name))[1:6], ',') AS key_names, any_value(kinds) AS kinds FROM s JOIN hs ON hs.repository_id = s.repository_id AND hs.path = s.path GROUP BY 1, 2""")
def module_summary(spark, base):
    return A.module_summary(sym(spark, base, "repository_id", "path", "type", "name")).withColumn("key_names", F.array_join("key_names", ","))


@query("package_rollup", f"WITH {S} SELECT repository_id, {DIR} AS package, count(DISTINCT path) AS modules FROM s GROUP BY 1, 2")
def package_rollup(spark, base):
    return sym(spark, base, "repository_id", "path").groupBy("repository_id", dir_name(F.col("path")).alias("package")).agg(F.countDistinct("path").alias("modules"))


@query("repository_summary", f"""WITH {S}, h AS (SELECT repository_id, lower(trim(language)) AS l, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, l) <= 4)
SELECT s.repository_id, count(*) AS n_symbols, count(DISTINCT path) AS n_files, any_value(ls) AS languages FROM s JOIN (SELECT repository_id, string_agg(l, ', ' ORDER BY n DESC, l) AS ls FROM t GROUP BY 1) x USING (repository_id) GROUP BY 1""")
def repository_summary(spark, base):
    s = sym(spark, base, "repository_id", "path", "language").withColumn("l", F.lower(F.trim("language")))
    n = s.groupBy("repository_id", "l").agg(F.count("*").alias("n"))
    top = n.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "l"))).alias("x"))
    top = top.select("repository_id", F.array_join(F.transform(F.slice("x", 1, 4), lambda y: y["l"]), ", ").alias("languages"))
    return s.groupBy("repository_id").agg(F.count("*").alias("n_symbols"), F.countDistinct("path").alias("n_files")).join(top, "repository_id")


@query("hierarchical_rollup", f"""WITH {S}, r AS (SELECT repository_id, {DIR} AS package, path AS module, end_line - start_line + 1 AS loc FROM s)
SELECT repository_id, package, module, count(*) AS n_symbols, count(DISTINCT module) AS n_modules, CAST(sum(loc) AS BIGINT) AS loc, CAST(grouping(repository_id, package, module) AS BIGINT) AS level
FROM r GROUP BY ROLLUP (repository_id, package, module) HAVING grouping(repository_id) = 0""")
def hierarchical_rollup(spark, base):
    return A.hierarchical_rollup(sym(spark, base, "repository_id", "path", "start_line", "end_line"))


@query("collaborators", f"""WITH {CALLS}, few AS (SELECT repository_id, name FROM s GROUP BY 1, 2 HAVING count(*) <= 3),
p AS (SELECT DISTINCT u.repository_id, cs.path, d.path AS other FROM c u JOIN s cs ON cs.id = u.caller JOIN s d ON d.repository_id = u.repository_id AND d.name = u.callee_name JOIN few ON few.repository_id = d.repository_id AND few.name = d.name WHERE cs.path <> d.path),
b AS (SELECT * FROM p UNION SELECT repository_id, other, path FROM p) SELECT repository_id, path, array_to_string(list_sort(list(DISTINCT other))[1:8], ',') AS collaborators FROM b GROUP BY 1, 2""")
def collaborators(spark, base):
    got = A.collaborators(calls(spark, base), sym(spark, base, "repository_id", "path", "name"))
    return got.withColumn("collaborators", F.array_join("collaborators", ","))


@query("file_understanding", f"""WITH {S}, t AS (SELECT *, parent_id IS NULL AND type IN ('function', 'class', 'struct', 'interface', 'trait', 'enum') AS top FROM s)
SELECT repository_id, path, coalesce(array_to_string(list_transform(list_sort(list(struct_pack(a := start_line, b := id, c := type || ' ' || name)) FILTER (WHERE top))[1:12], lambda x: x.c), ','), '') AS units,
coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE top AND visibility = 'public')), ','), '') AS key_exports, md5(array_to_string(list_sort(list(hash) FILTER (WHERE hash IS NOT NULL)), ',')) AS fingerprint,
count(*) AS n_symbols, CASE WHEN contains(path, '/') THEN regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$') ELSE 'root' END AS role FROM t GROUP BY repository_id, path""")
def file_understanding(spark, base):
    s = sym(spark, base, "repository_id", "path", "parent_id", "type", "start_line", "name", "visibility", "hash")
    return A.file_understanding(s).withColumns({"units": F.array_join("units", ","), "key_exports": F.array_join("key_exports", ",")})


@query("file_role", f"WITH {S} SELECT DISTINCT repository_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$') ELSE 'root' END AS role FROM s")
def file_role(spark, base):
    s = sym(spark, base, "repository_id", "path").select("repository_id", "path").distinct()
    return s.withColumn("role", base_name(dir_name(F.col("path"), "root")))


@query("architecture_bullets", f"""WITH {S}, r AS (SELECT DISTINCT repository_id, path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '.' END AS top, CASE WHEN contains(path, '/') THEN regexp_extract(regexp_replace(path, '/[^/]*$', ''), '[^/]*$') ELSE 'root' END AS role FROM s)
SELECT repository_id, top, count(*) AS modules, array_to_string(list_sort(list(DISTINCT role))[1:4], ', ') AS roles FROM r GROUP BY 1, 2""")
def architecture_bullets(spark, base):
    r = file_role(spark, base).withColumn("top", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("."))
    return r.groupBy("repository_id", "top").agg(F.count("*").alias("modules"), F.array_join(F.slice(F.array_sort(F.collect_set("role")), 1, 4), ", ").alias("roles"))


@query("key_modules", f"WITH {S} SELECT repository_id, path, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, path) <= 10")
def key_modules(spark, base):
    n = sym(spark, base, "repository_id", "path").groupBy("repository_id", "path").agg(F.count("*").alias("n"))
    return top_per(n, ["repository_id"], [F.desc("n"), F.col("path")], 10)


@query("comprehension_entry_points", f"""WITH {S}, {_PLANTED}, e AS (SELECT repository_id, path || ':' || start_line || ' main' AS entry FROM p WHERE name = 'main' AND type IN ('function', 'method')
UNION SELECT repository_id, path FROM p WHERE {BASE} IN ({", ".join(f"'{x}'" for x in A.ENTRY_FILES)})) SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY entry) <= 12""")
def comprehension_entry_points(spark, base):
    return A.entry_points(_entries(spark, base))


@query("repo_understanding", f"""WITH {S}, fp AS (SELECT repository_id, path, md5(array_to_string(list_sort(list(hash)), ',')) AS fingerprint FROM s WHERE hash IS NOT NULL GROUP BY 1, 2)
SELECT repository_id, count(*) AS n_files, CAST(sum(CAST('0x' || substr(fingerprint, 1, 12) AS BIGINT)) AS BIGINT) AS fingerprint FROM fp GROUP BY 1""")
def repo_understanding(spark, base):
    # a sum of hashes is the same in any order and aggregates partially
    part = F.conv(F.substring("fingerprint", 1, 12), 16, 10).cast("long")
    return group_fingerprint(spark, base).groupBy("repository_id").agg(F.count("*").alias("n_files"), F.sum(part).alias("fingerprint"))


@query("explain_package", f"WITH {S} SELECT repository_id, count(DISTINCT path) AS modules FROM s WHERE starts_with(path, 'services/') GROUP BY 1")
def explain_package(spark, base):
    return sym(spark, base, "repository_id", "path", where=F.startswith("path", F.lit("services/"))).groupBy("repository_id").agg(F.countDistinct("path").alias("modules"))


@query("explain_symbol", f"WITH {S} SELECT repository_id, arg_min(struct_pack(path := path, line := start_line), struct_pack(a := path, b := start_line, c := id)) AS place FROM s WHERE name = 'parse' GROUP BY 1".replace("SELECT repository_id, arg_min", "SELECT repository_id, place.path AS path, place.line AS line FROM (SELECT repository_id, arg_min") + ")")
def explain_symbol(spark, base):
    s = sym(spark, base, "repository_id", "path", "start_line", where="name = 'parse'")
    return s.groupBy("repository_id").agg(F.min(F.struct("path", "start_line", "id")).alias("p")).select("repository_id", F.col("p.path").alias("path"), F.col("p.start_line").alias("line"))


@query("qa_context_budget", f"""WITH {S}, r AS (SELECT repository_id, id, sum(length(coalesce(signature, ''))) OVER (PARTITION BY repository_id, path ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS used FROM s)
SELECT repository_id, id, CAST(used AS BIGINT) AS used FROM r WHERE used <= 400""")
def qa_context_budget(spark, base):
    s = sym(spark, base, "repository_id", "path", "start_line", "signature").withColumn("signature", F.coalesce("signature", F.lit("")))
    return A.context_budget(s, ["repository_id", "path"], [F.col("start_line"), F.col("id")], "signature", 400).select("repository_id", "id", "used")


@query("enrichment_candidates", f"WITH {S} SELECT id FROM s WHERE type IN ('class', 'function', 'method', 'interface', 'struct', 'trait', 'enum')")
def enrichment_candidates(spark, base):
    return sym(spark, base, "type", where=F.col("type").isin("class", "function", "method", "interface", "struct", "trait", "enum")).select("id")
