"""Structural, call and import graph questions."""

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.text import dir_name
from siltstone.operators import graph as G
from siltstone.operators.search import top_per
from siltstone.plans.registry import query
from siltstone.plans.views import CALLS, DIR, FI, FLAT, INDEG, S, TX, bare, calls, fil, flat_files, flat_texts, raw_calls, sym, texts
from siltstone.session import Stage
from siltstone.sources.tables import table

EDGES = f"""{S}, {FI}, e AS (SELECT repository_id AS src, id AS dst, 'contains' AS type FROM f WHERE repository_id IN (SELECT id FROM repositories)
UNION SELECT CASE WHEN parent_id IN (SELECT id FROM s) THEN parent_id ELSE file_id END, id, 'contains' FROM s),
edges AS (SELECT DISTINCT * FROM e WHERE src IS NOT NULL)"""


def _edges(spark, base):
    return G.contains_edges(table(spark, base, "repositories"), fil(spark, base, "repository_id"), sym(spark, base, "file_id", "parent_id"))


@query("contains_edges", f"WITH {EDGES} SELECT src, dst, type FROM edges")
def contains_edges(spark, base):
    return _edges(spark, base)


@query("graph_dedupe_edges", "SELECT DISTINCT file_id AS src, id AS dst, type FROM symbols WHERE file_id IS NOT NULL AND id IS NOT NULL")
def graph_dedupe_edges(spark, base):
    s = table(spark, base, "symbols").where("file_id is not null and id is not null")
    return s.select(F.col("file_id").alias("src"), F.col("id").alias("dst"), "type").dropDuplicates(["src", "dst", "type"])


@query("graph_counts", f"WITH {EDGES} SELECT (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS n_nodes")
def graph_counts(spark, base):
    ends = _edges(spark, base).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("e")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("e")))).alias("x"))
    per = ends.groupBy("x.id").agg(F.sum("x.e").alias("e"))
    return per.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"), F.count("*").alias("n_nodes"))


@query("degrees", f"""WITH {EDGES}, n AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
SELECT n.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM n
LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) i ON i.dst = n.id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY 1) o ON o.src = n.id""")
def degrees(spark, base):
    e = _edges(spark, base)
    return G.degrees(e.select(F.col("src").alias("id")).union(e.select("dst")), e)


@query("successors", f"WITH {EDGES} SELECT src, dst FROM edges WHERE src = (SELECT min(id) FROM repositories)")
def successors(spark, base):
    first = table(spark, base, "repositories").agg(F.min("id").alias("src"))
    return _edges(spark, base).join(F.broadcast(first), "src", "left_semi").select("src", "dst")


@query("predecessors", f"WITH {EDGES} SELECT src, dst FROM edges WHERE dst IN (SELECT min(id) FROM s GROUP BY repository_id)")
def predecessors(spark, base):
    first = sym(spark, base, "repository_id").groupBy("repository_id").agg(F.min("id").alias("dst"))
    return _edges(spark, base).join(first, "dst", "left_semi").select("src", "dst")


def _near(depth):
    und = "u AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"
    steps = ", ".join(
        f"n{i} AS (SELECT id, min(d) AS d FROM (SELECT * FROM n{i - 1} UNION ALL SELECT u.b, {i} FROM u JOIN n{i - 1} ON u.a = n{i - 1}.id) GROUP BY 1)" for i in range(1, depth + 1)
    )
    return f"WITH {EDGES}, {und}, n0 AS (SELECT min(id) AS id, 0 AS d FROM f), {steps} SELECT id, CAST(d AS INT) AS distance FROM n{depth} WHERE id IS NOT NULL"


def _focus(spark, base):
    return fil(spark, base).agg(F.min("id").alias("id")).where("id is not null")


@query("neighborhood_1", _near(1))
def neighborhood_1(spark, base):
    return G.neighborhood(_edges(spark, base), _focus(spark, base), 1)[0]


@query("neighborhood_2", _near(2))
def neighborhood_2(spark, base):
    return G.neighborhood(_edges(spark, base), _focus(spark, base), 2)[0]


@query("neighborhood_edges", _near(1).replace("SELECT id, CAST(d AS INT) AS distance FROM n1 WHERE id IS NOT NULL", "SELECT src, dst FROM edges WHERE src IN (SELECT id FROM n1) AND dst IN (SELECT id FROM n1)"))
def neighborhood_edges(spark, base):
    return G.neighborhood(_edges(spark, base), _focus(spark, base), 1)[1].select("src", "dst")


@query("children_by_parent", f"WITH {S} SELECT parent_id, id, name, count(*) OVER (PARTITION BY parent_id) AS siblings FROM s WHERE parent_id IS NOT NULL")
def children_by_parent(spark, base):
    s = sym(spark, base, "parent_id", "name").where("parent_id is not null")
    return s.join(s.groupBy("parent_id").agg(F.count("*").alias("siblings")), "parent_id").select("parent_id", "id", "name", "siblings")


@query("extract_calls", f"WITH {CALLS} SELECT repository_id, caller, callee_name FROM raw WHERE callee_name <> name AND callee_name NOT IN (" + ", ".join(f"'{w}'" for w in G.NOT_CALLS) + ")")
def extract_calls(spark, base):
    return raw_calls(spark, base)


@query("call_graph_edges", f"WITH {CALLS} SELECT repository_id, caller, callee_name FROM c")
def call_graph_edges(spark, base):
    return calls(spark, base).select("repository_id", "caller", "callee_name")


@query("call_in_degree", f"WITH {INDEG} SELECT id, callers FROM deg")
def call_in_degree(spark, base):
    return G.call_in_degree(calls(spark, base), sym(spark, base, "repository_id", "name"))


def _called(spark, base):
    """The calls, written once, and the most called name (the first by name) as
    a table of one row: the questions below read both several times."""
    stage = Stage(spark, "impact")
    c = stage.write(calls(spark, base).select("repository_id", "caller", "callee_name"), "calls")
    top = c.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(1)
    return c, stage.write(top.select("name"), "target")


_REACH = f"""WITH RECURSIVE {CALLS}, t AS (SELECT callee_name AS name FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
hop AS (SELECT c.repository_id, c.caller, c.callee_name, s.name AS caller_name FROM c JOIN s ON s.id = c.caller),
reach AS (SELECT repository_id, name FROM (SELECT DISTINCT repository_id, name FROM s WHERE name = (SELECT name FROM t))
UNION SELECT hop.repository_id, hop.caller_name FROM hop JOIN reach ON hop.repository_id = reach.repository_id AND hop.callee_name = reach.name),
found AS (SELECT DISTINCT hop.repository_id, hop.caller AS id FROM hop JOIN reach ON hop.repository_id = reach.repository_id AND hop.callee_name = reach.name),
direct AS (SELECT DISTINCT c.repository_id, c.caller AS id FROM c WHERE callee_name = (SELECT name FROM t))"""


def _reached(spark, base):
    c, target = _called(spark, base)
    return c, target, G.transitive_callers(c, sym(spark, base, "repository_id", "name"), target)


def _named(frame, target, column="name"):
    return frame.join(F.broadcast(target.withColumnRenamed("name", column)), column, "left_semi")  # one row


@query("transitive_callers", f"{_REACH} SELECT repository_id, id FROM found")
def transitive_callers(spark, base):
    return _reached(spark, base)[2].select("repository_id", "id")


def _direct(c, target):
    return _named(c, target, "callee_name").select("repository_id", F.col("caller").alias("id")).distinct()


@query("impact_direct", f"{_REACH} SELECT repository_id, id FROM direct")
def impact_direct(spark, base):
    return _direct(*_called(spark, base))


@query("impact_indirect", f"{_REACH} SELECT repository_id, id FROM found WHERE id NOT IN (SELECT id FROM direct) AND id NOT IN (SELECT id FROM s WHERE name = (SELECT name FROM t))")
def impact_indirect(spark, base):
    c, target, reached = _reached(spark, base)
    far = reached.join(_direct(c, target), ["repository_id", "id"], "left_anti")
    return far.join(_named(sym(spark, base, "name"), target), "id", "left_anti").select("repository_id", "id")


def _affected(spark, base):
    _, target, reached = _reached(spark, base)
    s = sym(spark, base, "repository_id", "name", "path")
    return s.join(reached.select("id").union(_named(s, target).select("id")).distinct(), "id", "left_semi")


_AFF = _REACH + ", aff AS (SELECT s.* FROM s WHERE id IN (SELECT id FROM found) OR name = (SELECT name FROM t))"


@query("impact_files", f"{_AFF} SELECT DISTINCT repository_id, path FROM aff")
def impact_files(spark, base):
    return _affected(spark, base).select("repository_id", "path").distinct()


@query("impact_modules", f"{_AFF} SELECT DISTINCT repository_id, {DIR} AS module FROM aff")
def impact_modules(spark, base):
    return _affected(spark, base).select("repository_id", dir_name(F.col("path")).alias("module")).distinct()


@query("impact_tests", f"{_AFF} SELECT DISTINCT repository_id, path FROM aff WHERE regexp_matches(lower(path), 'test|spec')")
def impact_tests(spark, base):
    return _affected(spark, base).where(F.rlike(F.lower("path"), F.lit("test|spec"))).select("repository_id", "path").distinct()


@query("symbol_context", f"""WITH {CALLS}, o AS (SELECT caller AS id, array_to_string(list_sort(list(DISTINCT callee_name)), ',') AS calls FROM c GROUP BY 1),
i AS (SELECT c.repository_id, c.callee_name AS name, array_to_string(list_sort(list(DISTINCT s.name))[1:10], ',') AS called_by FROM c JOIN s ON s.id = c.caller GROUP BY ALL)
SELECT s.id, p.name AS parent, coalesce(o.calls, '') AS calls, coalesce(i.called_by, '') AS called_by FROM s LEFT JOIN s p ON s.parent_id = p.id
LEFT JOIN o ON o.id = s.id LEFT JOIN i ON i.repository_id = s.repository_id AND i.name = s.name""")
def symbol_context(spark, base):
    s = sym(spark, base, "repository_id", "name", "parent_id")
    c = calls(spark, base)
    out = c.groupBy(F.col("caller").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("callee_name")), ",").alias("calls"))
    named = c.join(s.select(F.col("id").alias("caller"), F.col("name").alias("by")), "caller").select("repository_id", F.col("callee_name").alias("name"), "by").distinct()
    first = top_per(named, ["repository_id", "name"], [F.col("by")], 10)
    inn = first.groupBy("repository_id", "name").agg(F.array_join(F.array_sort(F.collect_list("by")), ",").alias("called_by"))
    parent = s.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    return s.join(parent, "parent_id", "left").join(out, "id", "left").join(inn, ["repository_id", "name"], "left").select(
        "id", "parent", F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("called_by", F.lit("")).alias("called_by")
    )


def _pattern(p):
    return "'" + p.replace("'", "''") + "'"


def _plain(code):
    return f"regexp_replace({code}, " + _pattern(f"({T._STRING}|{T._QUOTED}|`[^`]*`)|{T._SLASHED}") + ", '\\1', 'g')"


def _imports(source):
    """SQL of the imports of a table of texts."""
    return f"""b0 AS (SELECT repository_id, path, language, {bare("content", "language")} AS bare, {_plain("content")} AS plain FROM {source}),
mods AS (SELECT repository_id, path, language, CASE WHEN language = 'python' THEN list_concat(regexp_extract_all(bare, {_pattern(G.PY_FROM)}, 1),
list_filter(list_transform(flatten(list_transform(regexp_extract_all(bare, {_pattern(G.PY_IMPORT)}, 1), lambda y: string_split(y, ','))), lambda y: regexp_extract(y, '^[ \\t]*([A-Za-z_][A-Za-z0-9_.]*)', 1)), lambda y: y <> ''))
WHEN language IN ('javascript', 'typescript') THEN regexp_extract_all(plain, {_pattern(G.JS_IMPORT)}, 1)
WHEN language = 'go' THEN list_transform(list_concat(regexp_extract_all(plain, {_pattern(G.GO_IMPORT)}, 1), flatten(list_transform(regexp_extract_all(plain, {_pattern(G.GO_BLOCK)}, 1), lambda y: regexp_extract_all(y, '"[^"\\n]+"')))), lambda y: trim(y, '"')) END AS ms FROM b0),
imports AS (SELECT repository_id, path, language, unnest(list_distinct(ms)) AS module FROM mods)"""


IMPORTS = TX + ", " + _imports("x")


@query("extract_imports", f"WITH {IMPORTS} SELECT repository_id, path, language, module FROM imports")
def extract_imports(spark, base):
    return G.extract_imports(texts(spark, base))


def _resolved(spark, base):
    """Imports resolved against the files of the repository, in the flat tree."""
    return G.resolve_imports(G.extract_imports(flat_texts(spark, base)), flat_files(spark, base))


_RESOLVED = TX + FLAT + ", " + _imports("fx") + """, b AS (SELECT DISTINCT repository_id, path, language, module, CASE WHEN language = 'python' THEN replace(module, '.', '/')
WHEN language IN ('javascript', 'typescript') AND starts_with(module, '.') THEN regexp_replace(module, '^(\\.{1,2}/)+', '') END AS base FROM imports),
forms AS (SELECT 'python' AS kind, unnest(['.py', '/__init__.py']) AS form, unnest([0, 1]) AS pos UNION ALL
SELECT 'js', unnest(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']), unnest(range(12))),
hit AS (SELECT b.repository_id, b.path, b.module, base || form AS target, pos FROM b JOIN forms ON kind = CASE WHEN language = 'python' THEN 'python' ELSE 'js' END WHERE base IS NOT NULL AND (b.repository_id, base || form) IN (SELECT repository_id, path FROM ff)),
resolved AS (SELECT repository_id, path, module, arg_min(target, pos) AS target FROM hit GROUP BY ALL),
me AS (SELECT DISTINCT repository_id, path AS src, target AS dst FROM resolved WHERE path <> target)"""


@query("resolve_imports", f"WITH {_RESOLVED} SELECT repository_id, path, module, target FROM resolved")
def resolve_imports(spark, base):
    return _resolved(spark, base).select("repository_id", "path", "module", "target")


@query("orphan_modules", f"WITH {_RESOLVED}, {S} SELECT repository_id, path FROM ff WHERE (repository_id, path) NOT IN (SELECT repository_id, dst FROM me) AND (repository_id, path) NOT IN (SELECT 'all', regexp_extract(path, '[^/]*$') FROM s WHERE name = 'main' AND type IN ('function', 'method'))")
def orphan_modules(spark, base):
    used = G.module_edges(_resolved(spark, base)).select("repository_id", F.col("dst").alias("path"))
    main = sym(spark, base, "path", where="name = 'main' and type in ('function', 'method')").select(
        F.lit("all").alias("repository_id"), T.base_name(F.col("path")).alias("path"))
    return flat_files(spark, base).join(used.union(main).distinct(), ["repository_id", "path"], "left_anti")


@query("most_depended", f"WITH {_RESOLVED} SELECT repository_id, dst AS path, count(*) AS n FROM me GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, path) <= 10")
def most_depended(spark, base):
    n = G.module_edges(_resolved(spark, base)).groupBy("repository_id", F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    return top_per(n, ["repository_id"], [F.desc("n"), F.col("path")], 10)


# a call makes the caller's file depend on the files that define the name: edges with cycles, made of the tables
_CALLED = f"""{CALLS}, few AS (SELECT repository_id, name FROM s GROUP BY 1, 2 HAVING count(*) <= 3),
me AS (SELECT DISTINCT u.repository_id, cs.path AS src, d.path AS dst FROM c u JOIN s cs ON cs.id = u.caller JOIN few ON few.repository_id = u.repository_id AND few.name = u.callee_name
JOIN s d ON d.repository_id = u.repository_id AND d.name = u.callee_name WHERE cs.path <> d.path)"""
_CYCLES = """walk AS (SELECT repository_id, [src, dst] AS nodes FROM me WHERE dst > src UNION ALL
SELECT w.repository_id, list_append(w.nodes, me.dst) FROM walk w JOIN me ON me.repository_id = w.repository_id AND me.src = w.nodes[-1] WHERE me.dst > w.nodes[1] AND NOT list_contains(w.nodes, me.dst)),
cyc AS (SELECT w.repository_id, w.nodes AS cycle FROM walk w JOIN me ON me.repository_id = w.repository_id AND me.src = w.nodes[-1] AND me.dst = w.nodes[1])
SELECT repository_id, array_to_string(cycle, ' > ') AS cycle FROM cyc QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY len(cycle), cycle) <= 10"""


def file_dependencies(spark, base):
    """Distinct ``repository_id, src, dst`` between files by calls of names that
    at most three symbols of the repository have."""
    s = sym(spark, base, "repository_id", "name", "path")
    few = s.groupBy("repository_id", "name").agg(F.count("*").alias("n")).where("n <= 3").drop("n")
    uses = calls(spark, base).join(s.select("repository_id", F.col("id").alias("caller"), F.col("path").alias("src")), ["repository_id", "caller"])
    defs = s.join(few, ["repository_id", "name"], "left_semi").select("repository_id", F.col("name").alias("callee_name"), F.col("path").alias("dst")).distinct()
    pairs = uses.select("repository_id", "src", "callee_name").distinct().join(defs, ["repository_id", "callee_name"])
    return pairs.where("src <> dst").select("repository_id", "src", "dst").distinct()


# the imports of the tables hold no cycle: every second edge, by the hash of its start, is planted back as well
@query("import_cycles", f"WITH RECURSIVE {_RESOLVED.replace('me AS (', 'm0 AS (')}, me AS (SELECT * FROM m0 UNION SELECT repository_id, dst, src FROM m0 WHERE substr(md5(src), 1, 1) < '8'), {_CYCLES}")
def import_cycles(spark, base):
    e = G.module_edges(_resolved(spark, base))
    back = e.where(F.substring(F.md5("src"), 1, 1) < "8").select("repository_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _joined(G.import_cycles(e.union(back)))


@query("dependency_cycles", f"WITH RECURSIVE {_CALLED}, {_CYCLES}")
def dependency_cycles(spark, base):
    return _joined(G.import_cycles(file_dependencies(spark, base)))


def _joined(cycles):
    return cycles.select("repository_id", F.array_join("cycle", " > ").alias("cycle"))


@query("nearest_enclosing", f"""WITH {S} SELECT c.id, arg_max(p.id, struct_pack(a := p.start_line, b := p.end_line, c := p.id)) AS encloser FROM s c JOIN s p ON c.file_id = p.file_id
AND p.start_line <= c.start_line AND p.end_line >= c.end_line AND (p.start_line <> c.start_line OR p.end_line <> c.end_line) GROUP BY 1""")
def nearest_enclosing(spark, base):
    return G.nearest_enclosing(sym(spark, base, "file_id", "start_line", "end_line"))


@query("resolve_parents", f"WITH {S} SELECT s.id, CASE WHEN s.type = 'function' AND p.type IN ('class', 'interface', 'struct', 'trait') THEN 'method' WHEN s.type = 'global' AND regexp_matches(s.name, '^[A-Z][A-Z0-9_]*$') THEN 'const' ELSE s.type END AS kind FROM s LEFT JOIN s p ON s.parent_id = p.id WHERE NOT (s.type = 'global' AND p.id IS NOT NULL)")
def resolve_parents(spark, base):
    s = sym(spark, base, "type", "name", "parent_id")
    j = s.join(s.select(F.col("id").alias("parent_id"), F.col("type").alias("outer")), "parent_id", "left").where("not (type = 'global' and outer is not null)")
    kind = F.when((F.col("type") == "function") & F.col("outer").isin("class", "interface", "struct", "trait"), "method").when(
        (F.col("type") == "global") & F.rlike("name", F.lit("^[A-Z][A-Z0-9_]*$")), "const").otherwise(F.col("type"))
    return j.select("id", kind.alias("kind"))
