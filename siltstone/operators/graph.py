"""Structural, call and import graphs.

Calls are resolved by name inside a repository, so a call to a common name
reaches every symbol of that name. The symbol-to-symbol edges are therefore
never written out in full for graph questions: a call graph is kept as two
tables, ``calls`` (caller id, callee name) and the names of the symbols, and
walks go from symbols to names and back, which is linear in the calls.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import strip_quotes, without_comments, without_texts
from siltstone.session import Stage

CALLABLES = ("function", "method")
#: A word before a parenthesis is a call unless it is one of these (fixed values: keywords).
NOT_CALLS = (
    "if for while switch catch return def function func fn class new match sizeof typeof await assert print raise with elif and or not in "
    "is lambda super this self use impl struct enum trait pub let const var type interface async except"
).split()


def contains_edges(repositories: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct ``src, dst, type`` edges repository -> file -> symbol -> symbol."""
    known = symbols.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    owned = symbols.where("parent_id is not null").join(known, "parent_id", "left")
    top = symbols.where("parent_id is null").withColumn("known", F.lit(None).cast("boolean"))
    held = owned.unionByName(top).select(
        F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("file_id")).alias("src"), F.col("id").alias("dst")
    )
    filed = files.join(repositories.select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
    out = filed.select(F.col("repository_id").alias("src"), F.col("id").alias("dst")).unionByName(held)
    return out.where("src is not null").withColumn("type", F.lit("contains")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree`` of every node, 0 where it has no edges."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(
        edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    d = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("id").distinct().join(d, "id", "left").select(
        "id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree")
    )


def neighborhood(edges: DataFrame, focus: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, distance) within `depth` undirected steps of the focus ids,
    and all edges between them. One shuffle join per step against the frontier."""
    stage = Stage(edges.sparkSession, "neighborhood")
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionAll(edges.select("dst", "src"))
    seen = stage.write(focus.select("id").distinct().withColumn("distance", F.lit(0)), "step-0")
    frontier = seen
    for step in range(1, depth + 1):
        near = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = stage.write(near.join(seen, "id", "left_anti").withColumn("distance", F.lit(step)), f"step-{step}")
        seen = seen.unionByName(frontier)
    inside = edges.join(seen.select(F.col("id").alias("src")), "src", "left_semi").join(seen.select(F.col("id").alias("dst")), "dst", "left_semi")
    return seen, inside


def extract_calls(symbols: DataFrame) -> DataFrame:
    """``repository_id, caller, callee_name``: distinct names called in the code
    of functions and methods, outside comments and literals and without the
    symbol's own declaration."""
    code = without_texts(F.col("code"), F.col("language"))
    names = F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)
    rows = symbols.where(F.col("type").isin(*CALLABLES) & F.col("code").isNotNull()).select(
        "repository_id", F.col("id").alias("caller"), "name", F.explode(F.array_distinct(names)).alias("callee_name")
    )
    return rows.where((F.col("callee_name") != F.col("name")) & ~F.col("callee_name").isin(*NOT_CALLS)).drop("name")


def identifiers(files: DataFrame) -> DataFrame:
    """``repository_id, name, occurrences``: every identifier of the files
    (repository_id, language, content) outside comments and literals."""
    code = without_texts(F.col("content"), F.col("language"))
    words = F.explode(F.regexp_extract_all(code, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)).alias("name")
    return files.select("repository_id", words).groupBy("repository_id", "name").agg(F.count("*").alias("occurrences"))


def resolved_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls whose name some symbol of the repository has."""
    names = symbols.select("repository_id", F.col("name").alias("callee_name")).distinct()
    return calls.join(names, ["repository_id", "callee_name"], "left_semi")


def call_in_degree(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, callers``: distinct callers of each symbol, resolved by name. All
    symbols of a name share the count of the name, so it is counted once;
    `calls` has a caller once for each name."""
    per_name = calls.groupBy("repository_id", F.col("callee_name").alias("name")).agg(F.count("caller").alias("callers"))
    return symbols.select("repository_id", "name", "id").join(per_name, ["repository_id", "name"], "left").select(
        "id", F.coalesce("callers", F.lit(0)).alias("callers")
    )


def transitive_callers(calls: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """``repository_id, id, distance``: symbols that reach a symbol of a target
    name (`targets`: name) through calls, per repository. A target counts only if
    it is reached through other symbols. Walks alternate names and callers until
    no name is new; a name is new once, so they end."""
    stage = Stage(calls.sparkSession, "callers")
    by_name = symbols.select("repository_id", F.col("id").alias("caller"), F.col("name").alias("caller_name"))
    hops = stage.write(
        calls.join(by_name, ["repository_id", "caller"]).select("repository_id", "caller", "callee_name", "caller_name"), "hops"
    )
    names = symbols.join(F.broadcast(targets.select("name").distinct().limit(TARGETS)), "name", "left_semi").select("repository_id", "name").distinct()
    seen_names = stage.write(names, "names-0")
    frontier = seen_names
    found, step = None, 0
    while True:
        step += 1
        hit = hops.join(frontier.withColumnRenamed("name", "callee_name"), ["repository_id", "callee_name"])
        hit = stage.write(hit.select("repository_id", F.col("caller").alias("id"), "caller_name").distinct().withColumn("distance", F.lit(step)), f"hit-{step}")
        found = hit if found is None else found.unionByName(hit)
        new = hit.select("repository_id", F.col("caller_name").alias("name")).distinct().join(seen_names, ["repository_id", "name"], "left_anti")
        frontier = stage.write(new, f"names-{step}")
        if frontier.isEmpty():
            break
        seen_names = seen_names.unionByName(frontier)
        if step % MERGE == 0:  # keep the plan and the number of files small on long chains
            seen_names = stage.write(seen_names.coalesce(8), f"seen-{step}")
            found = stage.write(found.coalesce(8), f"found-{step}")
    return found.groupBy("repository_id", "id").agg(F.min("distance").alias("distance"))


TARGETS = 1000  # names one walk may start from; a request names a handful
MERGE = 16


# The order in which a module path is tried.
PY_FORMS = ("{}.py", "{}/__init__.py")
JS_FORMS = tuple(f"{{}}{e}" for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")) + tuple(
    f"{{}}/index{e}" for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
)


# Fixed patterns: imports of the languages, on code without comments.
PY_FROM = r"(?m)(?:^|;)[ \t]*from[ \t]+([A-Za-z_][A-Za-z0-9_.]*)[ \t]+import\b"
PY_IMPORT = r"(?m)(?:^|;)[ \t]*import[ \t]+([A-Za-z_][^\n\r;]*)"
JS_IMPORT = r"""(?m)(?:^|;)[ \t]*import\b(?:[^;"'`]*?\bfrom\b)?\s*["']([^"'\n]+)["']"""
GO_IMPORT = r"""(?m)^[ \t]*import[ \t]+(?:[A-Za-z0-9_.]+[ \t]+)?("[^"\n]+")"""
GO_BLOCK = r"(?m)^[ \t]*import[ \t]*\(([^)]*)\)"


def extract_imports(files: DataFrame) -> DataFrame:
    """``repository_id, path, language, module``: modules that Python, JavaScript,
    TypeScript and Go texts import (files with path, language, content), each
    once per file: ``import a, b as c``, ``from a import b``, ``import x from "y"``
    over any lines, ``import "y"``, Go specs alone and in blocks. Relative Python
    imports name no module."""
    lang = F.lower(F.trim("language"))
    bare = without_texts(F.col("content"), F.col("language"))
    plain = without_comments(F.col("content"))
    listed = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(PY_IMPORT), 1), lambda x: F.split(x, ",")))
    listed = F.filter(F.transform(listed, lambda x: F.regexp_extract(x, r"^[ \t]*([A-Za-z_][A-Za-z0-9_.]*)", 1)), lambda x: x != "")
    py = F.concat(F.regexp_extract_all(bare, F.lit(PY_FROM), 1), listed)
    js = F.regexp_extract_all(plain, F.lit(JS_IMPORT), 1)
    block = F.flatten(F.transform(F.regexp_extract_all(plain, F.lit(GO_BLOCK), 1), lambda x: F.regexp_extract_all(x, F.lit('("[^"\n]+")'), 1)))
    go = F.transform(F.concat(F.regexp_extract_all(plain, F.lit(GO_IMPORT), 1), block), strip_quotes)
    found = F.when(lang == "python", py).when(lang.isin("javascript", "typescript"), js).when(lang == "go", go)
    return files.select("repository_id", "path", lang.alias("language"), F.explode(F.array_distinct(found)).alias("module"))


def join_path(base_dir: Column, relative: Column) -> Column:
    """A relative module path from a directory, with . and .. resolved."""
    parts = F.filter(F.split(F.concat_ws("/", base_dir, relative), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``repository_id, path, module, target``: the first existing candidate of
    each import; unresolved imports, and those of other languages, give no row."""
    base = F.when(F.col("language") == "python", F.translate("module", ".", "/")).when(
        F.col("language").isin("javascript", "typescript") & F.startswith("module", F.lit(".")), join_path(F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")), F.col("module"))
    )
    forms = lambda fs: F.array(*[F.concat(*([F.lit(x) for x in (f.split("{}")[0],) if x] + [F.col("base")] + [F.lit(f.split("{}")[1])])) for f in fs])
    tries = (
        imports.withColumn("base", base).where("base is not null")
        .select("repository_id", "path", "module", F.posexplode(F.when(F.col("language") == "python", forms(PY_FORMS)).otherwise(forms(JS_FORMS))).alias("pos", "target"))
    )
    hit = tries.join(files.select("repository_id", F.col("path").alias("target")).distinct(), ["repository_id", "target"], "left_semi")
    return hit.groupBy("repository_id", "path", "module").agg(F.min_by("target", "pos").alias("target"))


def module_edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``repository_id, src, dst`` from resolved imports, without self-imports."""
    return resolved.where("path <> target").select("repository_id", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()


def import_cycles(edges: DataFrame, limit: int = 10) -> DataFrame:
    """The `limit` shortest elementary cycles of each repository, of any length,
    ties by path: ``repository_id, cycle``, rotated to start at the smallest path.

    Nodes without in- or out-edges are pruned until none is left. Paths then
    grow one step at a time, only through nodes greater than their start; a
    repository that has its cycles stops growing, and the others go on until no
    path can grow."""
    from siltstone.operators.search import top_per

    stage = Stage(edges.sparkSession, "cycles")
    e = edges.where("src <> dst").select("repository_id", "src", "dst").distinct()
    e = stage.write(e, "edges-0")
    before, n, turn = -1, e.count(), 0
    while n and n != before:
        turn += 1
        live = e.select("repository_id", F.col("src").alias("n")).intersect(e.select("repository_id", F.col("dst").alias("n")))
        live = stage.write(live, f"live-{turn}")
        e2 = e.join(live.withColumnRenamed("n", "src"), ["repository_id", "src"], "left_semi").join(live.withColumnRenamed("n", "dst"), ["repository_id", "dst"], "left_semi")
        e = stage.write(e2, f"edges-{turn}")
        stage.drop(f"live-{turn}")
        stage.drop(f"edges-{turn - 1}")
        before, n = n, e.count()
    walk = stage.write(e.where("dst > src").select("repository_id", F.array("src", "dst").alias("nodes")), "walk-2")
    found = stage.write(walk.where("false").select("repository_id", F.col("nodes").alias("cycle")), "found-2")
    size = 2
    while not walk.isEmpty():
        step = walk.withColumn("src", F.element_at("nodes", -1)).join(e, ["repository_id", "src"])
        closed = step.where(F.col("dst") == F.get("nodes", F.lit(0))).select("repository_id", F.col("nodes").alias("cycle"))
        kept = top_per(found.unionByName(closed), ["repository_id"], [F.size("cycle"), F.col("cycle")], limit)
        kept = stage.write(kept.select("repository_id", "cycle"), f"found-{size + 1}")
        full = kept.groupBy("repository_id").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        grown = step.where((F.col("dst") > F.get("nodes", F.lit(0))) & ~F.array_contains("nodes", F.col("dst"))).select(
            "repository_id", F.concat("nodes", F.array("dst")).alias("nodes")
        )
        grown = stage.write(grown.join(full, "repository_id", "left_anti"), f"walk-{size + 1}")
        stage.drop(f"walk-{size}")
        stage.drop(f"found-{size}")
        walk, found, size = grown, kept, size + 1
    return found


def nearest_enclosing(spans: DataFrame, by: str = "file_id") -> DataFrame:
    """``id, encloser``: for each span (id, start_line, end_line) of a file the one
    around it that starts last, then ends last, then by id; a span of the same
    lines encloses none, nor does one whose optional column `holds` is false. The spans of a file are sorted and kept on a stack."""

    def run(batches):
        for batch in batches:
            ids, around = [], []
            for rows in batch.column("spans").to_pylist():
                open_: list[tuple] = []
                at = 0
                while at < len(rows):
                    start, end, name = rows[at]["start_line"], -rows[at]["up"], rows[at]["id"]
                    open_ = [x for x in open_ if x[1] >= start]
                    best = max((x for x in open_ if x[1] >= end and x[:2] != (start, end)), default=None)
                    if best:
                        ids.append(name)
                        around.append(best[2])
                    if rows[at]["holds"]:
                        open_.append((start, end, name))
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(around, pa.string())], names=["id", "encloser"])

    holds = F.col("holds") if "holds" in spans.columns else F.lit(True)
    rows = spans.where("start_line is not null and end_line is not null").groupBy(by).agg(
        F.array_sort(F.collect_list(F.struct("start_line", (-F.col("end_line")).alias("up"), "id", holds.alias("holds")))).alias("spans")
    )
    return rows.select("spans").mapInArrow(run, "id string, encloser string")
