"""Operators on small inline inputs, edge cases included."""

import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import analytics as A
from siltstone.operators import enrich as E
from siltstone.operators import graph as G
from siltstone.operators import ingest as I
from siltstone.operators import retrieval as R
from siltstone.operators import search as Q
from siltstone.operators import vectors as V
from siltstone.operators.extract import extract_symbols
from siltstone.sources.files import ignore_rules, ignored_by, scan_tree, skip_counters
from siltstone.sources.store import Store
from siltstone.streaming.ingest import current, upsert_stream, windowed_counts


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("path, want", [
    ("a/b.PY", "Python"), ("a/Dockerfile", "Dockerfile"), ("makefile", "Makefile"), ("x.d.ts", "TypeScript"), ("a.b/c", None), (".py", None), ("a.xyz", None), ("q.sql", "SQL")])
def test_detect_language(spark, path, want):
    assert one(spark, T.detect_language(F.lit(path))) == want


def test_scan_tree(spark, tmp_path):
    files = {"src/main.py": b"def main(): pass\n", "src/app.ts": b"x", "README.md": b"# x", "query.sql": b"select 1", "secret.py": b"x", "dist/bundle.js": b"x", "node_modules/lib.js": b"x",
             "notes.xyz": b"x", "image.png": b"\0", "corrupt.js": b"\0\0", "a.min.js": b"x", "big.py": b"x" * 600, "keep/secret.py": b"y"}
    for p, b in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    scan = scan_tree(spark, f"file://{tmp_path}", "secret.py\n!keep/secret.py\n# c\n", max_bytes=500)
    kept = {r.path: r for r in scan.where("skip_reason is null").collect()}
    assert set(kept) == {"src/main.py", "src/app.ts", "README.md", "query.sql", "keep/secret.py"}
    assert kept["src/main.py"].content == "def main(): pass\n" and kept["src/main.py"].hash
    assert {r.reason: r.n for r in skip_counters(scan).collect()} == {"kept": 5, "ignored": 4, "unsupported": 2, "large": 1, "binary": 1}


def test_ignore_files_of_the_root(spark, tmp_path):
    for p, b in {".gitignore": b"*.log\nsecret.py\n", ".git/info/exclude": b"!keep/secret.py\nlocal.py\n", "a/.gitignore": b"b.py\n", "a/b.py": b"x", "secret.py": b"x",
                 "keep/secret.py": b"x", "local.py": b"\xff"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    names = lambda **k: {r.path for r in scan_tree(spark, f"file://{tmp_path}", **k).where("skip_reason is null").collect()}
    assert names() == {"a/b.py", "keep/secret.py"}
    assert names(gitignore="") == {"a/b.py", "keep/secret.py", "secret.py", "local.py"}


def test_ignore_rules(spark):
    rules = ignore_rules("*.log\nbuild/\n/top.txt\ndocs/**/x.md\n!keep.log")
    got = [one(spark, ignored_by(F.lit(p), rules)) for p in ("a/b.log", "keep.log", "build/x", "a/build/y", "top.txt", "a/top.txt", "docs/q/x.md", "z.py")]
    assert got == [True, False, True, True, True, False, True, False]


def test_manifest_diff_and_report(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "5")], "path string, hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "4")], "path string, hash string")
    diff = I.manifest_diff(new, old, ["path"], "hash")
    assert {r.path: r.status for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "removed", "e": "added"}
    r = I.index_report(diff).first()
    assert (r.added, r.changed, r.unchanged, r.removed, r.total_indexed, r.touched) == (1, 1, 2, 1, 4, 3)
    same = I.index_report(I.manifest_diff(new, new, ["path"], "hash")).first()
    assert same.touched == 0


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame(x, "repository_id string, id string, v int, created_at int")
    s.append("t", rows(("r1", "a", 1, 5), ("r2", "b", 1, 5)))
    s.upsert("t", rows(("r1", "a", 2, 9), ("r1", "c", 1, 9)), ["repository_id", "id"], keep_first="created_at")
    assert {(r.repository_id, r.id, r.v, r.created_at) for r in s.read("t").collect()} == {("r1", "a", 2, 5), ("r1", "c", 1, 9), ("r2", "b", 1, 5)}
    made = s.get_or_create("t", rows(("r1", "a", 7, 7), ("r2", "n", 7, 7), ("r2", "n", 7, 7)), ["repository_id", "id"])
    assert {(r.id, r.v) for r in made.collect()} == {("a", 2), ("n", 7)} and s.read("t").count() == 4
    s.replace("t", rows(("r1", "z", 0, 0), ))
    s.replace("t", rows(("r2", "b", 1, 5)))
    assert {(r.repository_id, r.id) for r in s.read("t").collect()} == {("r1", "z"), ("r2", "b")}
    s.append("t", rows(("r3", "q", 0, 0)).withColumn("extra", F.lit("new")))
    assert "extra" in s.read("t").columns
    s.delete_repository("r2", ["t"])
    assert {r.repository_id for r in s.read("t").collect()} == {"r1", "r3"}


def test_stream_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "id string, v int, t string").write.parquet(src)
    read = lambda: spark.readStream.schema("id string, v int, t string").parquet(src)
    go = lambda: upsert_stream(read(), str(tmp_path / "out"), ["id"], "v", str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([("a", 3, "new"), ("b", 2, "late")], "id string, v int, t string").write.mode("append").parquet(src)
    go()
    assert {(r.id, r.v, r.t) for r in current(spark, str(tmp_path / "out")).collect()} == {("a", 3, "new"), ("b", 5, "y")}


def test_windowed_counts_stream(spark, tmp_path):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    rows = [(at(1, 0), "a"), (at(1, 59), "a"), (at(2, 1), "b")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.event_type, r.n) for r in spark.table("win").collect()} == {("a", 2), ("b", 1)}


PY = 'CONST = 1\nlower = 2\n\n@app.command("run")\nclass Foo(Base):\n    attr = 3\n    @property\n    def method(self):\n        return 1\n\ndef top():\n    pass\n'


def test_extract_symbols(spark):
    rows = [("r", "a.py", "Python", PY), ("r", "bad.py", "python", "def (:"), ("r", "x.yaml", "YAML", "a: 1"), ("r", "n.py", "python", None),
            ("r", "a.go", "go", 'package a\n\nfunc (s *S) Login(x string) error {\n\ts := "}"\n\treturn nil\n}\n\ntype S struct {\n\tA int\n}\n'),
            ("r", "a.rs", "rust", "pub fn f() { }\nfn g() { let x = '{'; }\npub trait T { fn h(); }\n"),
            ("r", "a.ts", "typescript", "export interface I { a: string }\nexport enum E { A }\nclass C {\n  run(a: string): void {\n    if (a) { }\n  }\n}\nconst f = (a) => { return a; };\n"),
            ("r", "A.java", "java", "public class A {\n  private int f(int x) {\n    return x;\n  }\n}\n"),
            ("r", "a.c", "C", "/*\nint no(void) {\n}\n*/\nstatic int add(int a, int b) {\n  if (a) { return b; }\n  return a;\n}\nstruct P { int x; };\nenum E { A };\n"),
            ("r", "a.cpp", "C++", "namespace n {\nclass Q : public B {\n  int run(int a) const {\n    return a;\n  }\n};\n}\nint Q::go(int x)\n{\n  return x;\n}\n"),
            ("r", "a.cs", "C#", "namespace N {\n  public interface I { }\n  public class K : I {\n    private async Task<int> Run(int a) {\n      return a;\n    }\n  }\n}\n"),
            ("r", "a.php", "PHP", "<?php\n// function no() {}\nclass K {\n  public function run($a) { return '}'; }\n}\nfunction top() { }\ntrait T { }\n")]
    got = extract_symbols(spark.createDataFrame(rows, "repository_id string, path string, language string, content string")).collect()
    by = {(r.path, r.name): r for r in got}
    ids = {r.id: r.name for r in got}
    assert {(n, by["a.py", n].type) for p, n in by if p == "a.py"} == {("CONST", "const"), ("lower", "global"), ("Foo", "class"), ("method", "method"), ("top", "function")}
    assert ids[by["a.py", "method"].parent_id] == "Foo" and by["a.py", "method"].decorators == ["property"] and by["a.py", "Foo"].decorators == ["app.command"]
    assert by["a.go", "Login"].type == "method" and by["a.go", "Login"].visibility == "public" and by["a.go", "S"].type == "struct"
    assert by["a.rs", "f"].visibility == "public" and by["a.rs", "g"].visibility == "private" and by["a.rs", "T"].type == "trait"
    assert by["a.ts", "run"].type == "method" and by["a.ts", "I"].type == "interface" and by["a.ts", "f"].type == "function"
    assert {(n, by["a.c", n].type) for p, n in by if p == "a.c"} == {("add", "function"), ("P", "struct"), ("E", "enum")}
    assert {(n, by["a.cpp", n].type) for p, n in by if p == "a.cpp"} >= {("n", "namespace"), ("Q", "class"), ("run", "method")} and ids[by["a.cpp", "run"].parent_id] == "Q"
    assert {(n, by["a.cs", n].type) for p, n in by if p == "a.cs"} == {("N", "namespace"), ("I", "interface"), ("K", "class"), ("Run", "method")}
    assert {(n, by["a.php", n].type) for p, n in by if p == "a.php"} == {("K", "class"), ("run", "method"), ("top", "function"), ("T", "trait")}
    assert by["A.java", "f"].visibility == "private" and ids[by["A.java", "f"].parent_id] == "A"
    assert not [k for k in by if k[0] in ("bad.py", "x.yaml", "n.py")]


def test_name_search(spark):
    rows = [("1", "authenticate", "function", "auth.py", 1, "Python"), ("2", "authorize", "function", "auth.py", 9, "Python"), ("3", "Authenticate", "function", "handler.go", 1, "Go"),
            ("4", "login", "method", "auth.py", 5, "Python"), ("5", None, "method", "auth.py", 5, "Python")]
    s = spark.createDataFrame(rows, "id string, name string, type string, path string, start_line int, language string")
    got = Q.symbol_search(s, "authenticate").collect()
    assert [(r.id, r.score, r.match_type) for r in got[:2]] == [("1", 1.0, "exact"), ("3", 1.0, "exact")]
    typo = Q.symbol_search(s, "authentcate").collect()
    assert typo[0].score == round(SequenceMatcher(None, "authentcate", "authenticate").ratio(), 4)
    assert [r.id for r in Q.symbol_search(s, "auth", languages=["go"]).collect()] == ["3"]
    assert Q.symbol_search(s, "  ").count() == 0 and Q.symbol_search(s.limit(0), "x").count() == 0


def test_keyword_search(spark):
    df = spark.createDataFrame([("a", "x\r\ny Foo\nz\n"), ("b", ""), ("c", None), ("d", "foo")], "path string, text string")
    lines = Q.explode_lines(df, "path", "text")
    assert sorted((r.path, r.line_no, r.line) for r in lines.collect()) == [("a", 1, "x"), ("a", 2, "y Foo"), ("a", 3, "z"), ("d", 1, "foo")]
    odd = Q.explode_lines(spark.createDataFrame([("a", "1\x0b2\f3\u20284\x855\r6\r\n7\n\n8\n")], "path string, text string"), "path", "text")
    assert [(r.line_no, r.line) for r in odd.orderBy("line_no").collect()] == list(enumerate(["1", "2", "3", "4", "5", "6", "7", "", "8"], 1))
    assert [r.path for r in Q.first_hits(Q.keyword_hits(lines, "foo"), "path", 1).collect()] == ["a"]
    hits = Q.keyword_hits(lines, "foo")
    got = {r.path: (r.line_no, r.before, r.after) for r in Q.with_context(lines, hits, "path").collect()}
    assert got == {"a": (2, ["x"], ["z"]), "d": (1, [], [])}
    assert Q.keyword_hits(lines, "foo", case_sensitive=True).count() == 1 and Q.keyword_hits(lines, "f.o", regex=True).count() == 2 and Q.keyword_hits(lines, " ").count() == 0


def test_graph(spark):
    edges = spark.createDataFrame([("r", "f", "contains"), ("f", "c", "contains"), ("c", "m", "contains"), ("m", "x", "contains")], "src string, dst string, type string")
    focus = spark.createDataFrame([("c",)], "id string")
    assert {r.id for r in G.neighborhood(edges, focus, 1)[0].collect()} == {"f", "c", "m"}
    nodes, inside = G.neighborhood(edges, focus, 2)
    assert {r.id for r in nodes.collect()} == {"r", "f", "c", "m", "x"} and inside.count() == 4
    assert G.neighborhood(edges, focus.limit(0), 2)[0].count() == 0


def test_cycles_and_imports(spark):
    e = spark.createDataFrame([("r", a, b) for a, b in ("ab", "ba", "bc", "ca", "cd", "aa")], "repository_id string, src string, dst string")
    assert [r.cycle for r in G.import_cycles(e).orderBy("cycle").collect()] == [["a", "b"], ["a", "b", "c"]]
    assert G.import_cycles(e.limit(0)).count() == 0
    files = spark.createDataFrame([("r", "pkg/a.py"), ("r", "pkg/__init__.py"), ("r", "web/x/index.ts"), ("r", "web/b.js")], "repository_id string, path string")
    imp = spark.createDataFrame([("r", "m.py", "python", "pkg.a"), ("r", "m.py", "python", "pkg"), ("r", "web/b.js", "javascript", "./x"), ("r", "web/x/y.ts", "typescript", "../b"), ("r", "web/b.js", "javascript", "react")],
                                "repository_id string, path string, language string, module string")
    got = {(r.path, r.module): r.target for r in G.resolve_imports(imp, files).collect()}
    assert got == {("m.py", "pkg.a"): "pkg/a.py", ("m.py", "pkg"): "pkg/__init__.py", ("web/b.js", "./x"): "web/x/index.ts", ("web/x/y.ts", "../b"): "web/b.js"}


def test_cycles_of_any_length(spark):
    ring = [("r", f"n{i:02}", f"n{(i + 1) % 12:02}") for i in range(12)] + [("r", "n03", "out"), ("in", "a", "b")]
    many = [("q", a, b) for a in "abcdef" for b in "abcdef" if a != b]
    e = spark.createDataFrame(ring + many, "repository_id string, src string, dst string")
    got = {}
    for r in G.import_cycles(e).collect():
        got.setdefault(r.repository_id, []).append(r.cycle)
    assert got["r"] == [[f"n{i:02}" for i in range(12)]] and "in" not in got
    assert sorted(got["q"]) == sorted([a, b] for a in "abcdef" for b in "abcdef" if a < b)[:10]


def test_long_chains_of_callers(spark):
    """A chain of 70 callers is followed to its end."""
    rows = [("r", f"s{i:03}", f"f{i:03}", "function", f"def f{i:03}():\n    f{i - 1:03}()" if i else "def f000(): pass", "Python") for i in range(71)]
    s = spark.createDataFrame(rows, "repository_id string, id string, name string, type string, code string, language string")
    calls = G.resolved_calls(G.extract_calls(s), s)
    got = {r.id: r.distance for r in G.transitive_callers(calls, s, s.select(F.lit("f000").alias("name"))).collect()}
    assert got == {f"s{i:03}": i for i in range(1, 71)}


def test_calls_and_imports_outside_texts(spark):
    code = 'def f():\n    """g() in words"""\n    x = "h()"  # i()\n    return j(k)\n'
    s = spark.createDataFrame([("r", "1", "f", "function", code, " Python "), ("r", "2", "f", "function", "func f() { a(`b()`, 'c') /* d() */ }", "go"), ("r", "3", "f", "function", None, "go")],
                              "repository_id string, id string, name string, type string, code string, language string")
    assert {(r.caller, r.callee_name) for r in G.extract_calls(s).collect()} == {("1", "j"), ("2", "a")}
    long = "x = \"" + "\\\\n" * 20000 + "\"\nf()\n"
    assert one(spark, T.without_texts(F.lit(long), F.lit("python"))) == "x =  \nf()\n"
    files = [("r", "a.py", "Python", 'import os, a.b as c\nfrom d.e import f\nfrom . import g\ntry:\n    import h\nexcept E: pass\n"""\nimport no\n"""\n# import no\n'),
             ("r", "a.ts", "typescript", "import {\n  a,\n  b\n} from './m';\nimport './side';\nimport x from \"y\"; // import z from 'no'\nconst q = import('dyn');\n"),
             ("r", "a.go", "Go", 'package a\n\nimport "fmt"\nimport (\n\tx "a/b"\n\t// "no"\n\t"c"\n)\n'), ("r", "b.rs", "rust", "use a;"), ("r", "c.py", "python", None)]
    got = {}
    for r in G.extract_imports(spark.createDataFrame(files, "repository_id string, path string, language string, content string")).collect():
        got.setdefault(r.path, set()).add(r.module)
    assert got == {"a.py": {"os", "a.b", "d.e", "h"}, "a.ts": {"./m", "./side", "y"}, "a.go": {"fmt", "a/b", "c"}}


def test_nearest_enclosing(spark):
    rows = [("f", "a", 1, 20), ("f", "b", 2, 9), ("f", "c", 3, 4), ("f", "d", 8, 12), ("f", "e", 9, 9), ("f", "e2", 9, 9), ("f", "n", None, 3), ("g", "x", 3, 4)]
    got = {r.id: r.encloser for r in G.nearest_enclosing(spark.createDataFrame(rows, "file_id string, id string, start_line int, end_line int")).collect()}
    assert got == {"b": "a", "c": "b", "d": "a", "e": "d", "e2": "d"}


def test_calls_and_dead_code(spark):
    rows = [("r", "1", "helper", "function", "def helper():\n  pass", []), ("r", "2", "uses_helper", "function", "def uses_helper():\n  helper()", []), ("r", "3", "also", "function", "def also():\n  helper()\n  uses_helper()", []),
            ("r", "4", "orphan", "function", "def orphan(): pass", []), ("r", "5", "size", "method", "def size(self): pass", ["property"]), ("r", "6", "main", "function", "def main():\n  also()", [])]
    s = spark.createDataFrame([(*r, "p.py", 1) for r in rows], "repository_id string, id string, name string, type string, code string, decorators array<string>, path string, start_line int").withColumn("language", F.lit("Python"))
    calls = G.resolved_calls(G.extract_calls(s), s)
    deg = G.call_in_degree(calls, s)
    assert {r.id: r.callers for r in deg.collect()} == {"1": 2, "2": 1, "3": 1, "4": 0, "5": 0, "6": 0}
    reach = {r.id: r.distance for r in G.transitive_callers(calls, s, s.select(F.lit("helper").alias("name"))).collect()}
    assert reach == {"2": 1, "3": 1, "6": 2}
    assert G.transitive_callers(calls, s, s.select(F.lit("nobody").alias("name"))).count() == 0
    ident = spark.createDataFrame([("r", "orphan", 1), ("r", "size", 3)], "repository_id string, name string, occurrences long")
    assert [r.name for r in A.dead_code(s, deg, ident).collect()] == ["orphan"]
    assert [(r.name, r.callers) for r in A.shared_utilities(s, deg).collect()] == [("helper", 2)]


def test_patterns(spark):
    rows = [("k1", None, "UserRepository", "class"), ("k2", None, "Repository", "class"), ("k3", None, "OrderFactory", "class"), ("k4", None, "PayService", "class")]
    rows += [(f"m{i}", "k1", f"find_{i}", "method") for i in range(16)] + [("f", "k3", "create", "method"), ("g", "k2", "name", "method")]
    s = spark.createDataFrame([(*r, "r", "p", 1, 3, "sig") for r in rows], "id string, parent_id string, name string, type string, repository_id string, path string, start_line int, end_line int, signature string")
    k = A.class_methods(s)
    label, _ = A.design_pattern(F.col("name"))
    got = {r.name: (r.label, r.methods) for r in k.withColumn("label", label).collect()}
    assert got == {"UserRepository": ("Repository", 16), "Repository": (None, 1), "OrderFactory": ("Factory", 1), "PayService": ("Service", 0)}


def test_smells_singletons_and_model_findings(spark):
    rows = [("k1", None, "Pool", "class", "class Pool"), ("k2", None, "Port", "class", "class Port(Protocol)"), ("k3", None, "Big", "class", None)]
    rows += [("s", "k1", "getInstance", "method", "")] + [(f"p{i}", p, f"m{i}{p}", "method", "") for p in ("k2", "k3") for i in range(12)]
    s = spark.createDataFrame([(*r, "r", "a/b.py", 1, 3) for r in rows], "id string, parent_id string, name string, type string, signature string, repository_id string, path string, start_line int, end_line int")
    k = {r.name: (r.singleton, r.god, r.large) for r in A.size_smells(A.class_methods(s)).collect()}
    assert k == {"Pool": (True, False, False), "Port": (False, False, False), "Big": (False, False, True)}
    e = spark.createDataFrame([("k1", ["Users", "Unknown"], "API"), ("k2", ["Users"], "Unknown"), ("k3", [], "")], "symbol_id string, business_domain array<string>, architecture_layer string")
    assert {(r.category, r.title, r.confidence) for r in A.enrichment_findings(s, e).collect()} == {("business_domain", "Domain: Users", 0.6), ("architecture_layer", "Layer: API", 0.6)}
    assert [(r.path, r.role) for r in A.file_layers(s, e).collect()] == [("a/b.py", "API")] and A.file_layers(s, e.limit(0)).first().role == "a"


def test_blocks_of_vectors(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    data = np.round(rnd.normal(size=(60, 4)), 1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(100, [0.0] * 4), (101, None), (102, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    got = {}
    for r in V.knn(v.where("vec_id % 9 = 0"), v, 5).collect():
        got.setdefault(r.query_id, []).append(round(r.score, 9))
    for q in range(0, 60, 9):
        want = sorted((unit[q] @ unit[j] for j in range(60) if j != q), reverse=True)[:5]
        assert sorted(got[q], reverse=True) == [round(float(x), 9) for x in want]
    assert {r.dimension: r.n for r in V.dimensions(v).collect()} == {4: 61, 1: 1, None: 1} or V.dimensions(v).count() == 3
    with pytest.raises(Exception, match="dimensions"):
        V.of_dimension(v, 4).collect()


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from siltstone import session

    class Far:
        master = "spark://far:7077"
        getConf = spark.sparkContext.getConf

    class Session:
        sparkContext = Far()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            session.shared_dir(Session())


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in V.vector_topk(v.where("embedding is not null"), [1.0, 0.0], 2).collect()] == [1, 2]
    near = V.knn(v.where("vec_id = 1"), v.where("vec_id in (1, 2, 3)"), 5).collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in near] == [(1, 2, 0.6)]
    h = V.hash_embedding(spark.createDataFrame([("a", "Foo foo bar"), ("b", "")], "k string, t string"), "k", "t")
    assert abs(sum(r.value**2 for r in h.collect()) - 1) < 1e-9
    units = spark.createDataFrame([(1, "h", "m"), (2, "h", "m"), (3, "h", "m"), (4, None, "m")], "id long, content_hash string, model string")
    stored = spark.createDataFrame([(1, "h", "m"), (2, "x", "m"), (4, None, "m")], "id long, content_hash string, model string")
    assert {r.id: r.reason for r in V.embedding_delta(units, stored).collect()} == {2: "changed", 3: "new"} and V.embedding_delta(units, stored, True).count() == 4
    up = V.vector_upsert(v.select("vec_id", F.lit("old").alias("p")), spark.createDataFrame([(1, "new"), (9, "new")], "vec_id long, p string"))
    assert {(r.vec_id, r.p) for r in up.collect()} == {(1, "new"), (2, "old"), (3, "old"), (4, "old"), (5, "old"), (9, "new")}


def test_retrieval_blend(spark):
    src = lambda *r: spark.createDataFrame(r, "id string, score double")
    s = spark.createDataFrame([(i, i, "p", 1, dt.datetime(2024, 1, n)) for n, i in enumerate("abc", 1)], "id string, name string, path string, start_line int, updated_at timestamp")
    edges = spark.createDataFrame([("a", "c", "contains")], "src string, dst string, type string")
    got = {r.id: (r.score, r.sources) for r in R.hybrid_retrieve(s, edges, src(("a", 1.0)), src(("a", 0.5), ("b", 0.9)), src(("b", 0.34))).collect()}
    assert got["a"] == (round((0.3 + 0.175 + 0.0) * 1.08, 4), ["symbol", "vector"])
    assert got["c"][1] == ["graph"] and got["c"][0] == round(0.15 * 0.5 + 0.05, 4)


def test_model_calls(spark):
    def client(text):
        if "boom" in text:
            raise RuntimeError
        return 'Sure {"summary": " Fine ", "business_domain": ["Users", "Nonsense"], "architecture_layer": "API", "confidence": 7} ok' if "good" in text else "no json"

    df = spark.createDataFrame([("a", "good"), ("b", "boom"), ("c", "bad")], "id string, prompt string")
    got = {r.id: r for r in E.enrichment(E.call_model(df, "id", "prompt", client), "id").collect()}
    assert (got["a"].summary, got["a"].business_domain, got["a"].architecture_layer, got["a"].confidence) == ("Fine", ["Users"], "API", 1.0)
    for k in "bc":
        assert (got[k].summary, got[k].architecture_layer, got[k].confidence) == ("Unknown", "Unknown", 0.0)


def test_scalars(spark):
    assert one(spark, T.identifier_keywords(F.lit("parseHTTPUser_id"))) == ["httpuser", "id", "parse"]
    assert one(spark, T.first_line(F.lit("\n\n  def f():  \n x"))) == "def f():" and one(spark, T.first_line(F.lit(""))) == ""
    assert [one(spark, T.visibility(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in (("Python", "_x", "def _x():"), ("Python", "__a__", "def __a__"), ("go", "Foo", "func Foo()"), ("Java", "f", "private int f()"), ("Rust", "f", "pub fn f()"), ("C", "f", "f()"))] == ["private", "public", "public", "private", "public", "unknown"]
    assert one(spark, T.clamp(F.lit(float("nan")))) == 1.0 and one(spark, T.clamp(F.lit(-2.0))) == 0.0
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, T.l2_normalize(v)) == [0.6, 0.8] and one(spark, T.cosine(v, F.array(F.lit(1.0)))) == 0.0
    assert one(spark, Q.question_intent(F.lit("What is the biggest function?"))) == "biggest_functions" and one(spark, Q.question_intent(F.lit("hello"))) is None
