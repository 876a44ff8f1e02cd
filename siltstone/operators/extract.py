"""Symbols of source files: one row per declaration, made inside Spark tasks.

Python is read with its own parser; the other languages by the declaration
patterns below and brace matching. Files are independent rows, so the work
spreads with the partitions; parents follow from the spans afterwards, in
Spark.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import blake2b, first_line, visibility
from siltstone.operators.graph import nearest_enclosing

# How declarations start, by language: (kind, pattern with the name in group 1).
DECLARATIONS = {
    "javascript": [("class", r"^[ \t]*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
                   ("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*(?::[^=\n]+)?=>"),
                   ("method", r"^[ \t]+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\s*=)(\w+)\s*\([^)\n]*\)\s*(?::[^{\n]+)?\{")],
    "go": [("method", r"^func\s*\([^)\n]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("const", r"^const\s+(\w+)")],
    "rust": [("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"), ("struct", r"^[ \t]*(?:pub\s+)?struct\s+(\w+)"),
             ("trait", r"^[ \t]*(?:pub\s+)?trait\s+(\w+)"), ("enum", r"^[ \t]*(?:pub\s+)?enum\s+(\w+)"), ("const", r"^[ \t]*(?:pub\s+)?const\s+(\w+)")],
    "java": [("class", r"^[ \t]*(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)"), ("interface", r"^[ \t]*(?:(?:public|private|protected)\s+)*interface\s+(\w+)"),
             ("enum", r"^[ \t]*(?:(?:public|private|protected)\s+)*enum\s+(\w+)"),
             ("method", r"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!return\b|new\b|else\b|throw\b)[\w<>\[\], ]+\s+(\w+)\s*\([^)\n]*\)\s*(?:throws [\w, .]+)?\{")],
}
_C_FUNCTION = r"^(?!(?:else|return|if|for|while|switch|do|typedef)\b)(?:[A-Za-z_][\w:<>,]*[ \t*&]+)+[*&]*((?:\w+::)*~?\w+)[ \t]*\([^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*\)[ \t\n]*(?:const\b|noexcept\b|override\b|[ \t\n])*\{"
DECLARATIONS["c"] = [("function", _C_FUNCTION), ("struct", r"^[ \t]*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(\w+)\s*\{")]
DECLARATIONS["c++"] = [
    *DECLARATIONS["c"], ("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(\w+)[^;{()]*\{"), ("namespace", r"^[ \t]*(?:inline\s+)?namespace\s+(\w+)\s*\{"),
    ("enum", r"^[ \t]*enum\s+(?:class|struct)\s+(\w+)[^;{]*\{"), ("method", r"^[ \t]+" + _C_FUNCTION[1:])]
_CS_WORDS = r"(?:(?:public|private|protected|internal|static|abstract|sealed|partial|async|override|virtual|readonly|final)\s+)*"
DECLARATIONS["c#"] = [
    ("class", rf"^[ \t]*{_CS_WORDS}(?:class|record)\s+(\w+)"), ("interface", rf"^[ \t]*{_CS_WORDS}interface\s+(\w+)"), ("struct", rf"^[ \t]*{_CS_WORDS}struct\s+(\w+)"),
    ("enum", rf"^[ \t]*{_CS_WORDS}enum\s+(\w+)"), ("namespace", r"^[ \t]*namespace\s+([\w.]+)"),
    ("method", rf"^[ \t]+{_CS_WORDS}(?!return\b|new\b|else\b|throw\b|using\b|await\b)[\w<>\[\],.?]+\s+(\w+)\s*\([^)\n]*\)\s*(?:where [^{{\n]+)?(?:\{{|=>)")]
DECLARATIONS["php"] = [
    ("class", rf"^[ \t]*{_CS_WORDS}class\s+(\w+)"), ("interface", r"^[ \t]*interface\s+(\w+)"), ("trait", r"^[ \t]*trait\s+(\w+)"), ("enum", r"^[ \t]*enum\s+(\w+)"),
    ("function", rf"^[ \t]*{_CS_WORDS}function\s+&?(\w+)\s*\(")]
DECLARATIONS["typescript"] = [*DECLARATIONS["javascript"], ("interface", r"^[ \t]*(?:export\s+)?interface\s+(\w+)"), ("enum", r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+(\w+)")]
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in DECLARATIONS.items()}
_SKIP = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\[^\n]{1,8})'|`(?:[^`\\]|\\.)*`|[{};]""", re.S)


def _python(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = text.split("\n")
    out = []
    todo = [(n, True) for n in tree.body]
    while todo:
        node, top = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            names = [ast.unparse(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
            out.append((kind, node.name, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), names))
        elif isinstance(node, ast.Assign) and top:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    out.append(("global", t.id, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), []))
        todo += [(n, False) for n in ast.iter_child_nodes(node) if isinstance(n, ast.stmt)]
    return out


def _blank(m: re.Match) -> str:
    """A comment or literal as characters that no declaration has, with its line
    ends; brackets stay."""
    t = m.group()
    return t if t in "{};" else re.sub(r"[^\n]", "\0", t)


def _braced(text: str, language: str) -> list[tuple]:
    out = []
    bare = _SKIP.sub(_blank, text)  # a declaration in a comment or a literal is none
    for kind, pattern in _COMPILED[language]:
        for m in pattern.finditer(bare):
            depth, end = 0, len(text)
            at = m.end() - 1 if text[m.end() - 1] == "{" else m.end()
            for t in _SKIP.finditer(text, at):
                ch = t.group()
                if ch == "{":
                    depth += 1
                elif ch == "}":
                    depth -= 1
                    if depth <= 0:
                        end = t.end() if depth == 0 else t.start()
                        break
                elif ch == ";" and depth == 0:
                    end = t.end()
                    break
            start = m.start(1)
            begin = text.rfind("\n", 0, start) + 1
            first = text.count("\n", 0, start) + 1
            out.append((kind, m.group(1), first, first + text.count("\n", start, end), text[begin:end], []))
    return out


def extract(text: str, language: str) -> list[tuple]:
    """(kind, name, start line, end line, code, decorators); nothing for a text
    that does not parse or a language that is not read."""
    if language == "python":
        return _python(text)
    return _braced(text, language) if language in _COMPILED else []


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (repository_id, path, language, content): ids from
    repository, path, kind, name and line; parents by the nearest enclosing
    span; functions in a class are methods, nested globals are dropped, globals
    in capitals are constants."""
    schema = "repository_id string, path string, language string, type string, name string, start_line int, end_line int, code string, decorators array<string>"

    def run(batches):
        for batch in batches:
            rows = {c: [] for c in ("repository_id", "path", "language", "type", "name", "start_line", "end_line", "code", "decorators")}
            for repo, path, language, text in zip(*[batch.column(c).to_pylist() for c in ("repository_id", "path", "language", "content")]):
                seen = set()
                for kind, name, a, b, code, deco in extract((text or "").replace("\r\n", "\n"), (language or "").strip().lower()):
                    if (a, b, kind, name) not in seen:
                        seen.add((a, b, kind, name))
                        for k, v in zip(rows, (repo, path, language, kind, name, a, b, code, deco)):
                            rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                *[(c, pa.string()) for c in ("repository_id", "path", "language", "type", "name")], ("start_line", pa.int32()), ("end_line", pa.int32()),
                ("code", pa.string()), ("decorators", pa.list_(pa.string()))]))

    raw = files.select("repository_id", "path", "language", "content").mapInArrow(run, schema).withColumn(
        "id", F.md5(F.concat_ws("|", "repository_id", "path", "type", "name", F.col("start_line").cast("string")))
    )
    spans = raw.select(F.concat_ws("|", "repository_id", "path").alias("file"), "id", "start_line", "end_line", (~F.col("type").isin("global", "const")).alias("holds"))
    outer = raw.select(F.col("id").alias("p"), F.col("type").alias("p_type"))
    parent = nearest_enclosing(spans, "file").join(outer, F.col("encloser") == F.col("p")).select("id", F.struct("p", "p_type").alias("x"))
    kind = (
        F.when((F.col("type") == "function") & F.col("x.p_type").isin("class", "interface", "struct", "trait"), "method")
        .when((F.col("type") == "global") & F.rlike("name", F.lit("^[A-Z][A-Z0-9_]*$")), "const").otherwise(F.col("type"))
    )
    out = raw.join(parent, "id", "left").where("not (type = 'global' and x is not null)")
    line = first_line(F.col("code"))
    return out.select(
        "id", "repository_id", "path", "language", kind.alias("type"), "name", "start_line", "end_line", line.alias("signature"),
        visibility(F.col("language"), F.col("name"), line).alias("visibility"), F.col("x.p").alias("parent_id"), "code", blake2b("code").alias("hash"), "decorators",
    )
