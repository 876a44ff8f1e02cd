"""Generated, minified or vendored source files (problem 1).

Each file is lexed into comments, literals, names and punctuation, and its
canonical layout is emitted from them: a line per statement and brace, indented
by depth, with single blanks. Compared with that, the original layout tells: a
file of which hardly a line stands as the canonical form has it, and which grows
by several times when laid out, is minified; one whose canonical lines repeat a
single shape throughout, in sorted order, is the output of a tool; one that
consists of literals is dumped data. Generator headers in the comments before the
code, lock file names and forms, and the reference list of third-party files (by
content hash, or by file name) add the rest.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.lexing import language_key

CODE = ("python", "javascript", "typescript", "go", "java", "rust", "css", "c", "c++", "c#", "php", "swift", "kotlin")

#: Limits of the layout comparison.
EXPANSION = 6.0  # canonical lines per original line
WRAPPED_EXPANSION = 2.0  # where lines are wrapped and none of them is canonical
KEPT_SHARE = 0.1  # of the original lines are canonical in a minified file, at most
LINE_CHARS = 160  # characters per line of a minified file, at least
WRAPPED_CHARS = 60
DEEPEST = 40  # levels of indentation that are written out
LITERAL_SHARE = 0.7  # of the characters that are not white space
DATA_CHARS = 1200  # a smaller literal table may be written by hand
UNIFORM_SHARE = 0.7  # of the lines have one shape
UNIFORM_LINES = 8

# Wording of generator headers, and of comments that only speak of one.
_HEADER = re.compile(
    r"code generated by|@generated\b|<auto-generated|\bauto-?generated file\b|(?:is|was|were|been)\s+(?:automatically|auto-?)\s*generated\b|"
    r"\bgenerated (?:from|by|with|using) \S+|\bdo not (?:edit|modify)\b|\bany (?:manual )?changes? (?:is|are|will be|to this file will be) (?:overwritten|lost)\b|"
    r"\b(?:manual )?changes (?:will|may) be (?:lost|overwritten)\b|\bmachine[- ]generated\b|\bautomatically (?:generated|created|produced)\b",
    re.I,
)
_NO_HEADER = re.compile(
    r"\bused to\b|\bby hand\b|\bmaintained\b|\bnot this file\b|\bthis (?:module|script|file|tool|package|class|function) (?:writes|generates|emits|creates|produces|reads|parses)\b|"
    r"\breplaces?\b|\bmethod stub\b|\bwe\b|\bcode generation\b|\bunlike\b|\binstead of\b|\bfill in\b",
    re.I,
)
_TOOL_NAME = re.compile(r"\.generated\.|\.gen\.\w+$|\.g\.\w+$|_pb2(?:_grpc)?\.pyi?$|\.pb(?:\.gw)?\.\w+$|_pb\.(?:js|ts|d\.ts)$|_generated\.\w+$|OuterClass\.java$|\.designer\.\w+$", re.I)
_TOOL_DIR = re.compile(r"(?:^|/)(?:generated|gen|__generated__|\.gen)/")
_LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|composer\.lock|cargo\.lock|poetry\.lock|pipfile\.lock|gemfile\.lock|go\.sum|uv\.lock|packages\.lock\.json|[^/]*[.-]lock\.(?:json|ya?ml))$", re.I)
_LOCK_TEXT = re.compile(r'"?lockfile_?version"?\s*:|"?integrity"?\s*:\s*"?sha\d+-|^\s*checksum\s*[:=]\s*"?[0-9a-f]{40,}', re.I | re.M)
_VENDOR_DIR = re.compile(r"(?:^|/)(?:node_modules|bower_components|site-packages|third[_-]party|thirdparty|vendored|Godeps|Pods|jspm_packages)/", re.I)
_SMALL_NAME = re.compile(r"\.(?:min|bundle)\.\w+$", re.I)

_TOKEN = {
    "#": re.compile(r"(?P<c>\#[^\n]*)|(?P<s>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S),
    "/": re.compile(r"(?P<c>//[^\n]*|/\*.*?\*/)|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S),
}
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)\w{0,3}")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_EDGE = re.compile(r"([;{}\n])")
_SHORT = re.compile(r"(?<=[:,=\[(\s])\{([^{};\n=()]{0,60})\}")
_BRACES = {1: "{", 2: "}"}
#: A line that goes on: it ends in an operator or an open bracket.
_GOES_ON = re.compile(r"[=+\-*/%&|^<>?:.(\[\\]$")


def canonical(bare: str, language: str) -> list[str]:
    """The canonical lines of a text whose comments are gone and whose literals
    are folded: one per statement and brace, indented by depth (no further than
    `DEEPEST`). A short group in braces that is a value of names and literals
    stays on its line."""
    bare = _SHORT.sub("\x01\\1\x02", bare)
    out: list[str] = []
    python = language in ("python", "yaml")
    depth = held = 0  # braces; round and square brackets that are open
    line = ""
    for piece in _EDGE.split(bare):
        if piece in (";", "{", "}", "\n"):
            if held > 0 or (python and piece in "{}"):
                if piece != "\n":
                    line += piece
                    held += (piece == "{") - (piece == "}") if python else 0
                continue
            text = " ".join(line.split())
            if piece == "\n":
                if not text or (not python and _GOES_ON.search(text)):
                    continue
                out.append("    " * min(depth, DEEPEST) + text)
            elif piece == ";":
                if not text and out and out[-1][-1:] == "}":
                    out[-1] += ";"
                    line = ""
                    continue
                out.append("    " * min(depth, DEEPEST) + text + ";")
            elif piece == "{":
                out.append("    " * min(depth, DEEPEST) + (text + " {" if text else "{"))
                depth += 1
            else:
                if text:
                    out.append("    " * min(depth, DEEPEST) + text)
                depth = max(depth - 1, 0)
                out.append("    " * min(depth, DEEPEST) + "}")
            line = ""
        elif piece:
            line += piece if not line or line[-1] in "{}" else " " + piece
            held += piece.count("(") - piece.count(")")
            if python:
                held += piece.count("[") - piece.count("]")
            held = max(held, 0)
    text = " ".join(line.split())
    if text:
        out.append("    " * min(depth, DEEPEST) + text)
    return "\n".join(out).translate(_BRACES).split("\n") if out else out


def layout(text: str, language: str) -> dict:
    """What the canonical layout tells of a text's original layout."""
    literal = 0
    comment = 0

    def fold(m):
        nonlocal literal, comment
        if m.lastgroup == "c":
            comment += m.end() - m.start()
            return " "
        literal += m.end() - m.start()
        return '""'

    bare = _TOKEN["#" if language in ("python", "yaml") else "/"].sub(fold, text)
    lines = sum(1 for x in text.split("\n") if x.strip())
    laid = [x.strip() for x in canonical(bare, language)]
    rest = [x for x in (" ".join(y.split()) for y in bare.split("\n")) if x]
    known = set(laid)
    kept = sum(x in known for x in rest) / max(len(rest), 1)
    ink = sum(map(len, text.split())) - comment
    numbers = sum(map(len, _NUMBER.findall(bare))) if literal * 2 < ink else 0
    # punctuation between literals belongs to the table they form
    commas = bare.count(",")
    shapes = Counter(_NAME.sub("w", _NUMBER.sub("0", x)) for x in laid) if len(laid) >= UNIFORM_LINES else Counter()
    share, ordered = 0.0, False
    if shapes:
        shape, n = shapes.most_common(1)[0]
        share = n / len(laid)
        if share >= 0.4 and "w" in shape:
            same = [x for x in laid if _NAME.sub("w", _NUMBER.sub("0", x)) == shape]
            names = [_NAME.findall(x) for x in same]
            for column in range(min(3, min(map(len, names)))):
                got = [x[column].lower() for x in names]
                if len(set(got)) > len(got) * 0.8 and got == sorted(got):
                    ordered = True
    return {
        "lines": lines,
        "expansion": len(laid) / max(lines, 1),
        "kept_share": kept,
        "line_chars": ink / max(lines, 1),
        "literal_share": (literal + numbers + commas) / max(ink, 1),
        "uniform_share": share,
        "ordered": ordered,
        "ink": ink,
    }


_BLOCKS = (("/*", "*/"), ("{/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"))


def _generator_header(text: str) -> bool:
    """A comment in front of the code says that a tool wrote the file; the first
    two lines of code may be a package, an import or a directive."""
    code = 0
    inside = ""  # what ends the open comment
    for line in text.lstrip("\ufeff").split("\n"):
        s = line.strip()
        if not s:
            continue
        said = bool(inside)
        if not inside:
            for start, end in _BLOCKS:
                if s.startswith(start):
                    said, inside, s = True, end, s[len(start) :]
                    break
            else:
                said = s.startswith(("#", "//", "*", "--", ";", "%"))
        if not said:
            code += 1
            if code > 2:
                return False
            continue
        if _HEADER.search(s) and not _NO_HEADER.search(s):
            return True
        if inside and inside in s:
            inside = ""
    return False


def origin(path: str, language: str, text: str) -> str | None:
    """Why a file is not hand-written: lock, generated, minified, data or None."""
    if _LOCK_NAME.search(path) or (language in ("json", "yaml") and len(_LOCK_TEXT.findall(text)) >= 2):
        return "lock"
    if _generator_header(text):
        return "generated"
    if language not in CODE:
        return None
    f = layout(text, language)
    long_lines = f["line_chars"] >= LINE_CHARS
    wrapped = f["expansion"] >= WRAPPED_EXPANSION and f["kept_share"] <= KEPT_SHARE and f["line_chars"] >= WRAPPED_CHARS
    if f["ink"] >= 400 and (
        (f["expansion"] >= EXPANSION and long_lines)
        or wrapped
        or (_SMALL_NAME.search(path) and f["expansion"] >= 3 and f["line_chars"] >= 80)
    ):
        return "minified"
    if f["literal_share"] >= LITERAL_SHARE and f["ink"] >= DATA_CHARS:
        return "data"
    tool = _TOOL_NAME.search(path) is not None
    if f["lines"] >= UNIFORM_LINES and (
        (f["uniform_share"] >= UNIFORM_SHARE and f["ordered"]) or (tool and f["uniform_share"] >= 0.5)
    ):
        return "generated"
    if tool and (_TOOL_DIR.search(path) or f["uniform_share"] >= 0.3):
        return "generated"
    return None


def source_origins(files: DataFrame, contents: DataFrame, library: DataFrame) -> DataFrame:
    """``file_id, repository_id, path, size_bytes, origin`` for every file with
    contents; `origin` is lock, generated, minified, data, vendored or null for
    hand-written source.

    Files that repeat an id count once; files without contents, and rows with a
    null id or content, give no row; a null path, repository or language is
    treated as empty; a null size is taken from the content's UTF-8 bytes;
    contents are read whole; other columns are ignored.
    """
    one = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(
        *[F.min(c).alias(c) for c in ("repository_id", "path", "language", "size_bytes")]
    )
    text = contents.where("file_id is not null and content is not null").select("file_id", "content")
    both = text.join(one, "file_id")

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("path", "language", "content", "size_bytes")]
            why, digest, size = [], [], []
            for path, language, content, n in zip(*cols):
                raw = content.encode("utf-8", "surrogatepass")
                digest.append(hashlib.blake2b(raw, digest_size=16).hexdigest())
                size.append(len(raw) if n is None else n)
                why.append(origin(path or "", language_key(language), content))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("file_id", "repository_id", "path", "language")]
                + [pa.array(size, pa.int64()), pa.array(digest), pa.array(why, pa.string())],
                names=["file_id", "repository_id", "path", "language", "size_bytes", "digest", "why"],
            )

    seen = both.mapInArrow(
        run, "file_id string, repository_id string, path string, language string, size_bytes long, digest string, why string"
    )
    # the lists hold one row per known content or name, so neither join grows the rows
    hashes = library.where("content_hash is not null").select(F.col("content_hash").alias("digest")).distinct()
    names = library.where("file_name is not null").select(
        F.col("file_name").alias("base"), F.lower(F.trim("language")).alias("kind")
    ).distinct()
    seen = seen.withColumn("base", F.substring_index("path", "/", -1)).withColumn("kind", F.lower(F.trim("language")))
    seen = (
        seen.join(hashes.withColumn("by_hash", F.lit(True)), "digest", "left")
        .join(names.withColumn("by_name", F.lit(True)), ["base", "kind"], "left")
    )
    vendored = (
        F.col("by_hash").isNotNull()
        | F.col("by_name").isNotNull()
        | (F.col("path").rlike("(?i)" + _VENDOR_DIR.pattern) & F.col("kind").isin(*CODE))
    )
    return seen.select(
        "file_id", "repository_id", "path", "size_bytes", F.when(vendored, F.lit("vendored")).otherwise(F.col("why")).alias("origin")
    )
