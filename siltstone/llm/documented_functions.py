"""Functions paired with their documentation (problem 2).

A text is lexed by a string- and comment-aware state machine. Outside Python
the comments, annotations and attributes in front of the declaration are read
first, the last documentation comment with no blank line between it and the
declaration is attached, and the braces of the body are matched to delimit the
function. In Python the signature is skipped to its colon and the docstring
taken from the first statement. The description is what remains of the comment
without markers, tags, parameter sections, directives and placeholders.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.lexing import language_key, skeleton

MIN_WORDS = 5

# How directives, placeholders, tags and sections are written.
_DIRECTIVE = re.compile(
    r"^\s*(?:nolint|noqa|nosec|nosonar|noinspection|go:\w+|export\s+\w+\s*$|line\s+\S+:\d+|\+build|eslint|tslint|jshint|jslint|"
    r"prettier|biome|deno-|pylint|mypy|flake8|ruff|pyright|type:\s*ignore|isort|yapf|fmt:|lint:|rustfmt|clippy|"
    r"istanbul|c8\s|v8\s|coverage:|pragma|cspell|spellchecker|sonar|checkstyle|formatter:|revive:|gosec|region\b|endregion\b|"
    r"@ts-|@formatter|@noinspection|@suppress|@flow|@jsx)",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"^\W*(?:todo|fixme|tbd|tba|xxx|wip|hack)\b|\bgoes here\b|\bfill (?:this|me|it)? ?in\b|\bauto-?generated\b|"
    r"\bplaceholder (?:doc|text|comment|description)|\breplace (?:this|me|the) (?:text|comment|doc|description|placeholder)|"
    r"\b(?:write|add|insert|provide|supply|put)\b[^.]{0,30}\b(?:description|documentation|docs?|docstring|text|comment|summary)\b[^.]{0,20}(?:\bhere\b|\blater\b|\bplease\b|\bmissing\b|\bfor this\b|$)|"
    r"\b(?:missing|no|needs?|pending|awaiting) (?:a |the )?(?:documentation|description|docs?|docstring)\b|"
    r"\bdocument (?:this|me|it)\b|\bexplain what this\b|\bdescribe (?:this|what this|the (?:function|method))\b|\blorem ipsum\b|\bmethod stub\b|\bto be (?:documented|written|described)\b",
    re.I,
)
_TEXT_TAG = re.compile(r"^\s*[@\\](?:description|desc|summary|brief|details|remarks)\b[ \t:]*", re.I)
_TAG = re.compile(r"^\s*(?:[@\\][A-Za-z]\w*|:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?|meta)\b[^:\n]*:)")
_SECTION = re.compile(
    r"^\s*(?:#+\s*)?(?:args|arguments|parameters|params|keyword args|keyword arguments|other parameters|attributes|returns?|"
    r"return values?|yields?|raises|throws|errors|panics|safety|examples?|usage|see also|references|notes?|warnings?|warns|todo)\s*:?\s*$",
    re.I,
)
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_CODE = re.compile(r"[;{}]\s*$|^\s*[\w.\[\]]+(?:,\s*\w+)*\s*(?::=|\+=|=)\s|^\s*[\w.]+\([^)]*\)\s*$|^\s*(?:case|default)\b.*:\s*$|^\s*(?:if|for|while|switch|return|defer|func|var)\b.*[({=:]")
_PY_SIGNATURE = re.compile(r"[ \t]*(?:async[ \t]+)?(?:def|class)\b")
_PY_STRING = re.compile(
    r"([rRuU]?)(\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')", re.S
)
_BLANKS = re.compile(r"[ \t]*")
_PY_SKIP = re.compile(r"(?:\s|\\\n|#(?!\s*\[\w+ [^\]]*\])[^\n]*(?:\n|$))*")


def _python_doc(code: str) -> tuple[str | None, int]:
    """The docstring and where the function ends."""
    depth, body = 0, None
    start = _declaration_line(code)
    for kind, a, _b in skeleton(code, "python", start):
        if kind != "b":
            continue
        ch = code[a]
        if ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == ":" and depth == 0:
            body = a + 1
            break
    if body is None:
        return None, len(code)
    at = _PY_SKIP.match(code, body).end()
    m = _PY_STRING.match(code, at)
    if not m:
        return None, len(code)
    if code[_BLANKS.match(code, m.end()).end() :][:1] not in ("", "\n", "#", ";", "\r"):  # a part of an expression
        return None, len(code)
    text = m.group(2)
    quote = 3 if text[:3] in ('"""', "'''") else 1
    return text[quote:-quote], _python_end(code, start, body)


def _python_end(code: str, start: int, body: int) -> int:
    """Where a function ends: before the first line, outside brackets and
    literals, that is indented no deeper than its declaration."""
    indent = len(code[start:]) - len(code[start:].lstrip(" \t"))
    depth, at = 0, body
    for kind, a, b in [*skeleton(code, "python", body), ("end", len(code), len(code))]:
        line = at
        while depth == 0 and (n := code.find("\n", line, a)) >= 0:
            line = n + 1
            text = code[line : code.find("\n", line) if code.find("\n", line) >= 0 else len(code)]
            bare = text.lstrip(" \t")
            if bare.strip() and bare[0] != "#" and len(text) - len(bare) <= indent:
                return line
        if kind == "b":
            depth = max(0, depth + (code[a] in "([{") - (code[a] in ")]}"))
        at = b
    return len(code)


def _declaration_line(code: str) -> int:
    """Where ``def`` stands: decorators may span lines and hold brackets."""
    depth, at = 0, 0
    m = _PY_SIGNATURE.match(code)
    if m:
        return 0
    for kind, a, b in skeleton(code, "python", 0):
        while depth == 0 and (n := code.find("\n", at, a)) >= 0:
            at = n + 1
            if _PY_SIGNATURE.match(code, at):
                return at
        if kind == "b":
            depth += (code[a] in "([{") - (code[a] in ")]}")
        at = max(at, b if depth else at)
    while (n := code.find("\n", at)) >= 0:
        at = n + 1
        if _PY_SIGNATURE.match(code, at):
            return at
    return 0


_LEAD = {
    k: re.compile(v, re.S)
    for k, v in {
        "c": r"//[^\n]*|/\*.*?\*/",
        "space": r"[ \t\r]*\n|[ \t\r]+",
        "annotation": r"@[\w.]+|#!?\[",
    }.items()
}


def _lead(code: str, language: str):
    """The comments in front of the declaration, up to it: a list of comments
    that stand with no blank line between, and where the declaration starts."""
    comments: list[str] = []
    at, n, newlines = 0, len(code), 0
    while at < n:
        if m := _LEAD["space"].match(code, at):
            newlines += m.group().count("\n")
            if newlines > 1:
                comments = []
            at = m.end()
            continue
        ch = code[at]
        if ch == "/" and (m := _LEAD["c"].match(code, at)):
            comments.append(m.group())
            at, newlines = m.end(), 0
        elif (ch == "@" and language in ("java", "typescript", "javascript") and not code.startswith("@interface", at)) or (
            ch == "#" and language == "rust"
        ):
            m = _LEAD["annotation"].match(code, at)
            if not m:
                break
            at = m.end()
            while code[at : at + 1] in (" ",) and code[at : at + 2] == " (":
                at += 1
            opened = m.group().endswith("[")
            if opened or code[at : at + 1] == "(":
                depth = 1 if opened else 0
                for kind, a, b in skeleton(code, language, at):
                    if kind == "b" and code[a] in "([{":
                        depth += 1
                    elif kind == "b" and code[a] in ")]}":
                        depth -= 1
                        if depth == 0:
                            at = b
                            break
                else:
                    break
            newlines = 0
        else:
            break
    return comments, at


def _is_doc(comment: str, language: str) -> bool:
    if language == "go":
        return True
    block = comment.startswith("/**") and comment[3:4] not in ("*", "/") and len(comment) > 4
    if language == "rust":
        return block or (comment.startswith("///") and not comment.startswith("////"))
    return block


def _body(comment: str) -> str:
    if comment.startswith("/*"):
        lines = comment[2:-2].lstrip("*").split("\n")
        return "\n".join(re.sub(r"^\s*\*(?!\*)[ \t]?", "", x) if i else x for i, x in enumerate(lines))
    return re.sub(r"^//+", "", comment)


def _function_end(code: str, language: str, start: int) -> int:
    """Just behind the brace that closes the body, or the declaration's semicolon."""
    depth, opened = 0, False
    for kind, a, b in skeleton(code, language, start):
        if kind != "b":
            continue
        ch = code[a]
        if ch in "([{":
            depth += 1
            opened |= ch == "{" and depth == 1
        elif ch in ")]}":
            depth -= 1
            if depth <= 0 and opened and ch == "}":
                return b
        elif ch == ";" and depth == 0:
            return b
    return len(code)


def description(text: str, name: str = "") -> str:
    """What a comment says, without tags, sections, directives and placeholders;
    empty if fewer than `MIN_WORDS` words are left or they only repeat the name."""
    kept: list[str] = []
    skip_indent = None
    in_tags = False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n"):
        if m := _TEXT_TAG.match(line):
            in_tags, skip_indent = False, None
            line = line[m.end() :]
        elif _TAG.match(line):
            in_tags = not line.lstrip().startswith(":") or in_tags
            skip_indent = len(line) - len(line.lstrip())
            continue
        if in_tags:
            continue
        if _SECTION.match(line):
            skip_indent = len(line) - len(line.lstrip())
            if line.lstrip().startswith("#"):
                skip_indent = -1  # a heading's section goes to the next heading
            continue
        if line.lstrip().startswith("#") and skip_indent == -1:
            skip_indent = None
        if skip_indent is not None:
            if not line.strip() or skip_indent == -1 or len(line) - len(line.lstrip()) > skip_indent:
                continue
            if re.match(r"^\s*-{3,}\s*$", line):
                skip_indent = -1
                continue
            skip_indent = None
        if _DIRECTIVE.match(line) or _CODE.search(line):
            continue
        kept.append(re.sub(r"<[^>\n]{1,40}>", " ", line).strip())
    text = " ".join(" ".join(kept).split())
    parts = [p for p in re.split(r"(?<=[.!?。])\s+", text) if not _PLACEHOLDER.search(p)]
    # "Placeholder documentation." next to "Replace this text ...": both go
    text = " ".join(parts).strip()
    words = _WORD.findall(text)
    cjk = len(_CJK.findall(text))
    count = cjk // 2 if cjk > 4 else len(words)
    if count < MIN_WORDS:
        return ""
    own = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)} | {"the", "a", "an", "function", "method", "this"}
    if not cjk and all(w.lower() in own for w in words):
        return ""
    return text


def document(code: str, language: str, name: str = "") -> tuple[str, str] | None:
    """(function text, description) or None."""
    if language == "python":
        doc, end = _python_doc(code)
    elif language in ("javascript", "typescript", "java", "rust", "go"):
        if not (code.startswith(("/", "@", "#")) or code[:1].isspace()):
            return None
        comments, at = _lead(code, language)
        own = [c for c in comments if _is_doc(c, language)]
        if not own:
            return None
        if language == "go":
            own = [c for c in own if not re.match(r"//[a-z0-9]+:[a-z0-9]", c)]
        elif language != "rust" or own[-1].startswith("/*"):
            own = own[-1:]
        doc = "\n".join(_body(c) for c in own)
        if not description(doc, name):
            return None
        end = _function_end(code, language, at)
    else:
        return None
    if doc is None:
        return None
    said = description(doc, name)
    return (code[:end], said) if said else None


def documented_functions(df: DataFrame) -> DataFrame:
    """``id, name, language, code, description``: one row per function or method
    with a non-trivial documentation comment of its own.

    `df` has the columns id, name, type, language and code; others are ignored.
    Repeated ids count once. Rows with a null id, code or language, of another
    type, or in a language without a rule here give no row; a null name is
    treated as empty; texts are read whole.
    """

    def run(batches):
        for batch in batches:
            keep, code, said = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("code", "language", "name")]
            for i, (text, language, name) in enumerate(zip(*cols)):
                got = document(text, language_key(language), name or "")
                if got:
                    keep.append(i)
                    code.append(got[0])
                    said.append(got[1])
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in ("id", "name", "language")] + [pa.array(code, pa.string()), pa.array(said, pa.string())],
                names=["id", "name", "language", "code", "description"],
            )

    rows = df.where(F.lower(F.trim("type")).isin("function", "method") & F.col("id").isNotNull() & F.col("code").isNotNull())
    return (
        rows.select("id", "name", "language", "code")
        .mapInArrow(run, "id string, name string, language string, code string, description string")
        .dropDuplicates(["id"])
    )
