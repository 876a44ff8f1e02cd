"""String- and comment-aware lexing of single source texts, used inside tasks.

``language_key`` folds the spellings of a language label. ``skeleton`` walks the
comments, literals and brackets of a text and skips everything else; it is the
state machine that the operators on source text share.
"""

from __future__ import annotations

import re

LANGUAGES = ("python", "javascript", "typescript", "go", "java", "rust", "json")

_DQ = r'"(?:[^"\\\n]|\\.)*"'
_SQ = r"'(?:[^'\\\n]|\\.)*'"
_LINE = r"//[^\n]*"
_BLOCK = r"/\*.*?\*/"
_REGEX = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"
_BRACKET = r"[{}()\[\];]"

#: name of the group -> what it is: c comment, s string, b bracket, x possible regular expression, o other
_SKELETON = {
    "python": rf"(?P<c>\#[^\n]*)|(?P<s>[rRbBuUfF]{{0,2}}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|{_DQ}|{_SQ}))|(?P<b>[{{}}()\[\]:])|(?P<o>[A-Za-z_0-9]+)",
    "javascript": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|{_SQ}|`(?:[^`\\]|\\.)*`)|(?P<b>{_BRACKET})|(?P<x>/)|(?P<o>[^\s\w])|(?P<w>\w+)",
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|`[^`]*`|{_SQ})|(?P<b>{_BRACKET})",
    "java": rf'(?P<c>{_LINE}|{_BLOCK})|(?P<s>"""(?:[^\\]|\\.)*?"""|{_DQ}|{_SQ})|(?P<b>{_BRACKET})',
    "rust": rf"""(?P<c>{_LINE}|{_BLOCK})|(?P<s>b?r(?P<h>\#*)".*?"(?P=h)|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)')|(?P<b>{_BRACKET})""",
}
_SKELETON["typescript"] = _SKELETON["javascript"]
SKELETON = {k: re.compile(v, re.S) for k, v in _SKELETON.items()}
REGEX_LITERAL = re.compile(_REGEX)
_JS_BEFORE = r"(?:[=(,:;!&|?{}\[+<>\n]|\b(?:return|typeof|case|in|of|do|else|await|yield))\s*"
_TEXTS = {
    "python": r"(?P<c>\#[^\n]*)|(?P<s>(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|" + rf"{_DQ}|{_SQ}))",
    "javascript": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|{_SQ}|`(?:[^`\\]|\\.)*`)|{_JS_BEFORE}(?P<x>{_REGEX})",
    "go": rf"(?P<c>{_LINE}|{_BLOCK})|(?P<s>{_DQ}|`[^`]*`|{_SQ})",
    "java": rf'(?P<c>{_LINE}|{_BLOCK})|(?P<s>"""(?:[^\\]|\\.)*?"""|{_DQ}|{_SQ})',
    "rust": rf"""(?P<c>{_LINE}|{_BLOCK})|(?P<s>\bb?r(?P<h>\#*)".*?"(?P=h)|"(?:[^"\\]|\\.)*"|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)')""",
}
_TEXTS["typescript"] = _TEXTS["javascript"]
#: comments 'c' and literals 's' only; regular expressions 'x' are passed over
TEXTS = {k: re.compile(v, re.S) for k, v in _TEXTS.items()}
#: after these words a slash starts a regular expression
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield"}


def language_key(label: str | None) -> str:
    return (label or "").strip().lower()


def skeleton(text: str, language: str, start: int = 0):
    """(kind, start, end) of comments 'c', strings 's' and brackets 'b', in order.

    Whether a slash divides or starts a regular expression in JavaScript and
    TypeScript follows from the token before it; the expression counts as a
    string."""
    find = SKELETON[language].finditer if language not in ("javascript", "typescript") else None
    if find:
        for m in find(text, start):
            kind = m.lastgroup
            if kind == "h":
                kind = "s"
            if kind != "o":
                yield kind, m.start(), m.end()
        return
    scan = SKELETON[language]
    at, value = start, False  # value: the last token ends an operand
    while m := scan.search(text, at):
        kind, a, at = m.lastgroup, m.start(), m.end()
        if kind == "w":
            value = m.group() not in _BEFORE_REGEX
        elif kind == "o":
            value = False
        elif kind == "x":
            if value or not (r := REGEX_LITERAL.match(text, a)):
                value = False
            else:
                at, value = r.end(), True
                yield "s", a, at
        else:
            if kind == "b":
                value = text[a] in ")]}"
            elif kind == "s":
                value = True
            yield kind, a, at
