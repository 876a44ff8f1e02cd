"""Source files that do not parse (problem 4).

A text is cut into chunks at line ends. Each chunk is summarised on its own, as
a map from the lexer states it may start in to the state it ends in and to what
is left of its tokens: every bracket group that opens and closes within the
chunk is judged by the local grammars and folded to one code, so brackets
without a partner and the codes around them remain. Two neighbouring summaries
combine by joining what is left and folding again, which is associative; so
chunks are summarised wherever they lie, summaries are combined within a task
first, and what a whole file leaves is judged once. The verdict does not depend
on where a text is cut.

A chunk's map holds the usual states. Where a file enters a chunk in another one
(inside the fields of a template, a string that a backslash continues) the chunk
is read again from that state as it is combined.
"""

from __future__ import annotations

import pickle
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import grammars as gr
from siltstone.llm.lexing import LANGUAGES, language_key

CHUNK = 1 << 16

_WS = r"[ \t\f\v\r\ufeff\u00a0\u2028\u2029]*"
_CONFLICT = r"(?P<conflict>^(?:<{7}|={7}|>{7}|\|{7})(?![<=>|]).*$)"
_NL = r"(?P<nl>(?:\n[ \t\f\v\r]*)+)"
_BRACKET = r"(?P<b>[{}()\[\];])"
_NUM = r"(?P<n>\.?\d(?:[eEpP][-+](?=\d)|[\w])*(?:\.\d[\w]*)*)"
_OPS = r"(?P<p>>>>=|\.\.\.|=>|->|::|:=|<-|[-+*/%&|^<>=!?]=|&&|\|\||\?\?|\+\+|--|\?\.|\.\.=?|[-+*/%&|^<>=!?~.,:@$\\])"
_COMMENT = r"(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<block>/\*)"
_DQ = r'"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"'
_SQ = r"'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'"
_CUT = r"(?P<cut>(?:\"(?:[^\"\\\n]|\\[\s\S])*|'(?:[^'\\\n]|\\[\s\S])*)\\\n\Z)"


def _tokens(*parts: str) -> re.Pattern:
    return re.compile(_WS + "(?:" + "|".join(parts) + r"|(?P<bad>\S)|(?P<end>\Z))", re.M)


_JS = _tokens(
    r"(?P<w>\#?[^\W\d][\w$]*|\$[\w$]*)", _NL, _CONFLICT, _COMMENT, _BRACKET,
    rf"(?P<s>{_DQ}|{_SQ})", r"(?P<tick>`)", _CUT, _NUM, r"(?P<x>/=?)", _OPS,
)
_GO = _tokens(
    r"(?P<w>[^\W\d]\w*)", _NL, _CONFLICT, _COMMENT, _BRACKET,
    r"""(?P<s>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')""", r"(?P<rawtick>`)", _NUM, _OPS,
)
_JAVA = _tokens(
    r"(?P<w>[^\W\d][\w$]*|\$[\w$]*)", _NL, _CONFLICT, _COMMENT, _BRACKET,
    r'''(?P<s>"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?!"")(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')''', r'(?P<text>""")', _NUM, _OPS,
)
_RUST = _tokens(
    r"(?P<w>(?:r\#)?[^\W\d]\w*(?![\"'\#\w]))", _NL, _CONFLICT, r"(?P<c>//[^\n]*)|(?P<block>/\*)", _BRACKET,
    r'''(?P<s>(?:b|c)?r(?P<h>\#*)"[\s\S]*?"(?P=h)|(?:b|c)?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\(?:[^ux\n]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]*\}))')''',
    r"(?P<l>'[^\W\d]\w*)", r'(?P<raw>(?:b|c)?r(?P<hs>\#*)")', r'(?P<str>(?:b|c)?")', r"(?P<v>(?:r\#)?[^\W\d]\w*)",
    r"(?P<n>\d(?:[eE][-+](?=\d)|\w)*(?:\.\d\w*)*)", _OPS[:-2] + r"\#])",
)
_JSON = _tokens(
    r'(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")', r"(?P<b>[{}()\[\]])", r"(?P<p>[,:])", r"(?P<nl>\n+)",
    r"(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?(?![\w.]))", r"(?P<w>[^\W\d]\w*)",
)
_JSON = re.compile(_JSON.pattern.replace(_WS, r"[ \t\r]*", 1))
_BLOCK_END = re.compile(r"\*/")
_BLOCK_EDGE = re.compile(r"/\*|\*/")
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:(?P<end>`)|(?P<field>\$\{)|\Z)")
_TEXT_END = re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""')
_STR_END = re.compile(r'(?:[^"\\]|\\[\s\S])*"')
_QUOTE_END = {q: re.compile(rf"(?:[^{q}\\\n]|\\[\s\S])*(?:(?P<end>{q})|(?P<cut>(?<=\\\n)\Z))") for q in "\"'"}
_TOKENS = {"javascript": _JS, "typescript": _JS, "go": _GO, "java": _JAVA, "rust": _RUST}
#: States, other than plain code, that a chunk's map holds from the start.
_STATES = {
    "javascript": ("block", "block+", "tick"), "typescript": ("block", "block+", "tick"), "go": ("block", "rawtick"),
    "java": ("block", "text"), "rust": ("block", "str"), "json": (), "python": ('t"""', "t'''"),
}

# (state at the end, codes, an error was met); a state is "mode" or "mode;fields"
Read = tuple[str, list[str], bool]


def _read_braces(text: str, language: str, state: str) -> tuple[str, list[str], bool, bool]:
    """Codes of a chunk in a language with braces. The last value tells whether
    they depend on the token before the chunk (a slash that divides or not)."""
    js = language in ("javascript", "typescript")
    before = gr.TS_BEFORE if language == "typescript" else gr.JS_BEFORE
    keys = gr.KEYWORDS[language]
    go = language == "go"
    mode, _, rest = state.partition(";")
    fields = [int(x) for x in rest.split(",")] if rest else []  # open braces within each open template field
    out: list[str] = ["\n"] if mode.startswith(("code", "block")) else []
    first_slash = False
    known = False  # a token of this chunk came before
    value = mode.endswith("+")  # the last token ends an operand
    mode = mode.rstrip("+")
    brace = False  # the last token is a closing brace
    k1 = ""
    new = True
    at, n = 0, len(text)
    match = _TOKENS[language].match

    def done(mode: str):
        if mode in ("code", "block") and value:
            mode += "+"
        if fields:
            mode += ";" + ",".join(map(str, fields))
        return mode, out, False, first_slash

    while True:
        # the rest of a literal or comment that began before
        if mode != "code":
            if mode.startswith("block"):
                depth = int(mode[5:] or 1)
                if language == "rust":
                    for m in _BLOCK_EDGE.finditer(text, at):
                        depth += 1 if m.group() == "/*" else -1
                        if not depth:
                            break
                    if depth:
                        return done(f"block{depth}" if depth > 1 else "block")
                    at = m.end()
                else:
                    m = _BLOCK_END.search(text, at)
                    if not m:
                        return done("block")
                    new = new or "\n" in text[at : m.end()]
                    at = m.end()
            else:
                if mode == "tick":
                    m = _TEMPLATE.match(text, at)
                    if m.lastgroup == "field":
                        at = m.end()
                        out.append("${")
                        fields.append(0)
                        mode, value, k1, brace = "code", False, "b", False
                        continue
                    end = m.end() if m.lastgroup == "end" else -1
                elif mode == "rawtick":
                    end = text.find("`", at) + 1 or -1
                elif mode.startswith("raw"):
                    close = '"' + "#" * int(mode[3:])
                    end = text.find(close, at)
                    end = end + len(close) if end >= 0 else -1
                elif mode.startswith("q"):
                    m = _QUOTE_END[mode[1]].match(text, at)
                    if not m:
                        return "code", [], True, first_slash
                    end = m.end() if m.lastgroup == "end" else -1
                else:
                    m = (_TEXT_END if mode == "text" else _STR_END).match(text, at)
                    end = m.end() if m else -1
                if end < 0:
                    return done(mode)
                at = end
                value, k1, new, brace, known = js, "s", False, False, True
            mode = "code"
        m = match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "nl":
            new = True
            if go:
                out.append("\n")
            continue
        if kind == "c":
            new = new or "\n" in m.group()
            continue
        if kind == "end":
            return done("code")
        if kind == "w" or kind == "v":
            tok = m.group(kind)
            if tok not in keys:
                tok, value = "w", js
            else:
                value = js and tok not in before
            if new and k1 in ("w", "n", "s") and not go:
                out.append("\n")
            out.append(tok)
            k1 = "w"
        elif kind == "b":
            tok = m.group("b")
            out.append(tok)
            if js:
                value = tok in ")]"
                if fields:
                    if tok == "{":
                        fields[-1] += 1
                    elif tok == "}":
                        fields[-1] -= 1
                        if fields[-1] < 0:
                            fields.pop()
                            mode = "tick"
            k1, new, known, brace = "b", False, True, tok == "}"
            continue
        elif kind == "p":
            out.append(m.group("p"))
            k1, value = "p", False
        elif kind in ("s", "n", "h"):
            if new and k1 in ("w", "n", "s") and not go:
                out.append("\n")
            out.append("0" if kind == "n" else '"')
            k1, value = "n" if kind == "n" else "s", js
        elif kind == "l":
            out.append("'")
            k1 = "l"
        elif kind == "x":
            if not known:
                first_slash = True
            a = m.start("x")
            r = None if value or (brace and not new) else _REGEX.match(text, a)
            if r:
                at = r.end()
                if new and k1 in ("w", "n", "s"):
                    out.append("\n")
                out.append('"')
                k1, value = "s", True
            else:
                out.append(m.group("x"))
                k1, value = "p", False
        elif kind == "block":
            mode = "block"
            continue
        elif kind in ("tick", "rawtick", "text", "str", "raw", "hs", "cut"):
            if new and k1 in ("w", "n", "s") and not go:
                out.append("\n")
            out.append("`" if kind == "tick" else '"')
            mode = f"raw{len(m.group('hs'))}" if kind in ("raw", "hs") else kind
            if kind == "cut":
                mode, at = "q" + m.group("cut")[0], n
            k1, value, new, brace, known = "s", js, False, False, True
            if kind not in ("tick", "cut"):
                return done(mode)
            continue
        else:
            return "code", [], True, first_slash
        new, known, brace = False, True, False


_S3 = "[^{q}\\\\]*(?:(?:\\\\[\\s\\S]|{q}(?!{q}{q}))[^{q}\\\\]*)*{q}{q}{q}"
_PY = re.compile(
    r"[ \t\f]*(?:(?P<w>[^\W\d]\w*(?![\"'\w]))|(?P<nl>(?:[ \t\f]*(?:\#[^\n]*)?\n)+[ \t\f]*)|(?P<b>[{}()\[\]])|"
    r"(?P<s>(?P<pre>[rR][bB]?|[bB][rR]?|[uU])?(?:\"\"\"" + _S3.format(q='"') + "|'''" + _S3.format(q="'")
    + r"|\"(?!\"\")[^\"\\\n]*(?:\\[\s\S][^\"\\\n]*)*\"|'(?!'')[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'))|"
    r"(?P<f>(?:[fF][rR]?|[rR][fF])(?P<fq>\"\"\"|'''|\"|'))|(?P<t>(?P<tpre>[rR][bB]?|[bB][rR]?|[uU])?(?P<tq>\"\"\"|'''))|"
    r"(?P<cut>(?P<cpre>[rR][bB]?|[bB][rR]?|[uU])?(?:\"(?:[^\"\\\n]|\\[\s\S])*|'(?:[^'\\\n]|\\[\s\S])*)\\\n\Z)|"
    r"(?P<v>[^\W\d]\w*)|(?P<n>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|"
    r"(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?)(?!\w))|"
    r"(?P<p>\*\*=?|//=?|>>=?|<<=?|->|:=|\.\.\.|[-+*/%@&|^=!<>]=|[-+*/%@&|^~<>=.,:;])|(?P<conv>![rsa](?=[ \t]*[:}]))|"
    r"(?P<join>\\\n)|(?P<c>\#[^\n]*)|(?P<bad>[\s\S])|(?P<end>\Z))"
)
_PY_TEXT = {q: re.compile(_S3.format(q=q[0])) for q in ('"""', "'''")}
_PY_FIELD = {  # literal text of an f-string up to its end, a field or a line end
    q: re.compile(
        r"(?:[^\\\n{}" + q[0] + r"]|\\(?:N\{[^}\n]*\}|[^{}]|(?=[{}]))|\{\{|\}\}" + (rf"|\n|{q[0]}(?!{q[0]}{q[0]})" if len(q) == 3 else "") + r")*"
        rf"(?:(?P<end>{q})|(?P<field>\{{)|(?P<eof>\Z))"
    )
    for q in ('"""', "'''", '"', "'")
}
_PY_SPEC = {q: re.compile(r"[^{}" + q[0] + ("" if len(q) == 3 else r"\n") + r"]*(?:(?P<end>\})|(?P<field>\{))") for q in _PY_FIELD}
_ESCAPES = re.compile(r"\\(?:(x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^}]+\}))|[\s\S])")


def _escape_error(text: str, prefix: str) -> bool:
    """A string literal whose escapes or characters are a syntax error."""
    p = prefix.lower()
    if "b" in p:
        if not text.isascii():
            return True
        return "r" not in p and "\\x" in text and any((m.group(1) or "")[:1] == "x" for m in _ESCAPES.finditer(text))
    if "r" in p or not ("\\x" in text or "\\u" in text or "\\U" in text or "\\N" in text):
        return False
    return any(m.group(1) for m in _ESCAPES.finditer(text))


def _column(indent: str) -> str:
    indent = indent[indent.rfind("\f") + 1 :]
    if "\t" not in indent:
        return f"\n{len(indent)}"
    col = alt = 0
    for ch in indent:
        col = (col // 8 + 1) * 8 if ch == "\t" else col + 1
        alt += 1
    return f"\n{col},{alt}"


def _read_python(text: str, state: str) -> Read:
    """Codes of a chunk of Python; a line's end is a code with the next columns."""
    mode, _, rest = state.partition(";")
    # open fields of f-strings: [brackets open within, mode to go back to]
    fields = [[int(x.split(":", 1)[0]), x.split(":", 1)[1]] for x in rest.split(",")] if rest else []
    out: list[str] = []
    at, n = 0, len(text)
    bad: Read = ("code", [], True)
    if mode == "code" and n:
        m = _PY_START.match(text)
        out.append(_column(m.group(1)))
        at = m.end()
    elif mode == "cont":
        mode = "code"

    def done(mode: str) -> Read:
        return (mode + ";" + ",".join(f"{d}:{m}" for d, m in fields) if fields else mode), out, False

    while True:
        if mode != "code":
            q = mode[1:]
            if mode[0] == "t":  # triple quotes; r raw and b bytes may precede them
                q = mode[-3:]
                m = _PY_TEXT[q].match(text, at)
                if _escape_error(text[at : m.end() if m else n], mode[1:-3]):
                    return bad
                if not m:
                    return done(mode)
                at = m.end()
            elif mode[0] == "q":
                m = _QUOTE_END[mode[-1]].match(text, at)
                if not m or _escape_error(text[at : m.end()], mode[1:-1]):
                    return bad
                if m.lastgroup == "cut":
                    return done(mode)
                at = m.end()
            else:
                m = (_PY_FIELD if mode[0] == "f" else _PY_SPEC)[q].match(text, at)
                if not m:
                    return bad
                if m.lastgroup == "eof":
                    return done(mode) if len(q) == 3 else bad
                at = m.end()
                if m.lastgroup == "field":
                    out.append("${")
                    fields.append([0, mode])
                elif mode[0] == "p":
                    out.append("}")
                    mode = fields.pop()[1]
                    continue
            mode = "code"
        m = _PY.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "w" or kind == "v":
            w = m.group(kind)
            out.append(w if w in gr.PY_KEYWORDS else "N")
        elif kind == "p":
            p = m.group("p")
            if fields and p[0] == ":" and not fields[-1][0]:
                at = m.start("p") + 1
                mode = "p" + fields[-1][1][1:]
                continue
            out.append(p)
        elif kind == "b":
            b = m.group("b")
            out.append(b)
            if fields:
                if b in "([{":
                    fields[-1][0] += 1
                elif fields[-1][0]:
                    fields[-1][0] -= 1
                elif b == "}":
                    mode = fields.pop()[1]
                else:
                    return bad
        elif kind == "nl":
            if not fields:
                t = m.group("nl")
                out.append(_column(t[t.rfind("\n") + 1 :]))
        elif kind == "s":
            pre = m.group("pre") or ""
            t = m.group("s")
            if ("\\" in t or pre) and _escape_error(t[len(pre) :], pre):
                return bad
            out.append("B" if pre and "b" in pre.lower() else "S")
        elif kind == "n":
            t = m.group("n")
            if t[0] == "0" and len(t) > 1 and t.replace("_", "").isdigit() and t.strip("0_"):
                return bad
            out.append("0")
        elif kind == "f":
            out.append("S")
            mode = "f" + m.group("fq")
        elif kind in ("t", "tq"):
            pre = (m.group("tpre") or "").lower()
            out.append("B" if "b" in pre else "S")
            mode = "t" + pre + m.group("tq")
        elif kind == "cut":
            pre = (m.group("cpre") or "").lower()
            if _escape_error(m.group("cut")[len(pre) :], pre):
                return bad
            out.append("B" if "b" in pre else "S")
            mode = "q" + pre + m.group("cut")[len(pre)]
            return done(mode)
        elif kind == "conv":
            if not fields or fields[-1][0]:
                return bad
        elif kind == "join":
            if at == n:
                return done("cont")
        elif kind == "end":
            return done("code")
        elif kind != "c":
            return bad


_PY_START = re.compile(r"(?:[ \t\f]*(?:\#[^\n]*)?\n)*([ \t\f]*)")


def _read_json(text: str) -> Read:
    out: list[str] = []
    at = 0
    while True:
        m = _JSON.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "s":
            out.append('"')
        elif kind in ("p", "b"):
            out.append(m.group(kind))
        elif kind == "n":
            out.append("0")
        elif kind == "w":
            if m.group("w") not in gr.KEYWORDS["json"]:
                return "code", [], True
            out.append(m.group("w"))
        elif kind == "end":
            return "code", out, False
        elif kind != "nl":
            return "code", [], True


def fold(codes: list[str], language: str, first: bool) -> tuple[list[str], bool]:
    """Folds every balanced group whose context is known and judges statements
    that end inside such a group. Returns what is left and whether all may stand."""
    python, js = language == "python", language in ("javascript", "typescript")
    braces = language not in ("python", "json")
    go = language == "go"
    frames: list[tuple[str, list[str]]] = []
    cur: list[str] = []
    for code in codes:
        if code in _OPEN:
            frames.append((code, cur))
            cur = []
        elif code in gr.CLOSE:
            if not frames:
                cur.append(code)
                continue
            bracket, parent = frames.pop()
            if gr.CLOSE[code] != bracket[-1]:
                return [], True
            if python:
                if not first and not frames and (len(parent) < 3 or any(c in _RAW for c in parent[-3:])):
                    parent.append(bracket)  # its role depends on codes before the chunk
                    parent.extend(cur)
                    parent.append(code)
                    cur = parent
                    continue
                group = gr.fold_python(bracket, cur, parent)
            elif braces:
                group = gr.fold_braces(language, bracket, cur)
                if js and group == "{}" and first and not frames and not [c for c in parent if c != "\n"]:
                    inside = [c for c in cur if c != "\n"]
                    if inside[:2] == ['"', ":"]:
                        group = "{j}"
            else:
                group = gr.fold_json(bracket, cur)
            if not group:
                return [], True
            parent.append(group)
            cur = parent
        elif braces and frames and (code == ";" or (go and code == "\n" and cur and gr._kind(cur[-1]) != "p")):
            if gr.piece_bad(language, frames[-1][0][-1], ";" if code == ";" else "line", " ".join(cur)):
                return [], True
            cur = []
        else:
            cur.append(code)
    left: list[str] = []
    for bracket, parent in frames:
        left += parent
        left.append(bracket)
    return left + cur if frames else cur, False


_OPEN = {"(", "[", "{", "${"}
_RAW = _OPEN | set(gr.CLOSE)


def _read(text: str, language: str, state: str, first: bool) -> tuple[list, bool]:
    """([end state, codes left, bad], whether the token before the chunk matters)."""
    slash = False
    if language == "python":
        end, codes, bad = _read_python(text, state)
    elif language == "json":
        end, codes, bad = _read_json(text)
    else:
        end, codes, bad, slash = _read_braces(text, language, state)
    if not bad:
        codes, bad = fold(codes, language, first)
    return ["code", [], True] if bad else [end, codes, False], slash


def summary(text: str, language: str, first: bool) -> dict:
    """What a chunk does to a file: {"text", "map", "first"}."""
    if first:
        if language in ("javascript", "typescript") and text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        return {"text": "", "first": True, "map": {"code": _read(text, language, "code", True)[0]}}
    out = {}
    out["code"], slash = _read(text, language, "code", False)
    if language in ("javascript", "typescript"):
        out["code+"] = _read(text, language, "code+", False)[0] if slash or not _holds_token(out["code"]) else out["code"]
    for state in _STATES[language]:
        out[state] = _read(text, language, state, False)[0]
    return {"text": text, "first": False, "map": out}


def _holds_token(got: list) -> bool:
    return any(c != "\n" for c in got[1])


def combine(a: dict, b: dict, language: str) -> dict:
    """The summary of two neighbouring chunks together; associative."""
    out = {}
    for state, (end, codes, bad) in a["map"].items():
        if bad:
            out[state] = [end, codes, True]
            continue
        step = b["map"].get(end) or _read(b["text"], language, end, False)[0]
        if step[2]:
            out[state] = ["code", [], True]
            continue
        left, bad = fold(codes + step[1], language, a["first"])
        out[state] = ["code", [], True] if bad else [step[0], left, False]
    return {"text": "" if a["first"] else a["text"] + b["text"], "first": a["first"], "map": out}


def verdict(whole: dict, language: str) -> bool:
    """True if the summary of a whole file says that it is invalid."""
    end, codes, bad = whole["map"]["code"]
    if bad or end not in ("code", "code+") or not _RAW.isdisjoint(codes):
        return True
    if language == "python":
        return gr.python_bad(codes)
    if language == "json":
        return gr.json_bad(codes)
    return gr.file_bad(language, codes)


def pieces(text: str, size: int = CHUNK) -> list[str]:
    """The text cut at line ends into pieces of about `size` characters."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", min(at + size, len(text)))
        end = len(text) if end < 0 else end + 1
        out.append(text[at:end])
        at = end
    return out


def invalid(text: str, language: str, size: int = CHUNK) -> bool:
    """True if a text with LF line ends is invalid in its language."""
    parts = pieces(text, size)
    whole = summary(parts[0], language, True)
    for part in parts[1:]:
        whole = combine(whole, summary(part, language, False), language)
    return verdict(whole, language)


def syntax_errors(files: DataFrame, contents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``file_id, repository_id, language, invalid`` for every file with
    contents in a language that is checked (language as its lower-case key).

    Files that repeat an id count once; rows with a null id or content, and
    files in other languages or of none, give no row; contents are checked
    whole, in chunks of about `chunk` characters; a leading byte order mark and
    any line ends are accepted; empty texts are valid except in Go and JSON;
    other columns are ignored.
    """
    one = files.where("id is not null").groupBy(F.col("id").alias("file_id")).agg(
        F.min("repository_id").alias("repository_id"), F.min(F.lower(F.trim("language"))).alias("language")
    ).where(F.col("language").isin(*LANGUAGES))
    text = F.regexp_replace(F.regexp_replace("content", "^\ufeff", ""), "\r\n?", "\n")
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}+[^\\n]*+\\n?+"), F.lit(0))
    parts = F.when(F.length("text") <= chunk, F.array("text")).otherwise(cut)
    rows = (
        contents.where("file_id is not null and content is not null").select("file_id", text.alias("text"))
        .select("file_id", F.when(F.length("text") <= chunk, 1).otherwise(F.size(cut)).alias("parts"), F.posexplode(parts).alias("part", "text"))
    )
    both = rows.join(one, "file_id")

    def summarise(batches):
        """Verdicts of files of one chunk; of others the summaries of runs of
        chunks that lie side by side in the task."""
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("file_id", "language", "part", "parts", "text")]
            rows, bad, sums, last = [], [], [], None
            for i, (file, language, part, parts, text) in enumerate(zip(*cols)):
                key = language_key(language)
                got = summary(text, key, part == 0)
                if parts == 1:
                    rows.append(i)
                    bad.append(verdict(got, key))
                    sums.append(None)
                    last = None
                elif last == (file, part):
                    sums[-1] = combine(sums[-1], got, key)
                    last = (file, part + 1)
                else:
                    rows.append(i)
                    bad.append(None)
                    sums.append(got)
                    last = (file, part + 1)
            at = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [at.column(c) for c in ("file_id", "repository_id", "language", "part")]
                + [pa.array(bad, pa.bool_()), pa.array([None if x is None else pickle.dumps(x) for x in sums], pa.binary())],
                names=["file_id", "repository_id", "language", "part", "invalid", "summary"],
            )

    def judge(batches):
        for batch in batches:
            invalid = batch.column("invalid").to_pylist()
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                if invalid[i] is None:
                    key = language_key(batch.column("language")[i].as_py())
                    whole = pickle.loads(runs[0]["summary"])
                    for run in runs[1:]:
                        whole = combine(whole, pickle.loads(run["summary"]), key)
                    invalid[i] = verdict(whole, key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("file_id", "repository_id", "language")] + [pa.array(invalid, pa.bool_())],
                names=["file_id", "repository_id", "language", "invalid"],
            )

    sums = both.mapInArrow(
        summarise, "file_id string, repository_id string, language string, part int, invalid boolean, summary binary"
    )
    whole = sums.groupBy("file_id").agg(
        F.min("repository_id").alias("repository_id"), F.min("language").alias("language"), F.max("invalid").alias("invalid"),
        F.array_sort(F.collect_list(F.when(F.col("summary").isNotNull(), F.struct("part", "summary")))).alias("runs"),
    )
    return whole.mapInArrow(judge, "file_id string, repository_id string, language string, invalid boolean")


def syntax_rates(checked: DataFrame) -> DataFrame:
    """Per repository and language: files checked, files invalid and the rate."""
    return checked.groupBy("repository_id", "language").agg(
        F.count("*").alias("n_files"),
        F.count_if("invalid").alias("n_invalid"),
        F.avg(F.col("invalid").cast("double")).alias("invalid_rate"),
    )
