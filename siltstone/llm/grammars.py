"""Local grammars over the codes of one bracket level (problem 4).

A level is the run of token codes between two brackets, with every balanced
group inside it already folded to one code. Identifiers are ``w`` (``N`` in
Python), numbers ``0``, strings ``"`` (``S``), keywords and operators stand for
themselves, so levels and statements of one shape are judged once per process.
"""

from __future__ import annotations

from functools import lru_cache

CLOSE = {")": "(", "]": "[", "}": "{"}
SHAPES = 1 << 16  # verdicts kept per process

# Keywords of the languages.
JS_BEFORE = set(
    "const let var function class return typeof instanceof in of new delete void throw case else do async await yield import export from as "
    "default extends get set static if for while switch try catch finally break continue with debugger accessor".split()
)
TS_BEFORE = JS_BEFORE | set(
    "type interface enum namespace module declare abstract public private protected readonly implements keyof infer is asserts unique "
    "satisfies override out global using".split()
)
_JS_INFIX = set("in of instanceof as from extends".split())
_TS_INFIX = _JS_INFIX | set("is satisfies implements extends".split())
_NEED_MORE = {
    "javascript": set("const let var import from function class new typeof extends case throw await in of instanceof if for while switch try catch else export default async delete void as".split()),
    "go": set("package import func type var const if for switch select go defer case map chan struct interface range else".split()),
    "java": set(), "rust": set(),
}
_NEED_MORE["typescript"] = _NEED_MORE["javascript"] | set("interface namespace implements private public protected abstract".split())
_TOP = {
    "java": set("package import class interface enum record public private protected abstract final static sealed non strictfp module open".split()) | {"@", ";"},
    "rust": set("use pub fn struct enum impl trait mod const static type extern unsafe async macro_rules union crate auto default safe".split()) | {"#", ";"},
    "go": set("package import func type var const".split()) | {";"},
}
_BINARY = {
    "javascript": set("= + - * / % & | ^ < > ? . => && || ?? += -= *= /= %= == != <= >= === !== &= |= ^= ! ~ ?.".split()),
    "typescript": set("= + - / % ^ . => && || ?? += -= *= /= %= == != <= >= &= |= ^= ~".split()),
    "go": set("= + - / % ^ . := && || += -= *= /= %= == != <= >= | <- !".split()),
    "java": set("= + - / % ^ . && || += -= *= /= %= == != <= >= | -> ~".split()),
    "rust": set("+ - / % ^ . && += -= *= /= %= == != <= >= => ->".split()),
}
_WORDS = set("case const let var import as in of instanceof else if type typeof defer from enum function class interface namespace try switch".split())
KEYWORDS = {
    k: _WORDS | _NEED_MORE[k] | {w for w in _TOP.get(k, ()) if w.isalpha() or "_" in w} for k in _NEED_MORE
}
KEYWORDS["javascript"] |= JS_BEFORE | _JS_INFIX
KEYWORDS["typescript"] |= TS_BEFORE | _TS_INFIX
KEYWORDS["json"] = {"true", "false", "null"}
PY_KEYWORDS = set(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield match case type".split()
)
KEYWORDS["python"] = PY_KEYWORDS


# Languages with braces

def _kind(code: str) -> str:
    c = code[0]
    if c == "0":
        return "n"
    if c in "\"`":
        return "s"
    if code in ("()", "[]", "{}", "{j}"):
        return "b"
    return "w" if c.isalpha() or c == "_" else "p"


def _typed_result(codes: list[str], at: int) -> bool:
    """A type and a body stand at `at`: name(.name)* [<...>] [ [] ] { }."""
    n = len(codes)
    if at >= n or _kind(codes[at]) != "w":
        return False
    at += 1
    while at + 1 < n and codes[at] == "." and _kind(codes[at + 1]) == "w":
        at += 2
    if at < n and codes[at] == "<":
        while at < n and codes[at] not in (">", ">>"):
            at += 1
        at += 1
    if at < n and codes[at] == "[]":
        at += 1
    return at < n and codes[at] in ("{}", "{j}")


@lru_cache(SHAPES)
def piece_bad(language: str, inner: str, end: str, piece: str) -> bool:
    """True if a statement cannot stand: its level's bracket (none at the top),
    what ends it (``;``, ``close``, ``line`` or ``eof``) and its codes."""
    codes = [c for c in piece.split(" ") if c and c != "${}"]
    js = language in ("javascript", "typescript")
    ts = language == "typescript"
    before = TS_BEFORE if ts else JS_BEFORE
    infix = _TS_INFIX if ts else _JS_INFIX
    p2 = p1 = k1 = ""
    new = False
    ternary = as_word = 0
    import_name = pending = False
    plain = [c for c in codes if c != "\n"]
    at = -1
    for code in codes:
        if code == "\n":
            new = True
            continue
        at += 1
        kind = _kind(code)
        tok = code[0] if kind == "b" else code
        if kind in ("w", "n", "s") and k1 in ("w", "n", "s"):
            if js:
                free = k1 == "w" and p1 in before
                if not free and not (kind == "w" and tok in infix) and tok != "`" and (not new or inner in ("(", "[")):
                    return True
            elif not new and k1 in ("n", "s") and not (kind == "w" and tok in ("as", "in", "instanceof", "else", "if")):
                return True
        if js and not inner and kind == "w" and k1 == "w" and p1 == "import" and tok not in ("type", "typeof", "defer"):
            import_name = True
        elif import_name:
            if tok not in ("from", ",") and not (ts and tok == "="):
                return True
            import_name = False
        if js and k1 == "w" and p2 == "const" and kind != "w" and p1 != "enum" and tok not in ("=", ":", "in", "of"):
            return True
        if js and not ts:
            if as_word == 2:
                if tok not in (",", "from"):
                    return True
                as_word = 0
            elif as_word == 1:
                as_word = 2
            if tok == "as" and k1 == "w" and not new and p1 != ",":
                as_word = 1
            if tok == ":" and not ternary and (
                (k1 == "w" and (p2 in ("const", "let", "var") or (inner == "(" and (at == 1 or p2 == ","))))
                or (p1 == ")" and _typed_result(plain, at + 1))
            ):
                return True
            if (p1 == "?" and tok == ":") or (p1 == "!" and tok == "."):
                return True
        if kind == "p":
            if tok == "?":
                ternary += 1
            elif tok == ":" and ternary:
                ternary -= 1
        elif kind == "w" and js and not inner and p1 != "." and tok in ("function", "class", "interface", "namespace", "try", "switch"):
            pending = True
        elif kind == "b" and tok == "{":
            pending = False
        p2, p1, k1 = p1, tok, kind
        if kind == "b":
            p2, p1 = "", code[-1]
        new = False
    if js and k1 == "w" and p2 == "const" and p1 != "enum":
        return True
    if import_name:
        return True
    if end in (";", "close"):
        return (k1 == "p" and p1 in _BINARY[language]) or (as_word == 2 and not (end == "close" and inner == "{"))
    if end != "eof":
        return False
    if k1 == "p":
        return p1 not in ("++", "--", "!", "*") and not (ts and p1 in (">", "?"))
    if k1 == "w" and p1 in _NEED_MORE[language] and p2 not in ("as", "."):
        return True
    return js and (pending or (k1 == "w" and p2 == "import"))


def fold_braces(language: str, bracket: str, codes: list[str]) -> str:
    """The code of a group, or nothing if its last statement cannot stand."""
    if piece_bad(language, bracket[-1], "close", " ".join(codes)):
        return ""
    if bracket == "${":
        return "${}"
    return bracket + {"(": ")", "[": "]", "{": "}"}[bracket]


def file_bad(language: str, codes: list[str]) -> bool:
    """True if what stands outside all brackets of a file cannot stand."""
    plain = [c for c in codes if c not in ("\n", "${}")]
    if language in ("javascript", "typescript"):
        if plain and plain[0] in ("<", "{j}"):
            return True
    elif language == "go":
        if not plain or plain[0] != "package":
            return True
    top = _TOP.get(language)
    if top:
        start, value, new, p1 = True, False, True, ""
        for i, code in enumerate(codes):
            if code == "\n":
                new = True
                continue
            if language == "go" and new and (not p1 or _kind(p1) != "p" or p1 in ("++", "--", ";")) and code not in ("()", "{}"):
                start = True
            if start and code not in top and not (language == "rust" and code[0].isalpha() and codes[i + 1 : i + 2] == ["!"]):
                return True
            start = False
            if language != "go":
                if code == ";":
                    start, value = True, False
                elif code == "=":
                    value = True
                elif code == "{}" and not value:
                    start = True
            p1, new = code, False
        if language != "go" and p1 and p1 not in ("{}", ";"):
            return True
    piece: list[str] = []
    for code in codes:
        if code == ";":
            if piece_bad(language, "", ";", " ".join(piece)):
                return True
            piece = []
        else:
            piece.append(code)
    return piece_bad(language, "", "eof", " ".join(piece))


# JSON

_JSON_VALUE = {'"', "0", "true", "false", "null", "[]", "{}"}


def fold_json(bracket: str, codes: list[str]) -> str:
    if codes:
        step = 2 if bracket == "[" else 4
        if len(codes) % step != step - 1 or any(c != "," for c in codes[step - 1 :: step]):
            return ""
        if bracket == "{" and (any(c != '"' for c in codes[::4]) or any(c != ":" for c in codes[1::4])):
            return ""
        if not _JSON_VALUE.issuperset(codes[step - 2 :: step]):
            return ""
    return "[]" if bracket == "[" else "{}" if bracket == "{" else ""


def json_bad(codes: list[str]) -> bool:
    return len(codes) != 1 or codes[0] not in _JSON_VALUE


# Python

class _Bad(Exception):
    pass


_BINARY_PY = set("+ - * / // % @ ** & | ^ << >>".split())
_COMPARE = set("< > <= >= == !=".split())
_AUGMENTED = set("+= -= *= /= //= %= @= **= &= |= ^= <<= >>=".split())
_SOFT = ("match", "case", "type")
_TARGET = ("N", "a", "s", "t")


class _Line:
    """A cursor over codes with the rules of Python's expressions and statements."""

    def __init__(self, codes):
        self.c = codes
        self.i = 0
        self.n = len(codes)

    def at(self) -> str:
        return self.c[self.i] if self.i < self.n else ""

    def take(self, *codes) -> bool:
        if self.i < self.n and self.c[self.i] in codes:
            self.i += 1
            return True
        return False

    def need(self, *codes):
        if not self.take(*codes):
            raise _Bad

    def name(self):
        self.need("N", *_SOFT)

    def end(self):
        if self.i < self.n:
            raise _Bad

    # expressions; each returns N name, a attribute, s subscript, t group of targets, o other
    def primary(self) -> str:
        t = self.at()
        self.i += 1
        if t == "N" or t in _SOFT:
            kind = "N"
        elif t in ("S", "B"):
            kind = "o"
            while self.at() in (t, "${}"):
                self.i += 1
            if self.at() in ("S", "B"):
                raise _Bad
        elif t in ("0", "None", "True", "False", "...", "(e)", "[e]", "{}"):
            kind = "o"
        elif t in ("(c)", "[s]") and self.i == 2 and self.c[0] in ("match", "case"):
            kind = "o"  # the soft keyword begins a head and is no call
        elif t in ("(0)", "(t)", "[t]"):
            kind = "t"
        else:
            raise _Bad
        while True:
            t = self.at()
            if t == ".":
                self.i += 1
                self.name()
                kind = "a"
            elif t == "(c)":
                self.i += 1
                kind = "o"
            elif t == "[s]":
                self.i += 1
                kind = "s"
            else:
                return kind

    def sum(self) -> str:
        kind = ""
        while True:
            while self.take("-", "+", "~"):
                kind = "o"
            if self.take("await"):
                kind = "o"
            got = self.primary()
            kind = "o" if kind else got
            if self.at() in _BINARY_PY:
                self.i += 1
                kind = "o"
            else:
                return kind

    def disjunction(self) -> str:
        kind = ""
        while True:
            while self.take("not"):
                kind = "o"
            got = self.sum()
            kind = "o" if kind else got
            while True:
                if self.at() in _COMPARE or self.at() == "in":
                    self.i += 1
                elif self.at() == "is":
                    self.i += 1
                    self.take("not")
                elif self.at() == "not" and self.i + 1 < self.n and self.c[self.i + 1] == "in":
                    self.i += 2
                else:
                    break
                kind = "o"
                self.sum()
            if self.take("and", "or"):
                kind = "o"
            else:
                return kind

    def expression(self) -> str:
        if self.take("lambda"):
            self.params(("", ":"), False)
            self.need(":")
            self.expression()
            return "o"
        kind = self.disjunction()
        if self.take("if"):
            self.disjunction()
            self.need("else")
            self.expression()
            return "o"
        return kind

    def named(self) -> str:
        kind = self.expression()
        if self.at() == ":=":
            if kind != "N":
                raise _Bad
            self.i += 1
            self.expression()
            return "o"
        return kind

    def star(self) -> str:
        if self.take("*"):
            return "*" + self.sum()
        return self.named()

    def listing(self, stop=()) -> list[str]:
        """One or more (starred) expressions; a last comma gives an empty kind."""
        kinds = [self.star()]
        while self.take(","):
            if self.i >= self.n or self.at() in stop:
                return kinds + [""]
            kinds.append(self.star())
        return kinds

    def targets(self, stop):
        while True:
            self.take("*")
            if self.primary() not in _TARGET:
                raise _Bad
            if not self.take(","):
                return
            if self.at() in stop:
                return

    def loops(self):
        """The for and if clauses of a comprehension, to the end."""
        while self.i < self.n:
            self.take("async")
            self.need("for")
            self.targets(("in",))
            self.need("in")
            self.disjunction()
            while self.take("if"):
                self.disjunction()
                if self.at() == ":=":
                    raise _Bad

    def params(self, stop, typed=True):
        default = star = slash = bare = kw = False
        while self.at() not in stop:
            if kw:
                raise _Bad
            bare_now = False
            if self.take("/"):
                if star or slash or self.i == 1:
                    raise _Bad
                slash = True
            elif self.take("**"):
                self.name()
                kw = True
                if typed and self.take(":"):
                    self.expression()
            elif self.take("*"):
                if star:
                    raise _Bad
                star = True
                if self.at() in ("N", *_SOFT):
                    self.name()
                    if typed and self.take(":"):
                        self.star()
                else:
                    bare_now = True
            else:
                self.name()
                if typed and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise _Bad
            if bare and kw:
                raise _Bad
            bare = bare_now
            if not self.take(","):
                break
        if bare or self.at() not in stop:
            raise _Bad

    def arguments(self):
        words = False
        double = False
        while self.i < self.n:
            if self.take("**"):
                self.expression()
                double = True
            elif self.take("*"):
                if double:
                    raise _Bad
                self.expression()
            elif self.at() in ("N", *_SOFT) and self.i + 1 < self.n and self.c[self.i + 1] == "=":
                self.i += 2
                self.expression()
                if self.take("as"):
                    self.name()
                words = True
            else:
                if words or double:
                    raise _Bad
                first = self.i == 0
                self.named()
                if first and self.at() in ("for", "async"):
                    self.loops()
                    return
            if not self.take(","):
                return

    def display(self) -> str:
        """Contents of round or square brackets that stand for a value."""
        if self.at() == "yield":
            self.yielding()
            return "e"
        kinds = []
        comma = False
        while self.i < self.n:
            kinds.append(self.star())
            if len(kinds) == 1 and self.at() in ("for", "async"):
                if kinds[0][:1] == "*":
                    raise _Bad
                self.loops()
                return "e"
            if self.take("as"):
                if self.primary() not in _TARGET:
                    raise _Bad
                kinds[-1] = "o"
            comma = self.take(",")
            if not comma:
                break
        self.lone = len(kinds) == 1 and kinds[0][:1] == "*" and not comma
        return "t" if all(k.lstrip("*") in _TARGET for k in kinds) else "e"

    def yielding(self):
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif self.i < self.n and self.at() not in (")", "="):
            self.listing()

    def subscript(self):
        while True:
            if self.take("*", "**"):
                self.sum()
            elif self.at() != ":":
                self.named()
            for _ in range(2):
                if self.take(":") and self.i < self.n and self.at() not in (",", ":"):
                    self.expression()
            if not self.take(",") or self.i >= self.n:
                return

    def braces(self):
        first = True
        pairs = None
        while self.i < self.n:
            if self.take("**"):
                self.sum()
                pair = True
            else:
                starred = self.at() == "*"
                self.star()
                pair = self.take(":")
                if pair:
                    if starred:
                        raise _Bad
                    self.expression()
                    if self.take("as"):
                        self.name()
                if first and self.at() in ("for", "async"):
                    self.loops()
                    return
            if pairs is not None and pair != pairs:
                raise _Bad
            first, pairs = False, pair
            if not self.take(","):
                return

    def imports(self):
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(",") or self.i >= self.n:
                return

    def dotted(self):
        self.name()
        while self.take("."):
            self.name()

    # statements
    def value(self):
        if self.at() == "yield":
            self.yielding()
        else:
            self.listing(("=", ";"))

    def simple(self):
        t = self.at()
        if t in ("pass", "break", "continue"):
            self.i += 1
        elif t == "return":
            self.i += 1
            if self.i < self.n:
                self.listing()
        elif t == "del":
            self.i += 1
            self.targets(("",))
        elif t in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.take(","):
                self.name()
        elif t == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif t == "raise":
            self.i += 1
            if self.i < self.n:
                self.expression()
                if self.take("from"):
                    self.expression()
        elif t == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
        elif t == "from":
            self.i += 1
            dots = False
            while self.take(".", "..."):
                dots = True
            if not dots or self.at() != "import":
                self.dotted()
            self.need("import")
            if not self.take("*", "(i)"):
                while True:
                    self.name()
                    if self.take("as"):
                        self.name()
                    if not self.take(","):
                        break
        elif t == "type" and self.c[self.i + 1 : self.i + 2] and self.c[self.i + 1] in ("N", *_SOFT):
            self.i += 2
            self.take("[s]")
            self.need("=")
            self.expression()
        else:
            self.assignment()
        self.end()

    def assignment(self):
        if self.at() == "yield":
            self.yielding()
            return
        kinds = self.listing(("=", ":", *_AUGMENTED))
        single = kinds[0] if len(kinds) == 1 else ""
        if self.take(":"):
            if single not in _TARGET:
                raise _Bad
            self.expression()
            if self.take("="):
                self.value()
            return
        if self.at() in _AUGMENTED:
            if single not in ("N", "a", "s"):
                raise _Bad
            self.i += 1
            self.value()
            return
        while self.take("="):
            if any(k.lstrip("*") not in _TARGET for k in kinds if k):
                raise _Bad
            if self.at() == "yield":
                self.yielding()
                return
            kinds = self.listing(("=",))

    def header(self) -> str:
        """The keyword of a compound statement's head, up to and with its colon."""
        t = self.at()
        self.i += 1
        if t == "async":
            t = self.at()
            if t not in ("def", "for", "with"):
                raise _Bad
            self.i += 1
        if t in ("if", "elif", "while"):
            self.named()
        elif t == "for":
            self.targets(("in",))
            self.need("in")
            self.listing((":",))
        elif t == "with":
            while True:
                self.expression()
                if self.take("as"):
                    if self.primary() not in _TARGET:
                        raise _Bad
                if not self.take(","):
                    break
        elif t == "except":
            self.take("*")
            if self.at() != ":":
                self.expression()
                if self.take("as"):
                    self.name()
        elif t == "def":
            self.name()
            self.take("[s]")
            self.need("(p)")
            if self.take("->"):
                self.expression()
        elif t == "class":
            self.name()
            self.take("[s]")
            self.take("(c)")
        elif t == "match":
            self.listing((":",))
        elif t == "case":
            while True:
                self.take("*")
                self.disjunction()
                if self.take("as"):
                    self.name()
                if not self.take(",") or self.at() == ":":
                    break
            if self.take("if"):
                self.named()
        elif t not in ("try", "else", "finally"):
            raise _Bad
        self.need(":")
        return t


@lru_cache(SHAPES)
def python_line(line: str) -> str:
    """What a logical line is: ``""`` if it cannot stand, ``-`` for simple
    statements, ``@`` for a decorator, else the keyword of its head, with a
    ``:`` where the body follows on lines of its own."""
    codes = line.split(" ")
    try:
        if codes[0] == "@":
            x = _Line(codes[1:])
            x.named()
            x.end()
            return "@"
        head = ""
        x = _Line(codes)
        if codes[0] in ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async"):
            head = x.header()
        elif codes[0] in ("match", "case") and codes[-1] == ":" or codes[0] == "case":
            try:
                head = x.header()
            except _Bad:
                head, x.i = "", 0
        rest = codes[x.i :]
        if head and not rest:
            return head + ":"
        part: list[str] = []
        for i, code in enumerate([*rest, ";"]):
            if code == ";":
                if not part:
                    if i < len(rest) or i == 0:
                        return ""
                    continue
                _Line(part).simple()
                part = []
            else:
                part.append(code)
        return head or "-"
    except _Bad:
        return ""


@lru_cache(SHAPES)
def _python_group(bracket: str, role: str, inner: str) -> str:
    codes = inner.split(" ") if inner else []
    x = _Line(codes)
    try:
        if role == "params":
            x.params(("",))
            out = "(p)"
        elif role == "import":
            x.imports()
            out = "(i)"
        elif role == "field":
            while x.n and codes[x.n - 1] == "${}" and (x.n < 2 or codes[x.n - 2] != "S"):
                x.n -= 1  # fields of the format
            if x.n and codes[x.n - 1] == "=":
                x.n -= 1
            x.value()
            x.end()
            x.i = x.n = len(codes)
            out = "${}"
        elif role == "call":
            x.arguments()
            out = "(c)"
        elif role == "subscript":
            x.subscript()
            out = "[s]"
        elif bracket == "{":
            x.braces()
            out = "{}"
        elif not codes:
            out = "(0)" if bracket == "(" else "[t]"
        else:
            kind = x.display()
            if bracket == "(" and getattr(x, "lone", False):
                return ""
            out = f"({kind})" if bracket == "(" else f"[{kind}]"
        x.end()
        return out
    except _Bad:
        return ""


_VALUE_ENDS = {"N", "S", "B", "0", "None", "True", "False", "...", "(0)", "(t)", "(e)", "(c)", "[t]", "[e]", "[s]", "{}", "${}", "type", "match", "case"}


def fold_python(bracket: str, codes: list[str], before: list[str]) -> str:
    """The code of a group, by the role that the codes before it give it."""
    p1 = before[-1] if before else ""
    p2 = before[-2] if len(before) > 1 else ""
    p3 = before[-3] if len(before) > 2 else ""
    inner = " ".join(c for c in codes if c[0] != "\n")
    if bracket == "${":
        role = "field"
    elif bracket == "{":
        role = ""
    elif bracket == "(":
        if p1 == "import":
            role = "import"
        elif p2 == "def" or (p1 == "[s]" and p3 == "def"):
            role = "params"
        elif p1 in _VALUE_ENDS:
            role = "call"
        else:
            role = ""
    else:
        role = "subscript" if p1 in _VALUE_ENDS else ""
    return _python_group(bracket, role, inner)


def python_bad(codes: list[str]) -> bool:
    """True if the logical lines of a file cannot stand in this order and with
    this indentation. Codes that begin with a line end hold the columns of the
    next line, with tabs at 8 and at 1."""
    levels = [[(0, 0), "", ""]]  # columns, last statement, statement that owns the block
    body = ""  # the statement whose block must begin
    line: list[str] = []
    column = (0, 0)

    def close(level) -> bool:
        return level[1] in ("try", "@")

    for code in [*codes, "\n0"]:
        if code[0] != "\n":
            line.append(code)
            continue
        if line:
            what = python_line(" ".join(line))
            if not what:
                return True
            if body:
                if column[0] <= levels[-1][0][0] or column[1] <= levels[-1][0][1]:
                    return True
                levels.append([column, "", body])
                body = ""
            else:
                while column[0] < levels[-1][0][0]:
                    if close(levels[-1]):
                        return True
                    levels.pop()
                if column != levels[-1][0]:
                    return True
            level = levels[-1]
            word, last = what.rstrip(":"), level[1]
            if word in ("elif", "else", "except", "finally"):
                if word == "elif":
                    ok, now = last == "if", "if"
                elif word == "else":
                    ok, now = last in ("if", "for", "while", "except"), "tried" if last == "except" else ""
                elif word == "except":
                    ok, now = last in ("try", "except"), "except"
                else:
                    ok, now = last in ("try", "except", "tried"), ""
                if not ok:
                    return True
            else:
                if last == "try" or (last == "@" and word not in ("@", "def", "class")):
                    return True
                if (word == "case") != (level[2] == "match"):
                    return True
                now = word if word in ("if", "for", "while", "try", "@") else ""
            level[1] = now
            if what[-1] == ":":
                body = word
            line = []
        at = code[1:].split(",")
        column = (int(at[0]), int(at[-1]))
    return bool(body) or any(close(x) for x in levels)
