"""Credentials embedded in source code (problem 6).

Each text is lexed once into its literals and comments. Every value in them is
segmented into dictionary words by Viterbi over its characters: words of the
code base's own names cost little, every unexplained character costs one.
Literals and comments whose values are all explained are done with. What stays
unexplained is judged by the context it stands in: the name it is assigned or
passed to, the pair, header, URL, command or phrase around it; literals joined
by ``+``, ``concat!`` or by standing side by side are one value. Values in
well-known token formats count in any context. Look-ups, masks, placeholders,
hashes, checksums, ids and public keys do not.

The dictionary is counted by Spark over the names and signatures of all rows;
the `DICTIONARY_SIZE` most frequent words are sent to the tasks, a fixed bound.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.lexing import TEXTS, language_key

DICTIONARY_SIZE = 30_000
MASK = "REDACTED"

# Words of the subject, formats of tokens and of values that are none.
_BASIC_WORDS = (
    "the and for with from not your you are this that into when then use used using user users admin root name names type types "
    "value values key keys token tokens secret secrets password passwords passwd pass pwd api auth oauth bearer basic jwt http https "
    "url uri host port path file data base string text label field column table config default test example sample demo local prod "
    "production staging server client service access private public session cookie csrf header login account email reset hash sha md "
    "utf sql json xml yaml html css true false null none unknown change changeme enter here insert replace placeholder dummy fake mock"
)
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"(?P<akia>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])|"
    r"(?P<tok>gh[posur]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{18,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|"
    r"xox[abeoprs]-[A-Za-z0-9-]{16,}|xapp-[A-Za-z0-9-]{16,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{30,}|"
    r"npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}|hf_[A-Za-z0-9]{30,}|dop_v1_[a-f0-9]{40,}|shpat_[a-fA-F0-9]{30,}|"
    r"sk-(?:ant-|proj-)?[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}))"
)
_HOOK = re.compile(r"https?://[^\s\"'`<>]*?/(?:hooks?|services|webhooks?)/(?P<v>(?:T\w{6,}/B\w{6,}/|\d{6,}/)?[\w-]{16,})")
_PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<v>.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S
)
_URL_USER = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:(?P<v>[^\s@/\"'`]+)@[A-Za-z0-9\[{$]")
_URL_QUERY = re.compile(
    r"[?&](?:[a-z_]*token|api_?key|key|sig(?:nature)?|[a-z_]*secret|password|passwd|pwd|auth)=(?P<v>[^&\s\"'`<>]+)", re.I
)
_HEADER = re.compile(r"\b(?:Bearer|Token|Basic)[ =]+(?P<v>[A-Za-z0-9+/=._~-]{12,})")
_COMMAND = re.compile(
    r"--?(?:password|passwd|pass|token|secret|api-?key|auth-token|access-token)(?:=|\s+)[\"']?(?P<v>[^\s\"'`]+)|"
    r"\b(?:mysql\w*|mariadb)\b[^\n\"'`]*?\s-p(?P<v2>[^\s\"'`-][^\s\"'`]*)|\bcurl\b[^\n]*?\s-u\s*[\"']?[^\s:\"']+:(?P<v3>[^\s\"'`]+)|"
    r"\bsshpass\s+-p\s*[\"']?(?P<v4>[^\s\"'`]+)"
)
_NAME = r"(?P<name>[A-Za-z_][\w.-]*)"
#: What stands before a literal that a name is given: an assignment, a pair, a parameter, an argument.
_GIVEN = re.compile(
    _NAME
    + r"""["'`]?\s*\]?\s*(?::[ \t]*&?[^=\n"'`,;(){}]{0,40}=|:=|=>|\?\?=|\|\|=|[:=,]|\(|\.set\()\s*(?P<list>concat!\(\s*|\(\s*)?\Z"""
)
_JOINED = re.compile(r"\s*(?:\+\s*)?(?:\\\s*)?\Z")
_LISTED = re.compile(r"\s*(?:[+,]\s*)?\Z")
_BLANK = re.compile(r"\s")
_VALUE = re.compile(r"[^\s\"'`<>]{5,}")
#: letters next to digits, capitals within a word, or other characters than a word's
_MIXED = re.compile(r"[A-Za-z][^A-Za-z\d\s]*\d|\d[^A-Za-z\d\s]*[A-Za-z]|[a-z][A-Z]|[A-Za-z][=+/!#@%^&*:]")
_PHRASE = re.compile(
    r"\b(?:log-?in|credentials?|password|passwd|passphrase|passcode|secret|token|(?:api|access|signing|private) key)s?\b[^\n]{0,80}?"
    r"(?:\b(?:is|was|are|were|with|to)|[:=/])\s+[\"'`]?(?P<v>[^\s\"'`]{8,})", re.I
)
_BARE = re.compile(r"""(?<![\w.-])(?P<name>[\w.-]+)\s*(?:=|:)\s*(?P<val>[^\s"'`,;<>(){}\[\]$]{5,})""")
_SECRET_NAME = re.compile(
    r"\b(?:password|passwords|passwd|pwd|passphrase|passcode|pass|secret|secrets|token|apikey|api key|access key|secret key|private key|"
    r"encryption key|signing key|auth key|master key|license key|account key|storage key|shared key|service key|app key|credential|credentials|creds|auth|"
    r"webhook secret|client secret|pat)\b"
)
_PASSWORD_NAME = re.compile(r"\b(?:password|passwords|passwd|pwd|passphrase|passcode|pass)\b")
_NO_NAME = re.compile(
    r"\b(?:hash|hashes|hashed|checksum|digest|sha\d*|md5|fingerprint|public|pubkey|commit|trace|etag|uuid|ref|revision|url|uri|endpoint|"
    r"regex|pattern|csrf|author|icon|image|count|max|min|limit|ttl|size|length|expiry|expires|version)\b"
)
_NO_VALUE = re.compile(
    r"\$\{|\{\{|\}\}|^\{.*\}$|<[^>]*>|%\(|%s|%v|^\$[A-Za-z_]|^%[A-Z_]+%$|\*{3,}|•|(?:x{5,}|X{5,}|\.{3,}|#{4,}|0{8,}|-{5,}|_{5,})|"
    r"(?i:change.?me|your[-_. ]|example|placeholder|redacted|dummy|insert[-_ ]|replace[-_ ]|not[-_]?(?:a[-_])?real|fake|sample|"
    r"^env[.:(]|process\.env|os\.environ|getenv|vault[.:]|secretsmanager|^arn:|^file:|^https?://|^ssh-(?:rsa|ed25519)|^data:)|"
    r"^(?:sha\d+|md5|blake2b?)[:\-$]|^\$2[aby]\$|^\$(?:argon2|5|6|1)\w*\$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
)
_HASH_LIKE = re.compile(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})$")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def unexplained(value: str, words: frozenset[str] | set[str], longest: int = 16) -> int:
    """Viterbi segmentation of a value: how many of its characters are in no
    dictionary word of the cheapest segmentation. Separators are free."""
    low = value.lower()
    n = len(low)
    best: list[float] = [0.0] * (n + 1)
    left: list[int] = [0] * (n + 1)
    for i in range(1, n + 1):
        ch = low[i - 1]
        free = ch in "-_./ :"
        cost, rest = best[i - 1] + (0.0 if free else 1.0), left[i - 1] + (not free)
        if ch.isalpha():
            for size in range(3, min(longest, i) + 1):
                piece = low[i - size : i]
                if piece in words:
                    c = best[i - size] + (1.4 if size == 3 else 1.0)
                    if c < cost:
                        cost, rest = c, left[i - size]
        best[i], left[i] = cost, rest
    return left[n]


class Residuals:
    """Unexplained characters of values; the values of a code base repeat."""

    def __init__(self, words, keep: int = 200_000):
        self.words, self.keep = words, keep
        self.seen: dict[str, int] = {}
        self.strange: dict[str, bool] = {}

    def __call__(self, value: str) -> int:
        got = self.seen.get(value)
        if got is None:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            got = self.seen[value] = 0 if value.lower() in self.words else unexplained(value, self.words)
        return got

    def odd(self, value: str) -> bool:
        """True if a value may hold a secret: more than a word or a number."""
        got = self.strange.get(value)
        if got is None:
            if len(self.strange) >= self.keep:
                self.strange.clear()
            r = self(value)
            got = self.strange[value] = r >= 8 or (r >= 3 and _MIXED.search(value) is not None)
        return got


def _words_of(name: str) -> str:
    return " ".join(x.lower() for x in _SPLIT.findall(name))


def _literal(part: str) -> tuple[int, int]:
    """Offsets of a string literal's content."""
    if m := re.match(r"(?:b|c)?r#+\"", part):
        return m.end(), len(part) - m.end() + part.index("r")
    q = min((part.find(c) for c in "\"'`" if c in part), default=0)
    width = 3 if part[q : q + 3] in ('\"\"\"', "'''") and len(part) >= q + 6 else 1
    return q + width, len(part) - width


def _segments(text: str, language: str) -> list[tuple[str, int, int]]:
    """Comments 'c' and literals 's' of a text; of a language without a lexer
    the whole text, as one comment."""
    if language not in TEXTS:
        return [("c", 0, len(text))]
    return [("s" if m.lastgroup == "h" else m.lastgroup, *m.span()) for m in TEXTS[language].finditer(text) if m.lastgroup != "x"]


def find_secrets(text: str, language: str, words) -> list[tuple[int, int]]:
    """Spans of the characters that make up secrets, in order, not overlapping."""
    residual = words if isinstance(words, Residuals) else Residuals(words)
    spans: list[tuple[int, int]] = []

    def usable(v: str, least: int) -> bool:
        return residual(v) >= least and not _NO_VALUE.search(v)

    def by_name(name: str, value: str, least: int) -> bool:
        said = _words_of(name)
        return bool(_SECRET_NAME.search(said)) and not _NO_NAME.search(said) and usable(value, least)

    for m in _PEM.finditer(text) if "-----BEGIN" in text else ():
        body = re.sub(r"\\n|[\s\"'`+,\\]|Proc-Type.*|DEK-Info.*", "", m.group("v"))
        if len(body) >= 32 and not re.search(r"\.{3}|\*{3}|<|\$\{|\{\{|(.)\1{7}", body):
            spans.append(m.span("v"))
    segments = _segments(text, language)
    # literals that are joined to one value: (its parts, how it is listed)
    at = 0
    while at < len(segments):
        kind, a, b = segments[at]
        parts = [(a, b)]
        at += 1
        if kind == "s":
            gap = _JOINED
            if text[a - 1 : a] in "( \n\t" and "concat!" in text[max(0, a - 24) : a]:
                gap = _LISTED
            while at < len(segments) and segments[at][0] == "s" and gap.match(text, parts[-1][1], segments[at][1]):
                parts.append(segments[at][1:])
                at += 1
            inner = []
            for x, y in parts:
                i, j = _literal(text[x:y])
                if j > i:
                    inner.append((x + i, x + j))
            value = "".join(text[i:j] for i, j in inner)
            whole = len(parts) > 1 or (value and not _BLANK.search(value))
            if not (residual.odd(value) if whole else any(map(residual.odd, _VALUE.findall(value)))):
                continue
            given = _GIVEN.search(text, max(0, a - 200), a)
            if given and value and re.search(r"[A-Za-z]", value):
                digits = re.search(r"\d", value)
                if not re.search(r"\s", value):
                    if by_name(given.group("name"), value, 4) and (digits or residual(value) >= 8):
                        spans.extend(inner)
                        continue
                elif (
                    digits and "\n" not in value and value.count(" ") <= 5 and _PASSWORD_NAME.search(_words_of(given.group("name")))
                    and by_name(given.group("name"), value, 6)
                ):
                    spans.extend(inner)
                    continue
            pieces = inner
        else:
            pieces = [(a, b)]
            if not any(map(residual.odd, _VALUE.findall(text[a:b]))):
                continue
        for i, j in pieces:
            spans.extend(_spoken(text, i, j, usable, by_name, residual, kind))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def _spoken(text: str, a: int, b: int, usable, by_name, residual, kind: str):
    """Secrets within the text of one literal or comment."""
    for m in _FORMATS.finditer(text, a, b):
        core = re.sub(r"^[A-Za-z]+[_.-]", "", m.group())
        if not re.search(r"(.)\1{5}|EXAMPLE|example|your|XXXX|placeholder", m.group()) and residual(core) >= 8:
            yield m.span()
    for m in _HOOK.finditer(text, a, b):
        if usable(m.group("v"), 12) and re.search(r"\d|[a-z][A-Z]", m.group("v")):
            yield m.span("v")
    for m in _URL_USER.finditer(text, a, b):
        if usable(m.group("v"), 3):
            yield m.span("v")
    for m in _URL_QUERY.finditer(text, a, b):
        if usable(m.group("v"), 8):
            yield m.span("v")
    for m in _HEADER.finditer(text, a, b):
        if usable(m.group("v"), 8) and re.search(r"[0-9A-Z]", m.group("v")):
            yield m.span("v")
    for m in _COMMAND.finditer(text, a, b):
        g = next(k for k in ("v", "v2", "v3", "v4") if m.group(k))
        if usable(m.group(g), 4) and not m.group(g).startswith(("$", "{", "(", "<", "%")):
            yield m.span(g)
    for m in _BARE.finditer(text, a, b):
        value = m.group("val").rstrip(".,")
        if (re.search(r"\d", value) or residual(value) >= 8) and by_name(m.group("name"), value, 4 if _PASSWORD_NAME.search(_words_of(m.group("name"))) else 8):
            yield m.start("val"), m.start("val") + len(value)
    if kind == "c":
        for m in _PHRASE.finditer(text, a, b):
            value = m.group("v").rstrip(".,;")
            if re.search(r"\d", value) and re.search(r"[A-Za-z]", value) and not _HASH_LIKE.match(value) and usable(value, 4) and "(" not in value:
                yield m.start("v"), m.start("v") + len(value)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each span's characters replaced; the line structure of a
    span that runs over lines is kept, everything else is unchanged."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        inner = text[a:b]
        gap = re.match(r"(?:\\n|\s)*", inner).group()
        out.append(gap + MASK + ("\n" * inner.count("\n"))[gap.count("\n") :] if "\n" in inner or "\\n" in inner else MASK)
        at = b
    return "".join(out) + text[at:]


def name_dictionary(df: DataFrame, size: int = DICTIONARY_SIZE) -> set[str]:
    """The most frequent words of names and signatures, at most `size`. String
    literals are cut out first: a secret that many rows repeat is no word."""
    bare = F.regexp_replace("signature", r"""\"[^\"]*\"|'[^']*'|`[^`]*`""", " ")
    text = F.concat_ws(" ", "name", bare)
    parts = F.split(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z]+")
    words = (
        df.select(F.explode(parts).alias("w")).select(F.lower("w").alias("w")).where(F.length("w").between(3, 16))
        .groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(size)
    )
    return {r.w for r in words.collect()} | {w for w in _BASIC_WORDS.split() if len(w) > 2}


def credentials(df: DataFrame) -> DataFrame:
    """``id, n_secrets, code, signature``: rows whose code or signature holds a
    secret, with every secret replaced and the rest unchanged.

    `df` has the columns id, name, language, code and signature; others are
    ignored. Repeated ids count once. A null code or signature is left null and
    holds no secret, a null or unknown language is read as plain text, a null id
    is left out; texts are read whole.
    """
    spark = df.sparkSession
    known = spark.sparkContext.broadcast(name_dictionary(df))

    def run(batches):
        words = Residuals(known.value)
        for batch in batches:
            keep, count, code, sign = [], [], [], []
            cols = [batch.column(c).to_pylist() for c in ("code", "signature", "language")]
            for i, (text, line, language) in enumerate(zip(*cols)):
                key = language_key(language)
                a = find_secrets(text, key, words) if text else []
                b = find_secrets(line, key, words) if line else []
                if a or b:
                    keep.append(i)
                    count.append(len(a) + len(b))
                    code.append(redact(text, a) if text is not None else None)
                    sign.append(redact(line, b) if line is not None else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(keep, pa.int32())),
                    pa.array(count, pa.int32()),
                    pa.array(code, pa.string()),
                    pa.array(sign, pa.string()),
                ],
                names=["id", "n_secrets", "code", "signature"],
            )

    return (
        df.where(F.col("id").isNotNull()).select("id", "language", "code", "signature")
        .mapInArrow(run, "id string, n_secrets int, code string, signature string")
        .dropDuplicates(["id"])
    )
