"""Column functions over names, code and model output; all run inside the JVM."""

from __future__ import annotations

import hashlib
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# File name suffix -> language, and names without a suffix.
LANGUAGE_BY_SUFFIX = {
    "py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "go": "Go", "rs": "Rust", "java": "Java",
    "cs": "C#", "php": "PHP", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "c": "C", "h": "C", "cc": "C++", "cpp": "C++",
    "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "sql": "SQL", "html": "HTML", "htm": "HTML", "css": "CSS",
    "md": "Markdown", "markdown": "Markdown", "yaml": "YAML", "yml": "YAML", "json": "JSON",
}
LANGUAGE_BY_NAME = {"dockerfile": "Dockerfile", "makefile": "Makefile"}
SPAN_CHARS = 200


_STRING = r'"(?:[^"\\\n]|\\.)*"'
_QUOTED = r"'(?:[^'\\\n]|\\.)*'"
_CHAR = r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'"
_SLASHED = r"//[^\n]*|/\*(?s:.*?)\*/"
#: Comments and literals by the way a language writes them: with # , with // and
#: quoted strings, with // and quoted characters.
TEXT_FORMS = {
    "hash": r'"""(?s:.*?)"""|' + r"'''(?s:.*?)'''" + f"|{_STRING}|{_QUOTED}|#[^\\n]*",
    "script": f"{_SLASHED}|{_STRING}|{_QUOTED}|`[^`]*`",
    "char": f"{_SLASHED}|{_STRING}|{_CHAR}|`[^`]*`",
}
HASH_LANGUAGES = ("python", "yaml", "ruby", "shell", "dockerfile", "makefile")
SCRIPT_LANGUAGES = ("javascript", "typescript", "php", "css")


def without_texts(code: Column, language: Column) -> Column:
    """Code with a blank in place of every comment and string literal. The
    loops are possessive, so a literal of any length needs no stack."""
    form = {k: F.regexp_replace(code, v.replace(")*", ")*+"), " ") for k, v in TEXT_FORMS.items()}
    lang = F.lower(F.trim(language))
    return F.when(lang.isin(*HASH_LANGUAGES), form["hash"]).when(lang.isin(*SCRIPT_LANGUAGES), form["script"]).otherwise(form["char"])


def without_comments(code: Column) -> Column:
    """Code of a language with // comments without them; literals stay."""
    return F.regexp_replace(code, f"({_STRING}|{_QUOTED}|`[^`]*`)|{_SLASHED}".replace(")*", ")*+"), "$1")


@F.pandas_udf(StringType())
def blake2b(text: pd.Series) -> pd.Series:
    """BLAKE2b-128 of the UTF-8 bytes, in hex; null for null."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())


@F.pandas_udf(StringType())
def blake2b_bytes(data: pd.Series) -> pd.Series:
    """BLAKE2b-128 of bytes, in hex; null for null."""
    return data.map(lambda b: None if b is None else hashlib.blake2b(b, digest_size=16).hexdigest())


def strip_quotes(value: Column) -> Column:
    """Without surrounding blanks, then without surrounding quote characters."""
    return F.regexp_replace(F.trim(value), "^[\"'`]+|[\"'`]+$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column, root: str = ".") -> Column:
    """The directory part of a path, `root` for a path without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(root))


def detect_language(path: Column) -> Column:
    """Language by suffix first, then by whole name; null if neither is known."""
    suffix = F.create_map(*map(F.lit, chain(*LANGUAGE_BY_SUFFIX.items())))
    name = F.create_map(*map(F.lit, chain(*LANGUAGE_BY_NAME.items())))
    base = F.lower(base_name(path))
    return F.coalesce(suffix[F.regexp_extract(base, r"[^.]\.([^.]+)$", 1)], name[base])


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1), F.lower)


def identifier_keywords(name: Column) -> Column:
    """Words of a camelCase or snake_case name, lower-case, distinct, sorted."""
    split = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "_", " ")), " +")
    return F.array_sort(F.array_distinct(F.filter(split, lambda x: x != "")))


def first_line(code: Column) -> Column:
    """The first line that is not blank, trimmed, at most 200 characters."""
    lines = F.filter(F.transform(F.split(code, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(F.left(F.get(lines, F.lit(0)), F.lit(SPAN_CHARS)), F.lit(""))


def visibility(language: Column, name: Column, signature: Column) -> Column:
    """By a keyword in front of the name, else by the language's convention."""
    lead = F.when(F.contains(signature, name), F.get(F.split(F.replace(signature, name, F.lit("\0")), "\0"), F.lit(0))).otherwise(signature)
    out = None
    for word in ("private", "protected", "public", "internal"):
        test = F.contains(lead, F.lit(word))
        out = F.when(test, F.lit(word)) if out is None else out.when(test, F.lit(word))
    lang = F.lower(F.trim(language))
    public = lambda c: F.when(c, F.lit("public")).otherwise(F.lit("private"))
    return (
        out.when(lang == "python", public(~F.startswith(name, F.lit("_")) | (F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__")))))
        .when(lang == "go", public(F.rlike(name, F.lit("^[A-Z]"))))
        .when(lang == "rust", public(F.startswith(F.ltrim(signature), F.lit("pub"))))
        .otherwise(F.lit("unknown"))
    )


def decorator_names(decorators: Column) -> Column:
    """Decorators without the at sign and call arguments, in order, distinct."""
    return F.array_distinct(F.transform(decorators, lambda d: F.regexp_replace(F.regexp_replace(d, r"^@", ""), r"\(.*$", "")))


def clamp(x: Column) -> Column:
    """Into [0, 1]; NaN becomes 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def keep_vocabulary(values: Column, vocabulary: list[str], fallback: str | None = None) -> Column:
    """Values that are in the vocabulary, in order; the fallback if none is."""
    kept = F.filter(values, lambda v: v.isin(vocabulary))
    return kept if fallback is None else F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(fallback)))


def model_json(raw: Column, schema: str) -> Column:
    """The object between the first and last brace of a reply, null if it is none."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector is unchanged."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 on different lengths or a zero vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)
