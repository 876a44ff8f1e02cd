"""Missing or wrong document language labels (problem 10).

A multinomial naive Bayes model over hashed character n-grams. It is fitted on
a bounded sample of labelled documents (about `FIT_ROWS`, chosen by the hash of
the id), first with the given labels and then once more with the model's own
reading of each paragraph, which removes wrong labels and mixed documents. The
log-probability matrix (`BUCKETS` x languages, a fixed size) is broadcast, and
batches of paragraphs are scored as sparse sums in numpy.

A document is read by paragraphs of prose: headings, code, quotations, paths
and identifiers do not count. Case and Latin accents are folded. A paragraph
takes another language than the document as a whole only if its own evidence
for it is clear.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import code_points
from siltstone.session import Stage

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
FIT_ROWS = 10_000
SMOOTHING = 0.5
DOC_CHARS = 2000
#: A paragraph of another language needs so many letters, and this lead in nats.
LEAST_LETTERS = 14
LEAST_LEAD = 8.0

_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_DROP_LINE = re.compile(r"^\s*(?:#{1,6}(?:\s|$)|[|>]|={3,}\s*$|-{3,}\s*$|\*{3,}\s*$|at \S+ \(|File \"|Traceback )")
_UNDERLINE = re.compile(r"^[ \t]*\S[^\n]*\n[ \t]*(?:={3,}|-{3,})[ \t]*$", re.M)
_PREFIX = re.compile(r"^\s*(?:[-*+•]\s+|\d+[.)]\s+)?(?:(?i:feat|fix|docs|chore|refactor|test|perf|style|build|ci|revert)(?:\([^)\n]*\))?!?:\s*)?")
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|「[^」\n]*」|『[^』\n]*』")
#: A word that is a path, a number, an identifier or a file name.
_NO_WORD = re.compile(r"[/\\_0-9]|\(\)|[a-z][A-Z]|\w\.(?:py|js|ts|tsx|go|rs|java|md|json)\b")
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_ASCII = re.compile(r"[!-~]+")
_NOT_LETTERS = re.compile(r"[^\w']+|[\d_]+| +")
_FOLD = str.maketrans(
    "àáâãäåāçćčèéêëēìíîïīñńòóôõöøōùúûüūýÿšžßœæłđ",
    "aaaaaaaccceeeeeiiiiinnooooooouuuuuyyszsoald",
)


_words: dict[str, str] = {}
_WORDS_KEPT = 200_000  # per process


def _word(w: str) -> str:
    """A word folded to its letters; a path, number or identifier gives what is
    not ASCII in it."""
    got = _words.get(w)
    if got is None:
        if len(_words) >= _WORDS_KEPT:
            _words.clear()
        prose = w if not _NO_WORD.search(w) else "" if w.isascii() else _ASCII.sub(" ", w)
        got = _words[w] = _NOT_LETTERS.sub(" ", prose.lower().translate(_FOLD)).strip()
    return got


def paragraphs(text: str) -> list[str]:
    """The prose of a text by paragraph, folded; paragraphs without letters are left out."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "===" in text or "---" in text:
        text = _UNDERLINE.sub("", text)
    out = []
    for block in _PARAGRAPH.split(text):
        lines = [_PREFIX.sub("", x, 1) for x in block.split("\n") if not _DROP_LINE.match(x)]
        prose = " ".join(" ".join(map(_word, _QUOTED.sub(" ", " ".join(lines)).split())).split())
        if len(prose) > 1:
            out.append(prose)
    return out


def gram_buckets(texts: list[str]):
    """For each n-gram size (text index, bucket) of the character n-grams within
    each text, in order of the texts."""
    joined = code_points("\n".join(f" {t} " for t in texts) + "\n")
    stop = joined == 10
    owner = np.cumsum(stop) - stop
    h = joined * np.uint32(0x85EBCA6B)
    ok = ~stop
    with np.errstate(over="ignore"):
        for n in range(2, max(SIZES) + 1):
            m = len(joined) - n + 1
            if m <= 0:
                return
            h = h[:m] * np.uint32(0x01000193) + joined[n - 1 :]
            ok = ok[:m] & ~stop[n - 1 :]
            if n in SIZES:
                yield owner[:m][ok], ((h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def scores(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text under each language."""
    out = np.zeros((len(texts), logp.shape[1]))
    at, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size > 200_000:
            if i > at:
                for which, bucket in gram_buckets(texts[at:i]):
                    if len(which):
                        start = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                        out[at + which[start]] += np.add.reduceat(logp[bucket], start, axis=0)
            at, size = i, 0
        if i < len(texts):
            size += len(texts[i])
    return out


def label_key(label: Column) -> Column:
    """A label without case, blanks and region."""
    return F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")


def canonical_labels(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """Adds ``label_code``: the code a label names in any of its forms, or null.
    `codes` (code, iso3, english_name) is a fixed list of languages."""
    forms = codes.select("code", F.explode(F.array("code", "iso3", "english_name")).alias("form"))
    forms = forms.where("form is not null").groupBy(F.lower(F.trim("form")).alias("label_form")).agg(F.min("code").alias("label_code"))
    return df.withColumn("label_form", label_key(F.col(label))).join(F.broadcast(forms), "label_form", "left").drop("label_form")


def _counts(languages: list[str], logp):
    """Gram counts by language of labelled texts; with a model, of the language
    it reads in each paragraph instead."""
    model = logp

    def run(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.float32)
        for batch in batches:
            texts, owner, weight = [], [], []
            for code, text in zip(batch.column("label_code").to_pylist(), batch.column("text").to_pylist()):
                got = paragraphs(text)
                texts += got
                owner += [languages.index(code)] * len(got)
                # a very long document counts like one of DOC_CHARS characters
                weight += [min(1.0, DOC_CHARS / max(sum(map(len, got)), 1))] * len(got)
            if not texts:
                continue
            owner = np.asarray(owner)
            if model is not None:
                owner = scores(texts, model.value).argmax(axis=1)
            weight = np.asarray(weight)
            for which, bucket in gram_buckets(texts):
                cell = owner[which] * BUCKETS + bucket
                total += np.bincount(cell, weights=weight[which], minlength=total.size).reshape(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(languages)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], names=["lang", "counts"]
        )

    return run


def fit(labelled: DataFrame, languages: list[str], rows: int = FIT_ROWS, total: int | None = None) -> np.ndarray:
    """The log-probability matrix from `labelled` (doc_id, text, label_code), of
    which there are `total`; both passes read the sample as it was written once."""
    spark = labelled.sparkSession
    stage = Stage(spark, "languages")
    share = rows / max(labelled.count() if total is None else total, 1)
    sample = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = stage.write(sample.dropDuplicates(["doc_id"]).repartition(8), "sample")

    def matrix(logp):
        got = sample.mapInArrow(_counts(languages, logp), "lang int, counts binary").collect()  # a row per task and language
        total = np.zeros((len(languages), BUCKETS))
        for r in got:
            total[r.lang] += np.frombuffer(r.counts, dtype=np.float32)
        total += SMOOTHING
        return np.log(total / total.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()

    logp = matrix(None)
    logp = matrix(spark.sparkContext.broadcast(logp))
    stage.drop()
    return logp


def identify(docs: DataFrame, codes: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, label_code, lang, confidence, segments``: the language of each
    document with prose, and that of each of its paragraphs (array of structs
    seq, lang, confidence, n_chars).

    `docs` has doc_id, text and lang; other columns are ignored. Rows with a
    null id or text, and texts without prose, give no row; repeated ids count
    once; texts are read whole. A confidence is the posterior probability with
    the evidence tempered by the number of characters. If no row carries a
    known label there is nothing to fit on and the result is empty.
    """
    spark = docs.sparkSession
    languages = sorted(r.code for r in codes.select("code").distinct().collect() if r.code)  # the fixed list
    known = canonical_labels(
        docs.where("doc_id is not null and text is not null").select("doc_id", "text", "lang"), "lang", codes
    )
    labelled = known.where("label_code is not null")
    out = "doc_id long, label_code string, lang string, confidence double, segments array<struct<seq:int,lang:string,confidence:double,n_chars:int>>"
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], out)
    model = spark.sparkContext.broadcast(fit(labelled, languages, rows, total))

    def run(batches):
        kind = pa.list_(pa.struct([("seq", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_chars", pa.int32())]))
        for batch in batches:
            texts, owner = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = paragraphs(text)
                texts += got
                owner += [i] * len(got)
            got = scores(texts, model.value) if texts else np.zeros((0, len(languages)))
            length = np.fromiter((len(t) for t in texts), dtype=np.float64, count=len(texts))
            owner = np.asarray(owner, dtype=np.int64)
            keep, lang, sure, segments = [], [], [], []
            edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for i in range(batch.num_rows):
                a, b = edge[i], edge[i + 1]
                if a == b:
                    continue
                s = got[a:b]
                total = s.sum(axis=0)
                main = int(total.argmax())
                best = s.argmax(axis=1)
                lead = s[np.arange(b - a), best] - s[:, main]
                own = np.where((lead >= LEAST_LEAD) & (length[a:b] >= LEAST_LETTERS), best, main)
                prob = np.exp((s - s.max(axis=1, keepdims=True)) / np.sqrt(length[a:b] + 1)[:, None])
                prob /= prob.sum(axis=1, keepdims=True)
                whole = np.exp((total - total.max()) / np.sqrt(length[a:b].sum() + 1))
                keep.append(i)
                lang.append(languages[main])
                sure.append(float(whole[main] / whole.sum()))
                segments.append(
                    [
                        {"seq": j, "lang": languages[own[j]], "confidence": float(prob[j, own[j]]), "n_chars": int(length[a + j])}
                        for j in range(b - a)
                    ]
                )
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("label_code").take(at), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(segments, kind)],
                names=["doc_id", "label_code", "lang", "confidence", "segments"],
            )

    # texts are not shuffled: ids that repeat lose their second row after scoring
    return known.select("doc_id", "label_code", "text").mapInArrow(run, out).dropDuplicates(["doc_id"])


def repaired_labels(found: DataFrame) -> DataFrame:
    """``doc_id, lang``: documents whose label is missing or wrong, and every
    document in several languages, one row per language of a whole paragraph."""
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    wrong = F.col("label_code").isNull() | (F.size(langs) > 1) | (F.col("label_code") != F.element_at(langs, 1))
    return found.where(wrong).select("doc_id", F.explode(langs).alias("lang"))
