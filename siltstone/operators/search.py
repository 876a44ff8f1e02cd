"""Keyword search in lines, ranked search in names, and structural answers."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from siltstone.session import Stage

LINE_LIMIT = 100
LINE_END = "[\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
NAME_LIMIT = 20
LEAST_FUZZY = 0.45


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line`` for every line; a final line end starts no line.
    Carriage returns, vertical tabs, form feeds and the separators of Unicode end
    a line as well."""
    raw = F.col(text)
    body = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), LINE_END, "\n"), r"\n\z", "")
    return df.where(F.col(text) != "").select(key, F.posexplode(F.split(body, "\n")).alias("at", "line")).select(
        key, (F.col("at") + 1).alias("line_no"), "line"
    )


def keyword_hits(lines: DataFrame, text: str, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Lines with a literal or a regular expression; a blank text finds nothing."""
    if not text.strip():
        return lines.where("false")
    line = F.col("line")
    if regex:
        return lines.where(F.rlike(line, F.lit(text if case_sensitive else f"(?i){text}")))
    if case_sensitive:
        return lines.where(F.contains(line, F.lit(text)))
    return lines.where(F.contains(F.lower(line), F.lit(text.lower())))


def first_hits(hits: DataFrame, key: str, limit: int = LINE_LIMIT) -> DataFrame:
    """The first hits of all, by key and line: what a page of results shows."""
    return hits.orderBy(key, "line_no").limit(limit)


def with_context(lines: DataFrame, hits: DataFrame, key: str, context: int = 1) -> DataFrame:
    """Hits with the lines around them. Only the neighbours of hits travel: each
    hit asks for its line numbers, and those are joined to the lines."""
    ask = hits.select(key, "line_no", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)).alias("near"))
    got = ask.join(lines.select(key, F.col("line_no").alias("near"), F.col("line").alias("near_line")), [key, "near"])
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("near", "near_line")))), lambda x: x["near_line"])
    return got.groupBy(key, "line_no").agg(
        F.max(F.when(F.col("near") == F.col("line_no"), F.col("near_line"))).alias("line"),
        pick(F.col("near") < F.col("line_no")).alias("before"),
        pick(F.col("near") > F.col("line_no")).alias("after"),
    )


@F.pandas_udf(DoubleType())
def fuzzy_ratio(name: pd.Series, query: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; names repeat, so each
    distinct name of a batch is compared once."""
    seen: dict[tuple[str, str], float] = {}
    out = []
    for n, q in zip(name, query):
        if (n, q) not in seen:
            seen[n, q] = SequenceMatcher(None, q or "", n or "").ratio()
        out.append(seen[n, q])
    return pd.Series(out)


def ratio_bound(name: Column, query: str) -> Column:
    """No less than the similarity of a name and a query, nor than what a prefix
    or a substring scores: twice the characters they have in common over all."""
    low, q = F.lower(name), query.lower()
    count = lambda ch: F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit("")))
    common = sum((F.least(count(ch), F.lit(q.count(ch))) for ch in sorted(set(q))), F.lit(0))
    return F.when(F.contains(low, F.lit(q)), F.lit(1.0)).otherwise(2 * common / (F.length(low) + len(q)))


def name_score(name: Column, query: str, fuzzy: bool = True) -> tuple[Column, Column]:
    """(score, match type) of a name for a query, without case."""
    low, q = F.lower(name), query.lower()
    longer = F.length(low) - len(q)
    prefix = F.lit(0.9) - F.lit(0.1) * longer / F.greatest(F.length(low), F.lit(1))
    ratio = fuzzy_ratio(low, F.lit(q)) if fuzzy else F.lit(0.0)
    score = (
        F.when(low == q, F.lit(1.0)).when(F.startswith(low, F.lit(q)), prefix)
        .when(F.contains(low, F.lit(q)), F.greatest(ratio, F.lit(0.7))).otherwise(ratio)
    )
    kind = (
        F.when(low == q, "exact").when(F.startswith(low, F.lit(q)), "prefix").when(F.contains(low, F.lit(q)), "substring").otherwise("fuzzy")
    )
    return score, kind


def symbol_search(
    symbols: DataFrame, query: str, languages: list[str] | None = None, types: list[str] | None = None,
    path_prefix: str | None = None, limit: int = NAME_LIMIT, fuzzy: bool = True,
) -> DataFrame:
    """The best names for a query: by score, then length of the name, path,
    start line and id. A blank query finds nothing; empty filters filter nothing."""
    if not query.strip():
        return symbols.select("id", "name", "type", "path", "start_line").withColumns({"score": F.lit(0.0), "match_type": F.lit("")}).where("false")
    df = symbols
    if languages:
        df = df.where(F.lower(F.trim("language")).isin([x.lower() for x in languages]))
    if types:
        df = df.where(F.col("type").isin(types))
    if path_prefix:
        df = df.where(F.col("path").ilike(path_prefix + "%"))
    # names are shared by many symbols: score each distinct name once
    names = df.select("name").distinct()
    if fuzzy:
        names = names.where(ratio_bound(F.col("name"), query) >= LEAST_FUZZY)
    score, kind = name_score(F.col("name"), query, fuzzy)
    names = names.select("name", F.round(score, 4).alias("score"), kind.alias("match_type"))
    names = names.where((F.col("match_type") != "fuzzy") | (F.col("score") >= LEAST_FUZZY))
    return (
        df.join(names, "name").select("id", "name", "type", "path", "start_line", "score", "match_type")
        .orderBy(F.desc("score"), F.length("name"), "path", "start_line", "id").limit(limit)
    )


SORT_KEYS = ("loc", "name", "type", "path", "start_line")


def symbols_page(symbols: DataFrame, needle: str | None = None, sort: str = "loc", order: str = "desc", limit: int = 500) -> DataFrame:
    """A page of symbols: substring filter over the joined fields, one of five
    sort keys, a limit between 1 and 2000. Ties stay in path and line order."""
    df = symbols.withColumn("loc", F.col("end_line") - F.col("start_line") + 1)
    if needle:
        text = F.concat_ws(" ", "name", "type", "language", "path", "signature", F.array_join("decorators", " "))
        df = df.where(F.contains(F.lower(text), F.lit(needle.lower())))
    key = F.col(sort if sort in SORT_KEYS else "loc")
    key = key.asc() if order == "asc" else key.desc()
    return df.orderBy(key, "path", "start_line", "id").limit(max(1, min(2000, limit))).select("id", "name", "type", "path", "start_line", "loc")


# Words that tell the kind of a question, and words that name nothing.
SUPERLATIVES = ("biggest", "largest", "longest", "greatest", "larger", "longer", "most lines", "how big")
LOCATION_WORDS = (
    "where is", "where's", "where are", "where does", "located", "location of", "defined", "definition of", "implemented", "logic of",
    "logic for", "locate", "find the",
)
STOPWORDS = (
    "where is are the logic of for a an in on this that code repo repository function method class located location find defined definition "
    "does do how what which and or to handled handle implemented implement live lives reside resides part there it"
).split()


def question_intent(question: Column) -> Column:
    """biggest_files, biggest_classes, biggest_functions, biggest_symbols, locate or null."""
    q = F.lower(question)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))
    big = has(SUPERLATIVES)
    return (
        F.when(big & has(("file", "module")), "biggest_files")
        .when(big & has(("class", "struct", "interface")), "biggest_classes")
        .when(big & has(("function", "method", "def ")), "biggest_functions")
        .when(big & has(("symbol", "unit")), "biggest_symbols")
        .when(has(LOCATION_WORDS), "locate")
    )


def locate_symbols(symbols: DataFrame, question: str, per_word: int = 5, limit: int = 10) -> DataFrame:
    """Symbols whose name or path holds a word of the question: the widest five
    for each word, words in order, each place once, ten in all."""
    words = [w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", question) if w.lower() not in STOPWORDS]
    if not words:
        return symbols.where("false").select("name", "type", "path", "start_line")
    found = None
    for i, w in enumerate(words):  # a handful of words, a top-k each: nothing is ranked whole
        hit = F.contains(F.lower("name"), F.lit(w.lower())) | F.contains(F.lower("path"), F.lit(w.lower()))
        one = (
            symbols.where(hit).select("name", "type", "path", "start_line", "end_line").distinct()
            .orderBy(F.desc(F.col("end_line") - F.col("start_line")), "path", "start_line", "name", "type", "end_line").limit(per_word)
            .withColumn("word", F.lit(i))
        )
        found = one if found is None else found.unionByName(one)
    place = found.groupBy("path", "start_line", "name").agg(F.min(F.struct("word", -(F.col("end_line") - F.col("start_line")), "type")).alias("first"))
    return place.orderBy("first", "path", "start_line", "name").limit(limit).select("name", F.col("first.type").alias("type"), "path", "start_line")


def enclosing_symbol(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each line of a path the narrowest symbol around it, the first on ties."""
    spans = symbols.select("path", F.col("id").alias("symbol_id"), "start_line", "end_line")
    hit = lines.join(spans, "path").where(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("path", "line_no").agg(
        F.min_by("symbol_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("symbol_id"))).alias("symbol_id")
    )


def top_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Numbers the rows of each group in order, from 1, without holding a group
    in one task: rows are range-partitioned by group and order, numbered inside
    each partition, and shifted by the counts of the partitions before it."""
    stage = Stage(df.sparkSession, "numbers")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())
    ranged = stage.write(ranged, "ranged")
    count = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    ahead = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    count = count.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    return ranged.withColumn(name, inside).join(count, [*by, "_part"]).withColumn(name, F.col(name) + F.col("_ahead")).drop("_part", "_ahead")
