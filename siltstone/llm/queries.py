"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.llm import credentials as cr
from siltstone.llm import documented_functions as df_
from siltstone.llm import languages as lg
from siltstone.llm import mixing as mx
from siltstone.llm import near_duplicates as nd
from siltstone.llm import packing as pk
from siltstone.llm import shared_spans as ss
from siltstone.llm import source_origin as so
from siltstone.llm import syntax as sx
from siltstone.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# 5. Near-duplicate records

def _similar_symbols(spark, base):
    return nd.similar_classes(table(spark, base, "symbols"), "id", "code", threshold=0.7, min_tokens=60)


@query("p5_found")
def p5_found(spark, base):
    return nd.expand_pairs(*_similar_symbols(spark, base))


@query("p5_groups")
def p5_groups(spark, base):
    """One row per symbol of at least 60 tokens: its class, its group and the
    number of other classes it is linked with."""
    members, pairs = _similar_symbols(spark, base)
    nodes = members.select("cls").distinct()
    links = pairs.select("a").union(pairs.select("b")).toDF("cls").groupBy("cls").agg(F.count("*").alias("links"))
    return (
        members.join(nd.components(nodes, pairs), "cls")
        .join(links, "cls", "left")
        .select("id", F.col("cls").alias("class_id"), F.col("component").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


# 3. Long exact spans shared between records

@query("p3_found")
def p3_found(spark, base):
    return ss.shared_windows(table(spark, base, "symbols"), "id", "code", "path").select("id")


@query("p3_spans")
def p3_spans(spark, base):
    return ss.shared_spans(table(spark, base, "symbols"), "id", "code", "path")


# 2. Functions paired with their documentation

@query("p2_found")
def p2_found(spark, base):
    return df_.documented_functions(table(spark, base, "symbols")).select("id")


@query("p2_pairs")
def p2_pairs(spark, base):
    return df_.documented_functions(table(spark, base, "symbols"))


# 6. Credentials embedded in source code

@query("p6_found")
def p6_found(spark, base):
    return cr.credentials(table(spark, base, "symbols")).select("id")


@query("p6_redacted")
def p6_redacted(spark, base):
    return cr.credentials(table(spark, base, "symbols"))


# 1. Generated, minified or vendored source files

def _origins(spark, base):
    return so.source_origins(*[table(spark, base, t) for t in ("files", "file_contents", "library_files")])


@query("p1_found")
def p1_found(spark, base):
    return _origins(spark, base).where("origin is not null").select("file_id")


@query("p1_origins")
def p1_origins(spark, base):
    return _origins(spark, base)


# 4. Source files that do not parse

def _checked(spark, base):
    return sx.syntax_errors(table(spark, base, "files"), table(spark, base, "file_contents"))


@query("p4_found")
def p4_found(spark, base):
    return _checked(spark, base).where("invalid").select("file_id")


@query("p4_rates")
def p4_rates(spark, base):
    return sx.syntax_rates(_checked(spark, base))


# 10. Missing or wrong document language labels

def _identified(spark, base):
    return lg.identify(table(spark, base, "documents"), table(spark, base, "lang_codes"))


@query("p10_found")
def p10_found(spark, base):
    return lg.repaired_labels(_identified(spark, base))


@query("p10_languages")
def p10_languages(spark, base):
    return _identified(spark, base)


# 8. Filling fixed-capacity containers with items

def _packed(spark, base):
    return pk.pack(table(spark, base, "documents"), table(spark, base, "pack_sizes"))


@query("p8_packing")
def p8_packing(spark, base):
    return _packed(spark, base)


@query("p8_report")
def p8_report(spark, base):
    return pk.packing_report(_packed(spark, base), table(spark, base, "pack_sizes"))


# 9. Mixing sources to target weights

@query("p9_mix")
def p9_mix(spark, base):
    return mx.mix(table(spark, base, "documents"), table(spark, base, "mix_targets"))[0]


@query("p9_shares")
def p9_shares(spark, base):
    return mx.mix(table(spark, base, "documents"), table(spark, base, "mix_targets"))[1]
