"""Enrichment: model replies, their coercion, and what follows from them.

The tables hold no model replies. The queries read replies that Spark plants in
the form a model gives them, from the columns of each symbol: prose around an
object, a value outside the vocabularies, scores out of range.
"""

from pyspark.sql import functions as F

from siltstone.operators import analytics as A
from siltstone.operators import enrich as E
from siltstone.plans.analytics_queries import _FINDINGS, _findings
from siltstone.plans.registry import query
from siltstone.plans.views import S, sym

ENRICHABLE = ("class", "function", "method", "interface", "struct", "trait", "enum")


def _number(column: str, start: int):
    return F.conv(F.substring(F.md5(column), start, 4), 16, 10).cast("int")


def _pick(words, number):
    return F.element_at(F.array(*map(F.lit, words)), number % len(words) + 1)


def planted_replies(spark, base):
    """``id, reply``: a reply for each symbol of the enrichable types."""
    s = sym(spark, base, "type", "name", "path", "signature", where=F.col("type").isin(*ENRICHABLE))
    n = _number("id", 1)
    body = F.to_json(F.struct(
        F.concat(F.lit(" "), F.coalesce("signature", F.lit(""))).alias("summary"),
        F.array(_pick(E.DOMAINS, n), F.lit("Nonsense")).alias("business_domain"),
        _pick([*E.LAYERS, "Elsewhere"], _number("path", 1)).alias("architecture_layer"),
        F.array(_pick(E.RESPONSIBILITIES, n), F.lit("Juggling")).alias("responsibilities"),
        F.array(F.lit(" "), F.lit("stale")).alias("risks"), F.array().cast("array<string>").alias("technical_debt"),
        F.struct((n % 30 / 20.0).alias("complexity"), (F.lit(0.5) - n % 10 / 10.0).alias("risk")).alias("quality_metrics"),
        (n % 15 / 10.0).alias("confidence"),
    ))
    return s.select("id", F.when(n % 11 == 0, F.lit("I can not tell.")).otherwise(F.concat(F.lit("Sure: "), body, F.lit(" done"))).alias("reply"))


def _enriched(spark, base):
    return E.enrichment(planted_replies(spark, base), "id")


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_EN = f"""q AS (SELECT *, CAST(('0x' || substr(md5(id), 1, 4)) AS INT) AS n, CAST(('0x' || substr(md5(path), 1, 4)) AS INT) AS pn FROM s WHERE type IN ({", ".join(f"'{t}'" for t in ENRICHABLE)})),
en AS (SELECT id, repository_id, path, n % 11 <> 0 AS said, CASE WHEN n % 11 = 0 OR trim(coalesce(signature, '')) = '' THEN 'Unknown' ELSE trim(signature) END AS summary,
CASE WHEN n % 11 = 0 THEN 'Unknown' ELSE ({_list(E.DOMAINS)})[n % {len(E.DOMAINS)} + 1] END AS domain,
CASE WHEN n % 11 = 0 OR pn % {len(E.LAYERS) + 1} = {len(E.LAYERS)} THEN 'Unknown' ELSE ({_list(E.LAYERS)})[pn % {len(E.LAYERS) + 1} + 1] END AS layer,
CASE WHEN n % 11 = 0 THEN '' ELSE ({_list(E.RESPONSIBILITIES)})[n % {len(E.RESPONSIBILITIES)} + 1] END AS responsibilities,
CASE WHEN n % 11 = 0 THEN 0.0 ELSE least(1.0, n % 30 / 20.0) END AS complexity, CASE WHEN n % 11 = 0 THEN 0.0 ELSE greatest(0.0, 0.5 - n % 10 / 10.0) END AS risk,
CASE WHEN n % 11 = 0 THEN 0.0 ELSE least(1.0, n % 15 / 10.0) END AS confidence FROM q)"""


@query("enrichment_records", f"WITH {S}, {_EN} SELECT id, summary, domain AS business_domain, layer AS architecture_layer, responsibilities, CASE WHEN said THEN 'stale' ELSE '' END AS risks, round(CAST(complexity AS DOUBLE), 6) AS complexity, round(CAST(risk AS DOUBLE), 6) AS risk, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM en")
def enrichment_records(spark, base):
    e = _enriched(spark, base)
    return e.select(
        "id", "summary", F.array_join("business_domain", ",").alias("business_domain"), "architecture_layer", F.array_join("responsibilities", ",").alias("responsibilities"),
        F.array_join("risks", ",").alias("risks"), F.round("quality_metrics.complexity", 6).alias("complexity"),
        F.round("quality_metrics.risk", 6).alias("risk"), F.round("confidence", 6).alias("confidence"))


_MODEL = """dom AS (SELECT repository_id, domain AS target, count(*) AS n FROM en WHERE domain <> 'Unknown' GROUP BY 1, 2 HAVING count(*) >= 2),
lay AS (SELECT repository_id, layer AS target, count(*) AS n FROM en WHERE layer <> 'Unknown' GROUP BY 1, 2),
mf AS (SELECT repository_id, 'business_domain' AS category, 'Domain: ' || target AS title, target, 0.6 AS confidence FROM dom
UNION ALL SELECT repository_id, 'architecture_layer', 'Layer: ' || target, target, 0.6 FROM lay)"""


def _model_findings(spark, base):
    enriched = _enriched(spark, base).withColumnRenamed("id", "symbol_id")
    return A.enrichment_findings(sym(spark, base, "repository_id"), enriched)


@query("enrichment_findings", f"WITH {S}, {_EN}, {_MODEL} SELECT repository_id, category, title, target, CAST(confidence AS DOUBLE) AS confidence FROM mf")
def enrichment_findings(spark, base):
    return _model_findings(spark, base)


@query("domain_layer_counts", f"WITH {S}, {_EN}, {_MODEL} SELECT 'domain' AS kind, target, CAST(sum(n) AS BIGINT) AS n FROM dom GROUP BY 2 UNION ALL SELECT 'layer', target, CAST(sum(n) AS BIGINT) FROM lay GROUP BY 2")
def domain_layer_counts(spark, base):
    e = _enriched(spark, base).join(sym(spark, base, "repository_id"), "id")
    domain = e.select("repository_id", F.explode("business_domain").alias("target")).where("target <> 'Unknown'").groupBy("repository_id", "target").agg(F.count("*").alias("n")).where("n >= 2")
    layer = e.where("architecture_layer <> 'Unknown'").groupBy("repository_id", F.col("architecture_layer").alias("target")).agg(F.count("*").alias("n"))
    total = lambda df, kind: df.groupBy("target").agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "target", "n")
    return total(domain, "domain").unionByName(total(layer, "layer"))


@query("join_enriched_symbols", f"WITH {S}, {_EN} SELECT s.id, s.name, en.summary FROM en JOIN s USING (id) WHERE en.summary <> 'Unknown'")
def join_enriched_symbols(spark, base):
    return _enriched(spark, base).where("summary <> 'Unknown'").select("id", "summary").join(sym(spark, base, "name"), "id").select("id", "name", "summary")


@query("file_layers", f"""WITH {S}, {_EN}, c AS (SELECT repository_id, path, layer, count(*) AS n FROM en WHERE layer <> 'Unknown' GROUP BY ALL),
b AS (SELECT repository_id, path, layer FROM c QUALIFY row_number() OVER (PARTITION BY repository_id, path ORDER BY n DESC, layer) = 1)
SELECT f.repository_id, f.path, coalesce(b.layer, CASE WHEN contains(f.path, '/') THEN regexp_extract(regexp_replace(f.path, '/[^/]*$', ''), '[^/]*$') ELSE 'root' END) AS role
FROM (SELECT DISTINCT repository_id, path FROM s) f LEFT JOIN b USING (repository_id, path)""")
def file_layers(spark, base):
    enriched = _enriched(spark, base).withColumnRenamed("id", "symbol_id")
    return A.file_layers(sym(spark, base, "repository_id", "path"), enriched)


@query("findings_by_origin", f"WITH {_FINDINGS}, {_EN}, {_MODEL} SELECT 'static' AS origin, count(*) AS n FROM findings UNION ALL SELECT 'llm', count(*) FROM mf")
def findings_by_origin(spark, base):
    count = lambda df, origin: df.agg(F.count("*").alias("n")).select(F.lit(origin).alias("origin"), "n")
    return count(_findings(spark, base), "static").unionByName(count(_model_findings(spark, base), "llm"))
