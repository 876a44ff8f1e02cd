"""Hybrid retrieval: name, vector, keyword and graph evidence blended per symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.search import row_numbers

# Weights and limits of the blend.
WEIGHTS = {"symbol": 0.30, "vector": 0.35, "keyword": 0.20, "graph": 0.15, "recency": 0.05}
CONSENSUS = 0.08
SYMBOL_LIMIT, KEYWORD_LIMIT, SEEDS, GRAPH_SCORE, KEYWORD_STEP = 25, 50, 5, 0.5, 0.34


def merge_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """``id``, a score per source (0 if absent) and the sorted source names, from
    DataFrames of (id, score)."""
    rows = reduce(DataFrame.unionByName, [d.select("id", F.lit(n).alias("source"), F.col("score").cast("double").alias("score")) for n, d in sources.items()])
    return rows.groupBy("id").agg(
        *[F.coalesce(F.max(F.when(F.col("source") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in sources],
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def recency(df: DataFrame, stamp: str = "updated_at") -> DataFrame:
    """Adds ``recency``: rank by time over n - 1, nulls first, ties by id, 1 for a
    single row. Ranks come from range partitions, so no task holds all rows."""
    n = df.agg(F.count("*").alias("_n"))  # one row
    ranked = row_numbers(df.withColumn("_null", F.col(stamp).isNotNull()), [], ["_null", stamp, "id"], "_rank")
    return ranked.crossJoin(F.broadcast(n)).withColumn(
        "recency", F.when(F.col("_n") == 1, F.lit(1.0)).otherwise((F.col("_rank") - 1) / (F.col("_n") - 1))
    ).drop("_null", "_rank", "_n")


def keyword_signal(hits: DataFrame) -> DataFrame:
    """(id, score) from keyword hits that carry the symbol they fall in."""
    return hits.groupBy(F.col("symbol_id").alias("id")).agg(F.least(F.lit(1.0), F.lit(KEYWORD_STEP) * F.count("*")).alias("score"))


def graph_signal(merged: DataFrame, edges: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(id, score) of the neighbours of the best `seeds` candidates."""
    best = merged.orderBy(F.desc(F.col("symbol") + F.col("vector")), "id").limit(seeds).select("id")
    near = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionAll(edges.select("dst", "src"))
    return near.join(F.broadcast(best), "id").select(F.col("other").alias("id")).distinct().withColumn("score", F.lit(GRAPH_SCORE))


def rank(merged: DataFrame, limit: int = 10) -> DataFrame:
    """Blend with a bonus for agreement between sources; the best first.
    `merged` has the scores, sources, recency, path and start_line."""
    blend = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)) * (1 + CONSENSUS * (F.size("sources") - 1))
    return merged.withColumn("score", F.round(blend, 4)).orderBy(F.desc("score"), "path", "start_line", "id").limit(limit)


def hybrid_retrieve(symbols: DataFrame, edges: DataFrame, named: DataFrame, vectors: DataFrame, keyword: DataFrame, limit: int = 10) -> DataFrame:
    """The four sources as (id, score), merged, completed by the graph, ranked."""
    first = merge_sources({"symbol": named, "vector": vectors, "keyword": keyword})
    live = symbols.select("id", "name", "path", "start_line", "updated_at")
    graph = graph_signal(first, edges).join(live, "id", "left_semi")
    merged = merge_sources({"symbol": named, "vector": vectors, "keyword": keyword, "graph": graph}).join(live, "id")
    return rank(recency(merged), limit).select("id", "name", "path", "start_line", "score", "sources")
