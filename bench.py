"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; one JSON line."""

import importlib
import json
import os
import time

from siltstone.plans import catalog
from siltstone.session import local_session

CORE = (
    "manifest_diff", "index_report", "explode_lines", "keyword_search", "keyword_context", "symbol_search_exact_prefix", "symbol_search_fuzzy",
    "symbols_page_search", "duplicate_groups", "call_graph_edges", "call_in_degree", "transitive_callers", "impact_files", "dead_code",
    "shared_utilities", "neighborhood_2", "resolve_imports", "vector_topk", "hash_embedding", "hybrid_retrieve", "findings_union",
    "module_summary", "hierarchical_rollup", "file_understanding", "p7_found",
)
LLM = ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p8_packing", "p9_mix", "p10_found")


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    known = dict(catalog.QUERIES)
    names = list(CORE)
    try:
        known |= importlib.import_module("siltstone.llm.queries").QUERIES
        names += LLM
    except ModuleNotFoundError:
        pass
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        began = time.time()
        known[name](spark, base).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(base.rstrip("/"))}))


if __name__ == "__main__":
    main()
