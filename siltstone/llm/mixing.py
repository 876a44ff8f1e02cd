"""Mixing sources to target weights (problem 9).

The mix is as large as the scarcest source allows: total = the least of
(tokens x allowed repeats / share). A source's demand is its share of that. It
is met by whole passes over the source and a last, partial pass in the order of
a hash, so no document is used more than one time oftener than another. The
gap that remains, smaller than one document, is closed by up to `FILLERS`
documents the last pass did not reach.

Training positions follow a time-varying curriculum. The weight of a source at
time t in [0, 1] is share * (1 + a * (2t - 1)), with slopes a that balance, so
weights sum to one at any time and integrate to the shares. The cumulative
demand share * (t + a * (t*t - t)) is inverted in closed form at the middle of
each document's place in its source's token sequence; the documents are then
range-sorted by that position.

Cumulative token counts come from two levels: sums over small hash buckets,
accumulated over the buckets of a source, and a window inside each bucket. So
no window holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.tokens import TOKENIZER, token_counts
from siltstone.session import Stage

BUCKET = 2000
#: Documents per source that may close the gap the last pass leaves.
FILLERS = 5
TILT = 0.5


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, tilt: float = TILT, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Returns ``(chosen, report)``.

    chosen: ``position, doc_id, source, pass, n_tokens``, in order of position
    (between 0 and 1), one row per use of a document. report: one row per
    target source, ``source, target_share, actual_share, tokens, available,
    largest_use, max_repeats``.

    Documents of a null or untargeted source, of null id, and without tokens
    are not used; repeated ids count once. A target without documents, or with
    a null or non-positive share or no allowed repeat, cannot be met: it
    reports share 0 and the other targets are scaled up. Empty tables give
    empty results. `targets` is a short list.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "mix")
    sized = token_counts(docs, tokenizer, "source").where("n_tokens > 0 and source is not null")
    sized = stage.write(sized, "sized")
    want = targets.where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs"))
    plan = want.join(have, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("docs", F.lit(0)).alias("docs")
    )
    rows = [r.asDict() for r in plan.collect()]  # one row per target
    usable = [r for r in rows if r["available"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    mass = sum(r["target_share"] for r in usable)
    total = min((r["available"] * r["max_repeats"] / (r["target_share"] / mass) for r in usable), default=0.0)
    # slopes: often repeated sources come later; balanced so that weights sum to one
    most = max((r["max_repeats"] for r in usable), default=1)
    lean = {r["source"]: r["max_repeats"] / most for r in usable}
    mean = sum(r["target_share"] / mass * lean[r["source"]] for r in usable) if usable else 0.0
    plans = [
        (r["source"], r["target_share"] / mass, r["target_share"] / mass * total, tilt * (lean[r["source"]] - mean), int(r["max_repeats"]), float(r["available"]),
         max(1, -(-r["docs"] // bucket)))
        for r in usable
    ]
    plan = spark.createDataFrame(plans, "source string, share double, demand double, slope double, repeats int, available double, buckets long")
    use = (
        sized.join(F.broadcast(plan), "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.least(F.col("repeats"), F.ceil(F.col("demand") / F.col("available")).cast("int")) - 1)))
        .withColumn("rank", F.xxhash64("doc_id", "pass"))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("rank", 1), F.col("buckets")))
    )
    sums = use.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    ahead = W.partitionBy("source", "pass").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0))).drop("in_bucket")
    inside = W.partitionBy("source", "pass", "bucket").orderBy("rank", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    use = use.withColumn("earlier", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["source", "pass", "bucket"])
    start = F.col("pass") * F.col("available") + F.col("before") + F.col("earlier")
    use = use.withColumn("middle", start + F.col("n_tokens") / 2).select(
        "doc_id", "source", "pass", "n_tokens", "middle", "demand", "slope", (start + F.col("n_tokens") <= F.col("demand")).alias("taken")
    )
    use = stage.write(use, "uses")
    taken = use.where("taken")
    # what the last pass leaves open is closed by ever smaller documents it did not reach
    rest = use.where(~F.col("taken"))
    sums = {r.source: r.n for r in taken.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    missing = {p[0]: p[2] - sums.get(p[0], 0) for p in plans}
    fillers: list[tuple] = []
    for _ in range(FILLERS if plans else 0):
        gaps = spark.createDataFrame(list(missing.items()), "source string, gap double")
        pick = (
            rest.join(F.broadcast(gaps), "source").where(F.col("n_tokens") <= F.col("gap"))
            .join(F.broadcast(spark.createDataFrame([f[:3] for f in fillers], "source string, doc_id long, pass int")), ["source", "doc_id", "pass"], "left_anti")
            .groupBy("source").agg(F.max(F.struct("n_tokens", "doc_id", "pass")).alias("x")).collect()
        )
        if not pick:
            break
        for r in pick:  # at most one row per target
            fillers.append((r.source, r.x.doc_id, r.x["pass"]))
            missing[r.source] -= r.x.n_tokens
    added = rest.join(F.broadcast(spark.createDataFrame(fillers, "source string, doc_id long, pass int")), ["source", "doc_id", "pass"])
    use = taken.unionByName(added.withColumn("middle", F.col("demand") - F.col("n_tokens") / 2).select(taken.columns))
    # middle / demand = t + a (t*t - t)  ->  t
    y, a = F.col("middle") / F.col("demand"), F.col("slope")
    root = (-(1 - a) + F.sqrt(F.greatest((1 - a) * (1 - a) + 4 * a * y, F.lit(0.0)))) / (2 * a)
    chosen = use.select(
        F.when(F.abs(a) < 1e-9, y).otherwise(root).alias("position"), "doc_id", "source", "pass", "n_tokens"
    )
    chosen = stage.write(chosen, "chosen")
    stage.drop("sized")
    stage.drop("uses")
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("pass").alias("p"))
    whole = chosen.agg(F.sum("n_tokens").alias("whole"))
    base = spark.createDataFrame(
        [(r["source"], r["target_share"], r["max_repeats"], r["available"]) for r in rows],
        "source string, target_share double, max_repeats int, available long",
    )
    everything = whole.first()["whole"]
    report = base.join(got, "source", "left").withColumn("whole", F.lit(everything)).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), "available", F.coalesce(F.col("p") + 1, F.lit(0)).alias("largest_use"), "max_repeats",
    )
    return chosen.orderBy("position", "doc_id", "pass"), report
