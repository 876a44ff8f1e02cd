"""Parent-child rows to full hierarchies by tree contraction.

Each round rakes leaves away and then compresses an independent set of unary
nodes (nodes with one remaining child), the local maxima of a fresh random order per round, so
the number of rounds is logarithmic in the number of nodes whatever the depth
of the trees. A removed node is recorded with the parent it had then and its
distance to it. Roots are known at once; going back through the records, one
join per record table gives every removed node its root, depth and path from
those of its recorded parent. What never rakes away is a cycle: compression
shrinks it to a node that is its own parent, and that core passes its smallest
id to everything that was contracted onto it.

Work per round is proportional to the nodes still active. Joins on ids have
one row per key on one side; joins on the parent, where one parent may own a
third of all rows, broadcast the few hot parents and shuffle the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.session import Stage

#: A parent with more than one in this many of a step's rows is hot, so there
#: are fewer hot parents than this, which bounds what is broadcast.
HOT_SHARE = 1000
MAX_ROUNDS = 400


def _rank(c: Column, turn: int) -> Column:
    """A node's priority in a round; the id breaks the (rare) tie."""
    return F.struct(F.xxhash64(c, F.lit(turn)), c)


def join_hot_safe(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join on `key`, which is unique in `right`; rows of the listed hot
    keys (fewer than ``HOT_SHARE``) take a broadcast join instead of a shuffle."""
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    return left.where(~is_hot).join(right.where(~is_hot), key).unionByName(
        left.where(is_hot).join(F.broadcast(right.where(is_hot)), key)
    )


def hot_keys(df: DataFrame, key: str) -> list:
    """Values of `key` on more than 1/HOT_SHARE of the rows (at least 10 000)."""
    counts = df.groupBy(key).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    if total < 10_000:
        return []
    least = max(10_000, total // HOT_SHARE)
    return [r[0] for r in counts.where(F.col("count") > least).collect()]


def hierarchy(
    df: DataFrame,
    id_col: str = "id",
    parent_col: str = "parent_id",
    with_path: bool = True,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """For each distinct id: ``id, root_id, depth, in_cycle`` and, if asked,
    ``path`` (array of ids from the root to the node itself).

    A chain ends at a node whose parent is null, blank or no id of the table.
    A node whose chain never ends has depth -1, ``in_cycle`` true, a null path
    and as root the smallest id on the cycle it reaches. Rows with a null id
    are ignored; repeated rows count once, and if rows of one id name several
    parents, the smallest counts. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = df.sparkSession
    stage = Stage(spark, "hierarchy")
    pairs = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    pairs = pairs.where(F.col("id").isNotNull()).withColumn(
        "parent", F.when(F.trim(F.col("parent").cast("string")) != "", F.col("parent"))
    )
    pairs = pairs.groupBy("id").agg(F.min("parent").alias("parent"))
    # A parent counts only if it is an id of the table: test each distinct parent once.
    pairs = stage.write(pairs, "pairs")
    known = (
        pairs.where("parent is not null").select("parent").distinct()
        .join(pairs.select(F.col("id").alias("parent")), "parent", "left_semi")
    )
    known = stage.write(known, "known")
    hot = hot_keys(pairs.where("parent is not null"), "parent")
    child = join_hot_safe(pairs.where("parent is not null"), known.withColumn("ok", F.lit(True)), "parent", hot)
    seg = F.array().cast("array<string>")
    active = child.select("id", "parent", F.lit(1).alias("w"), F.col("id").alias("low"))
    if with_path:
        active = active.withColumn("seg", seg)
    roots = pairs.join(child.select("id"), "id", "left_anti")
    shape = active.columns

    resolved = [stage.write(_roots(roots, with_path), "resolved-0")]
    active, counts = _write_counted(stage, active.withColumn("state", F.lit(0)), "round-0")
    records: list[tuple[DataFrame, list[int]]] = []
    # state 0: active, 1: raked, 2: compressed, 3: cycle core
    while counts[0]:
        turn = len(records) + 1
        if turn > max_rounds:
            raise RuntimeError(f"tree contraction did not end within {max_rounds} rounds")
        active, counts = _write_counted(
            stage, _contract(active.where("state = 0").select(shape), turn, with_path), f"round-{turn}"
        )
        records.append((active, counts))

    cores = None
    for r, counts in records:
        if not counts[3]:
            continue
        c = r.where("state = 3").select("id", F.col("low").alias("root_id"), F.lit(-1).alias("depth"))
        cores = c if cores is None else cores.unionByName(c)
    if cores is not None:
        if with_path:
            cores = cores.withColumn("path", F.lit(None).cast("array<string>"))
        resolved.append(stage.write(cores, "resolved-cores"))

    for turn in range(len(records), 0, -1):
        record, counts = records[turn - 1]
        for state in (2, 1):  # compression came after raking, so it is undone first
            if not counts[state]:
                continue
            gone = record.where(F.col("state") == state).drop("state", "low")
            so_far = resolved[0]
            for x in resolved[1:]:
                so_far = so_far.unionByName(x)
            so_far = so_far.withColumnRenamed("id", "parent").withColumnRenamed("depth", "up")
            if with_path:
                so_far = so_far.withColumnRenamed("path", "above")
            got = join_hot_safe(gone, so_far, "parent", hot if state == 1 else [])
            out = got.select(
                "id",
                "root_id",
                F.when(F.col("up") < 0, F.lit(-1)).otherwise(F.col("up") + F.col("w")).alias("depth"),
                *([F.concat("above", "seg", F.array("id")).alias("path")] if with_path else []),
            )
            resolved.append(stage.write(out, f"resolved-{turn}-{state}"))
    for turn in range(len(records) + 1):
        stage.drop(f"round-{turn}")
    for name in ("pairs", "known"):
        stage.drop(name)
    out = resolved[0]
    for x in resolved[1:]:
        out = out.unionByName(x)
    return out.withColumn("in_cycle", F.col("depth") < 0)


def _write_counted(stage: Stage, df: DataFrame, name: str) -> tuple[DataFrame, list[int]]:
    """Write a round and count its rows by state on the way."""
    seen = Observation()
    df = df.observe(seen, *[F.count_if(F.col("state") == s).alias(f"n{s}") for s in range(4)])
    out = stage.write(df, name)
    return out, [seen.get[f"n{s}"] for s in range(4)]


def _roots(roots: DataFrame, with_path: bool) -> DataFrame:
    out = roots.select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    if with_path:
        out = out.withColumn("path", F.array(F.col("id").cast("string")))
    return out


def _contract(active: DataFrame, turn: int, with_path: bool) -> DataFrame:
    """One round: every row of `active` again, with its state after the round."""
    kids = active.groupBy("parent").count().select(F.col("parent").alias("id"), F.lit(1).alias("has_kid"))
    marked = active.join(kids, "id", "left").withColumn(
        "state",
        F.when(F.col("id") == F.col("parent"), 3).when(F.col("has_kid").isNull(), 1).otherwise(0),
    ).drop("has_kid")
    # Count only children that stay; a self-parent is a finished core and no child.
    stay = marked.where("state = 0")
    only = (
        stay.groupBy("parent").agg(F.count("*").alias("n"), F.min("id").alias("kid"))
        .where("n = 1").select(F.col("parent").alias("id"), "kid")
    )
    # An independent set of unary nodes: those that outrank their parent and only
    # child. Of a cycle of two, one goes and the other becomes its own parent.
    chosen = stay.join(only, "id").where(
        (_rank(F.col("id"), turn) > _rank(F.col("kid"), turn))
        & (_rank(F.col("id"), turn) > _rank(F.col("parent"), turn))
    )
    chosen = chosen.select(
        F.col("kid").alias("id"),
        F.col("id").alias("gone"),
        F.col("parent").alias("new_parent"),
        F.col("w").alias("more"),
        F.col("low").alias("low2"),
        *([F.col("seg").alias("seg2")] if with_path else []),
    )
    state = (
        marked.join(chosen, "id", "left")
        .join(chosen.select(F.col("gone").alias("id"), F.lit(2).alias("compressed")), "id", "left")
    )
    moved = F.col("gone").isNotNull()
    return state.select(
        "id",
        F.coalesce("new_parent", "parent").alias("parent"),
        (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
        F.least("low", "low2").alias("low"),
        *(
            [F.when(moved, F.concat("seg2", F.array("gone"), "seg")).otherwise(F.col("seg")).alias("seg")]
            if with_path
            else []
        ),
        F.coalesce("compressed", "state").alias("state"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """All pairs ``ancestor_id, descendant_id, distance`` (distance at least 1)
    of a `hierarchy` with paths. Nodes whose chain never ends have no pairs."""
    return (
        tree.where(~F.col("in_cycle"))
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
        .where(F.col("at") < F.col("depth"))
        .select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )
