"""Near-duplicate records with small edits: a parity-sketch join (problem 5).

Each record's set of five-token shingles is folded into a sketch of parity bits,
every shingle flipping one bit, whose Hamming distance to another sketch never
exceeds the symmetric difference of the two sets. Two sets of sizes a and b with
Jaccard similarity s or more differ in at most (1-s)/(1+s)*(a+b) shingles.

Candidates come from an exact prefix join, not from a pigeonhole join of sketch
blocks: that needs one block more than the sets may differ in, blocks of two or
three shingles, and blocks of common idioms pair up unrelated records by the
square of the data (figures in the README). Under one fixed order of all
shingles, two sets of similarity s or more share a shingle among the first
n - ceil(s*n) + 1 of each. Shingles that a sample of the records holds often
stand last in that order, the others are ordered by hash; the order decides how
many candidates there are, never which pairs are found. Where the first common
shingle stands bounds the overlap, which drops most other candidates at once.

Keys travel in packed blobs, partitioned by key: six bytes of each key, its
place, and its record once for all keys in a blob. Candidates then pass the
Hamming bound and an exact comparison of the sets. Records with equal shingle
sets are one class: only the class joins. Keys shared by more than `hot` classes
leave the packed join and are joined block by block, so no join key gathers an
unbounded group, and none is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.kernels import distinct_per_text, mix64, shingle_hashes, token_hashes
from siltstone.session import Stage, partitions_for

SKETCH_WORDS = 8  # 512 parity bits
WIDTH = 5
COMMON = 400_000  # shingles known as common, at most
KEYS_PER_PARTITION = 1_500_000
PAIRS_AT_ONCE = 2_000_000  # held in a task before they are passed on
SAMPLE_SHARE, SAMPLE_ROWS = 10, 200_000  # common shingles are counted in a row of so many; beyond so many rows in fewer


def _max_difference(total: np.ndarray, s: float) -> np.ndarray:
    return np.floor((1 - s) / (1 + s) * total + 1e-9)


def _shingles(batches):
    """Shingles that several texts of a batch hold, and how many do."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        _, h = distinct_per_text(*shingle_hashes(*token_hashes(texts), WIDTH))
        h, n = np.unique(h, return_counts=True)
        h, n = h[n > 1], n[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts holds most often, sorted, and the
    rank of each, the most frequent last; at most `COMMON` of them."""
    share = max(SAMPLE_SHARE, texts.select("id").count() // SAMPLE_ROWS)
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
    counts = sample.mapInArrow(_shingles, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toPandas()
    h = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], len(h) - order


def _sketches(min_tokens: int, s: float, common):
    def run(batches):
        often, ranks = common.value
        for batch in batches:
            ids = batch.column("id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc, tok = token_hashes(texts)
            n_tok = np.bincount(doc, minlength=len(texts))
            d, h = distinct_per_text(*shingle_hashes(doc, tok, WIDTH))
            keep = (n_tok >= min_tokens)[d]
            d, h = d[keep], h[keep]
            n = np.bincount(d, minlength=len(texts))
            use = np.flatnonzero(n)
            if not len(use):
                continue
            start = np.concatenate([[0], np.cumsum(n[use])[:-1]])
            with np.errstate(over="ignore"):
                set_hash = mix64(np.add.reduceat(mix64(h), start) ^ n[use].astype(np.uint64))
            row = np.searchsorted(use, d)
            # parity bits
            bit = (mix64(h ^ np.uint64(0xA5A5)) % np.uint64(SKETCH_WORDS * 64)).astype(np.int64)
            flips = np.bincount(row * (SKETCH_WORDS * 64) + bit, minlength=len(use) * SKETCH_WORDS * 64) & 1
            sketch = np.packbits(flips.astype(np.uint8).reshape(len(use), -1), axis=1)
            # the prefix of each set, common shingles last
            rank = np.zeros(len(h), dtype=np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                rank = np.where(often[at] == h, ranks[at], 0)
            key = h[np.lexsort((h, rank, row))]
            prefix = n[use] - np.ceil(s * n[use] - 1e-9).astype(np.int64) + 1
            key = key[np.arange(len(key)) - start[row] < prefix[row]]
            ends = np.concatenate([[0], np.cumsum(prefix)])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(use)),
                    pa.array(set_hash.view(np.int64)),
                    pa.array(n[use].astype(np.int32)),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array([key[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                ],
                names=["id", "cls", "n", "sketch", "keys"],
            )

    return run


def _deal(parts: int):
    """Prefix keys packed by the partition of their key: the low six bytes of
    each key, its place in the set's order, and for each record once its class,
    size and number of keys there. Places take two bytes where they can."""

    def run(batches):
        for batch in batches:
            cls, first = np.unique(batch.column("cls").to_numpy(), return_index=True)  # copies come once
            n = batch.column("n").to_numpy()[first]
            blobs = batch.column("keys").take(pa.array(first)).to_pylist()
            length = np.fromiter((len(x) // 8 for x in blobs), dtype=np.int64, count=len(blobs))
            key = np.frombuffer(b"".join(blobs), dtype=np.uint64)
            if not len(key):
                continue
            owner = np.repeat(np.arange(len(cls)), length)
            at = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
            part = ((key >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((at, owner, part))
            key, owner, at, part = key[order], owner[order], at[order], part[order]
            small = np.uint16 if n.max() < 1 << 16 else np.uint32
            run_at = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])]))
            run_n = np.diff(np.concatenate([run_at, [len(key)]]))
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            edge = np.concatenate([cut, [len(key)]])
            run_edge = np.searchsorted(run_at, edge)
            keys, places, runs = [], [], []
            for i in range(len(cut)):
                a, b, x, y = edge[i], edge[i + 1], run_edge[i], run_edge[i + 1]
                keys.append(np.ascontiguousarray(key[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                places.append(at[a:b].astype(small).tobytes())
                who = owner[run_at[x:y]]
                runs.append(cls[who].tobytes() + n[who].astype(small).tobytes() + run_n[x:y].astype(small).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cut].astype(np.int32)), pa.array([small is np.uint32] * len(cut)),
                    pa.array(keys, pa.binary()), pa.array(places, pa.binary()), pa.array(runs, pa.binary()),
                ],
                names=["part", "wide", "keys", "places", "runs"],
            )

    return run


def _match(s: float, hot: int):
    """Candidate pairs of the classes that share a key of this partition, and
    the entries of keys that more than `hot` classes share, to be joined elsewhere:
    rows ``pair, a, b, n, at`` with the classes of a pair, or a key and its class."""

    def rows(pair, a, b, n=None, at=None):
        zero = np.zeros(len(a), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(a), pair)), pa.array(a), pa.array(b),
                pa.array(zero if n is None else n.astype(np.int32)), pa.array(zero if at is None else at.astype(np.int32)),
            ],
            names=["pair", "a", "b", "n", "at"],
        )

    def run(batches):
        keys, classes, sizes, places = [], [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                small = np.uint32 if batch.column("wide")[i].as_py() else np.uint16
                packed = np.frombuffer(batch.column("keys")[i].as_py(), dtype=np.uint8).reshape(-1, 6)
                key = np.zeros((len(packed), 8), dtype=np.uint8)
                key[:, :6] = packed
                keys.append(key.view(np.int64).ravel())
                places.append(np.frombuffer(batch.column("places")[i].as_py(), dtype=small).astype(np.int64))
                data = batch.column("runs")[i].as_py()
                m = len(data) // (8 + 2 * small().nbytes)
                count = np.frombuffer(data, dtype=small, offset=8 * m + small().nbytes * m)
                classes.append(np.repeat(np.frombuffer(data, dtype=np.int64, count=m), count))
                sizes.append(np.repeat(np.frombuffer(data, dtype=small, offset=8 * m, count=m).astype(np.int64), count))
        if not keys:
            return
        key, cls, n, at = (np.concatenate(x) for x in (keys, classes, sizes, places))
        order = np.lexsort((cls, key))
        key, cls, n, at = key[order], cls[order], n[order], at[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])  # copies in several tasks
        key, cls, n, at = key[new], cls[new], n[new], at[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        end = np.repeat(start + size, size)
        many = np.repeat(size > hot, size)
        if many.any():
            yield rows(False, key[many], cls[many], n[many], at[many])
        left = np.flatnonzero(np.repeat((size > 1) & (size <= hot), size))
        found, held = [], 0
        step = 1
        while len(left):
            left = left[left + step < end[left]]
            x, y = left, left + step
            step += 1
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            # at the first common shingle no more than what follows it can be common
            rest = np.minimum(n[x] - at[x], n[y] - at[y])
            ok = (small >= s * large - 1e-9) & (rest >= s / (1 + s) * (small + large) - 1e-9)
            found.append(np.stack([cls[x[ok]], cls[y[ok]]], axis=1))
            held += len(found[-1])
            if held and (held > PAIRS_AT_ONCE or not len(left)):
                pairs = np.unique(np.concatenate(found), axis=0)
                yield rows(True, pairs[:, 0], pairs[:, 1])
                found, held = [], 0

    return run


def _near(s: float):
    """Keeps the pairs whose sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), dtype=np.uint64)
            b = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), dtype=np.uint64)
            apart = np.bitwise_count(a ^ b).reshape(-1, SKETCH_WORDS).sum(axis=1)
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            ok = (apart <= _max_difference(na + nb, s)) & (np.minimum(na, nb) >= s * np.maximum(na, nb) - 1e-9)
            out = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    return run


def _verify(s: float):
    """Exact similarity of pairs from the texts of both sides."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            ids, at = np.unique(np.concatenate([a, b]), return_index=True)
            texts = [*batch.column("text_a").to_pylist(), *batch.column("text_b").to_pylist()]
            d, h = distinct_per_text(*shingle_hashes(*token_hashes([texts[i] for i in at]), WIDTH))
            edge = np.searchsorted(d, np.arange(len(ids) + 1))
            ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
            sim = np.zeros(len(a))
            for i in range(len(a)):
                x, y = h[edge[ia[i]] : edge[ia[i] + 1]], h[edge[ib[i]] : edge[ib[i] + 1]]
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                sim[i] = common / max(len(both) - common, 1)
            ok = sim >= s - 1e-12
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[ok]), pa.array(b[ok]), pa.array(sim[ok])], names=["a", "b", "similarity"]
            )

    return run


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their `block` of `blocks`, once for each pair of blocks (i, j),
    i <= j, they belong to: on the left those of block i, on the right of j."""
    left = rows.withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1))).withColumnRenamed("block", "i")
    right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), "block"))).withColumnRenamed("block", "j")
    return left.drop("blocks").alias("x"), right.drop("blocks").alias("y")


def similar_classes(
    df: DataFrame,
    id_col: str,
    text_col: str,
    threshold: float,
    min_tokens: int = 0,
    hot: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets and the similar pairs between classes.

    Returns ``members`` (id, cls) for every record with at least `min_tokens`
    tokens and one shingle, and ``pairs`` (a, b, similarity; a < b), one row per
    pair of classes whose similarity is at least `threshold`. Rows with a null
    id or text are left out; repeated ids count once; texts of any length are
    used whole; other columns are ignored; empty tables give empty results.
    """
    spark = df.sparkSession
    stage = Stage(spark, "near")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    common = spark.sparkContext.broadcast(_common(texts))
    made = texts.mapInArrow(
        _sketches(min_tokens, threshold, common), "id string, cls long, n int, sketch binary, keys binary"
    )
    made = stage.write(made, "sketches")
    members = stage.write(made.select("id", "cls").distinct(), "members")
    heads = made.groupBy("cls").agg(F.min("id").alias("head"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    heads = stage.write(heads, "heads")
    total = made.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    parts = partitions_for(spark, total / 8, KEYS_PER_PARTITION)
    dealt = made.select("cls", "n", "keys").mapInArrow(_deal(parts), "part int, wide boolean, keys binary, places binary, runs binary")
    matched = dealt.repartitionById(parts, "part").mapInArrow(_match(threshold, hot), "pair boolean, a long, b long, n int, at int")
    matched = stage.write(matched, "matched")
    stage.drop("sketches")
    shared = matched.where("not pair").select(F.col("a").alias("key"), F.col("b").alias("cls"), "n", "at")
    shared = shared.join(shared.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks")), "key")
    x, y = _sides(shared.withColumn("block", F.pmod("cls", F.col("blocks")).cast("int")))
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = rest >= threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n")) - 1e-9
    by_block = (
        x.join(y, ["key", "i", "j"]).where("(x.cls < y.cls or i < j)").where(enough)
        .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    )
    found = matched.where("pair").select("a", "b").union(by_block).distinct()
    side = heads.select("cls", "n", "sketch")
    near = (
        found.join(side.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a")), "a")
        .join(side.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b")), "b")
        .mapInArrow(_near(threshold), "a long, b long")
    )
    near = stage.write(near, "near")
    needed = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    head_text = (
        texts.join(heads.select("cls", F.col("head").alias("id")).join(needed, "cls", "left_semi"), "id")
        .groupBy("cls").agg(F.min("text").alias("text"))
    )
    head_text = stage.write(head_text, "texts")
    pairs = (
        near.join(head_text.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
        .join(head_text.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
        .mapInArrow(_verify(threshold), "a long, b long, similarity double")
    )
    pairs = stage.write(pairs, "pairs")
    stage.drop("near")
    stage.drop("texts")
    stage.drop("matched")
    stage.drop("heads")
    return members, pairs


def expand_pairs(members: DataFrame, pairs: DataFrame, largest: int = 200) -> DataFrame:
    """All pairs of records ``id_a, id_b`` (id_a < id_b) from classes and their links.

    Every two members of a class and every two members of linked classes are a
    pair, whatever the size of the classes. A class of more than `largest`
    members is split into blocks of about that size and paired block by block,
    so that no join key gathers a whole class.
    """
    size = members.groupBy("cls").agg(F.ceil(F.count("*") / largest).cast("int").alias("blocks"))
    known = members.join(size.where("blocks > 1"), "cls", "left").select(
        "cls", "id", F.coalesce("blocks", F.lit(1)).alias("blocks"),
        F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int").alias("block"),
    )
    x, y = _sides(known)
    inside = x.join(y, ["cls", "i", "j"]).where("i < j or x.id < y.id").select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
    split = size.where("blocks > 1")
    blocks = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    links = (
        pairs.select("a", "b")
        .join(split.select(F.col("cls").alias("a"), F.col("blocks").alias("n_a")), "a", "left")
        .join(split.select(F.col("cls").alias("b"), F.col("blocks").alias("n_b")), "b", "left")
        .select("a", "b", "n_b", blocks(F.col("n_a")).alias("i")).select("a", "b", "i", blocks(F.col("n_b")).alias("j"))
    )
    across = (
        links.join(known.select(F.col("cls").alias("a"), F.col("block").alias("i"), F.col("id").alias("p")), ["a", "i"])
        .join(known.select(F.col("cls").alias("b"), F.col("block").alias("j"), F.col("id").alias("q")), ["b", "j"])
        .select("p", "q")
    )
    return inside.unionByName(across).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def components(nodes: DataFrame, pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``cls, component``: smallest class id reachable over the links.

    Every class takes the smallest label among its own and its neighbours'
    labels, then the label of its label, until nothing changes; the labels of a
    chain thus shrink by doubling steps. One row per class throughout.
    """
    spark = nodes.sparkSession
    stage = Stage(spark, "components")
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).toDF("cls", "other").distinct()
    both = stage.write(both, "links")
    label = stage.write(both.groupBy("cls").agg(F.least(F.col("cls"), F.min("other")).alias("component")), "label-0")
    for turn in range(1, max_rounds + 1):
        near = both.join(label.select(F.col("cls").alias("other"), "component"), "other").groupBy("cls").agg(
            F.min("component").alias("m")
        )
        low = label.join(near, "cls").select(
            "cls", F.col("component").alias("was"), F.least("component", "m").alias("component")
        )
        low = stage.write(low, f"low-{turn}")
        jump = low.join(low.select(F.col("cls").alias("component"), F.col("component").alias("far")), "component").select(
            "cls", "was", F.least("component", "far").alias("component")
        )
        jump = stage.write(jump, f"label-{turn}")
        changed = jump.where("was <> component").limit(1).count()
        label = jump.select("cls", "component")
        stage.drop(f"low-{turn}")
        stage.drop(f"label-{turn - 1}")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(label, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"))
