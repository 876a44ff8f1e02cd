import random

from siltstone.operators.hierarchy import descendants, hierarchy

SCHEMA = "id string, parent_id string, depth int, root_id string"


def brute(parents):
    out = {}
    for i in parents:
        seen, cur = [i], i
        while True:
            p = parents[cur]
            if p is None or p == "" or p not in parents:
                out[i] = (cur, len(seen) - 1, list(reversed(seen)))
                break
            if p in seen:
                out[i] = (min(seen[seen.index(p):]), -1, None)
                break
            seen.append(p)
            cur = p
    return out


def check(spark, parents, extra=()):
    rows = [(k, v, 7, "x") for k, v in parents.items()] + list(extra)
    random.Random(1).shuffle(rows)
    got = hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(parents)
    assert len(got) == len(want)
    for r in got:
        assert (r.root_id, r.depth, r.path) == want[r.id], (r, want[r.id])
        assert r.in_cycle == (r.depth == -1)


def test_random_forest_with_cycles_and_repeats(spark):
    rnd = random.Random(3)
    ids = [f"n{i:03}" for i in range(120)]
    parents = {i: rnd.choice(ids + [None, "", "gone"]) for i in ids}
    check(spark, parents, [(i, parents[i], 1, "y") for i in ids[:30]] + [(None, "n001", 0, "z")])


def test_long_chain_self_parent_and_ring(spark):
    parents = {f"c{i:03}": (f"c{i - 1:03}" if i else None) for i in range(70)}
    parents |= {"self": "self", "r1": "r2", "r2": "r3", "r3": "r1", "t": "r2"}
    check(spark, parents)


def test_empty_and_descendants(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy(empty).count() == 0
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, parent_id string")
    got = sorted(tuple(r) for r in descendants(hierarchy(df)).collect())
    assert got == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
