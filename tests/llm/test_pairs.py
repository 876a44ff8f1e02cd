"""Shared spans and near-duplicates against brute force, and their edge cases."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import near_duplicates as nd
from siltstone.llm import shared_spans as ss
from siltstone.llm.kernels import PrefixHash, code_points, token_hashes

COLS = "id string, code string, path string, n int, doc string, text string, cls string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], COLS)


def make(seed=1, n=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(70, 160))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = base[i % len(base)].split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        if rnd.random() < 0.2:
            k = rnd.randrange(len(t))
            t = t[k:] + t[:k]
        rows.append((f"d{i:03}", " ".join(t), f"p{i % 7}"))
    return rows


def edge(rows):
    return rows + [rows[0], (None, rows[0][1], "p9"), ("nul", None, "p1"), ("emp", "", "p1"), ("nop", rows[1][1], None), ("uni", "日本語 ☃ 𝒳 " * 60, "p1")]


def test_difference_cover():
    assert {(a - b) % ss.PERIOD for a in ss.COVER for b in ss.COVER} == set(range(ss.PERIOD))


def test_shared_spans_equal_brute_force(spark):
    rows = edge(make(2))
    got = {r.id: r for r in ss.shared_spans(frame(spark, rows), "id", "code", "path").collect()}
    docs = {r[0]: (r[1], r[2]) for r in rows if r[0] and r[1]}
    owners = {}
    for t, p in docs.values():
        for j in range(len(t) - 199):
            owners.setdefault(t[j : j + 200], set()).add(p)
    for k, (t, _) in docs.items():
        covered = set()
        for j in range(len(t) - 199):
            if len(owners[t[j : j + 200]]) > 1:
                covered |= set(range(j, j + 200))
        assert (k in got) == bool(covered), k
        if covered:
            assert got[k].shared_chars == len(covered)
            assert {x for s in got[k].spans for x in range(s.start, s.end)} == covered
            assert abs(got[k].shared_share - len(covered) / len(t)) < 1e-12


def test_one_text_in_every_record(spark):
    """A third of all rows and more share a text: nothing is paired or lost."""
    text = " ".join(f"x{i}" for i in range(90))
    rows = [(f"h{i:03}", f"{i} {text}", f"p{i % 5}") for i in range(300)]
    assert ss.shared_windows(frame(spark, rows), "id", "code", "path").count() == 300


def test_empty_tables(spark):
    empty = spark.createDataFrame([], COLS)
    assert ss.shared_windows(empty, "id", "code", "path").count() == 0
    members, pairs = nd.similar_classes(empty, "id", "code", 0.7)
    assert members.count() == 0 and pairs.count() == 0 and nd.expand_pairs(members, pairs).count() == 0


def shingles(text):
    t = re.findall(r"[A-Za-z0-9_]+|\S", text)
    return t, {tuple(t[i : i + 5]) for i in range(len(t) - 4)}


def test_similar_pairs_equal_brute_force(spark):
    rows = edge(make(5, 90))
    members, pairs = nd.similar_classes(frame(spark, rows), "id", "code", 0.7, min_tokens=60)
    got = {tuple(r) for r in nd.expand_pairs(members, pairs).collect()}
    docs = {r[0]: shingles(r[1]) for r in rows if r[0] and r[1]}
    docs = {k: s for k, (t, s) in docs.items() if len(t) >= 60}
    want = set()
    for a in docs:
        for b in docs:
            if a < b and len(docs[a] & docs[b]) / len(docs[a] | docs[b]) >= 0.7:
                want.add((a, b))
    assert got == want and want


def test_hot_keys_and_large_classes(spark):
    """Many copies of one text and many near-copies: links stay, stars for copies."""
    base = [f"t{i}" for i in range(120)]
    rows = [(f"c{i:03}", " ".join(base), "p") for i in range(40)]
    rows += [(f"v{i:03}", " ".join(base[:i] + [f"z{i}"] + base[i + 1 :]), "p") for i in range(10, 60)]
    members, pairs = nd.similar_classes(frame(spark, rows), "id", "code", 0.8, min_tokens=60, hot=5)
    got = {tuple(r) for r in nd.expand_pairs(members, pairs, largest=10).collect()}
    variants = {x[0] for x in rows if x[0][0] == "v"}
    assert sum(a in variants and b in variants for a, b in got) == 50 * 49 // 2
    assert all(("c000", f"c{i:03}") in got for i in range(1, 40)) and all(("c000", v) in got for v in variants)
    groups = nd.components(members.select("cls").distinct(), pairs)
    assert groups.select("component").distinct().count() == 1


def test_every_pair_of_a_large_class(spark):
    """More than 200 copies, a text of the same shingle set and a near-copy: no pair is left out."""
    base = [f"t{i}" for i in range(12)] * 6
    rows = [(f"c{i:03}", " ".join(base), "p") for i in range(230)]
    rows += [("r", " ".join(base + base[:12]), "p"), ("q", " ".join(base + ["end"]), "p")]
    members, pairs = nd.similar_classes(frame(spark, rows), "id", "code", 0.7, min_tokens=60)
    got = [tuple(r) for r in nd.expand_pairs(members, pairs).collect()]
    ids = sorted(r[0] for r in rows)
    assert sorted(got) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]


def test_pairs_whose_shared_keys_are_hot(spark):
    """Pairs just above the threshold, of texts of which few parts are equal: hot keys alone find them."""
    rows, want = [], set()
    for k in (2435, 3384, 3503):
        t = [f"t{k}x{i}" for i in range(432)]
        rows += [(f"a{k}", " ".join(t), "p"), (f"b{k}", " ".join(t[:304]), "p")]
        want.add((f"a{k}", f"b{k}"))
    members, pairs = nd.similar_classes(frame(spark, rows), "id", "code", 0.7, min_tokens=60, hot=1)
    assert {tuple(r) for r in nd.expand_pairs(members, pairs).collect()} == want


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=200))
def test_prefix_hash_and_tokens(text):
    points = code_points(text)
    h = PrefixHash(points)
    n = len(points)
    for a in range(0, n, 3):
        for b in range(a, min(n, a + 4)):
            for c in range(0, n - (b - a) + 1, 5):
                same = text[a:b] == text[c : c + b - a]
                equal = h.of(np.array([a]), np.array([b]))[0] == h.of(np.array([c]), np.array([c + b - a]))[0]
                assert same == equal
    doc, tok = token_hashes([text, text])
    want = re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", text)
    want = [w for w in want if not w.isspace()]
    assert (doc == 0).sum() == len(want) == (doc == 1).sum()
    assert (tok[doc == 0] == tok[doc == 1]).all()
