"""Near-duplicates of the pipeline against planted pairs and all pairs."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import pipeline, similar


def planted(n=150, seed=9):
    """Texts with a near copy each, whose words are changed here and there, and the same without; (id, text)."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(n):
        words = [word() for _ in range(draw.choice([40, 120, 400]))]
        copy = list(words)
        for at in draw.sample(range(len(copy)), max(1, len(copy) // draw.choice([40, 55, 80, 150]))):
            copy[at] = word()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy).upper())]
    return rows


def slow_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_planted_pairs(spark):
    rows = planted()
    sets = [slow_set(t) for _, t in rows]
    alike = {i: len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(len(rows) // 2)}
    near = {i for i, j in alike.items() if j >= 0.8}
    assert len([i for i in near if alike[i] < 0.95]) > 30 and len(near) < len(alike)
    kept = {r["doc_id"] for r in pipeline.without_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    gone = {i for i in alike if 2 * i + 1 not in kept}
    assert gone <= near and len(gone) >= 0.95 * len(near)
    assert all(2 * i in kept for i in alike)


def test_recall_is_that_of_the_formula():
    draw, found = np.random.default_rng(2), Counter()
    for _ in range(300):
        base = draw.integers(0, 1 << 63, 180, np.uint64)
        a, b = (np.array(similar.signature(np.unique(np.r_[base[:160], x])), np.int64).view(np.uint64) for x in (base[160:], draw.integers(0, 1 << 63, 20, np.uint64)))
        differ = np.unpackbits((a ^ b).astype(">u8").view(np.uint8))
        found["few"] += differ.sum() <= similar.MOST_BITS
        runs = differ[: 24 * similar.SEGMENTS].reshape(similar.SEGMENTS, -1).sum(axis=1)
        found["run"] += runs.min() <= similar.BUDGET
    assert found["few"] >= 290 and abs(found["run"] / 300 - similar.recall(0.8)) < 0.04


def test_chains_in_a_dense_set(spark):
    """Members that are like some of a set, not like all of it."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    words, rows = [word() for _ in range(200)], []
    for i in range(80):
        if i % 2:
            words[draw.randrange(200)] = word()
        rows.append((i, " ".join([*words[:195], *(word() for _ in range(i % 5))])))
    sets, top = [slow_set(t) for _, t in rows], list(range(80))
    for a, b in itertools.combinations(range(80), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 and top[a] != top[b]:
            top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
    got = similar.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(top))


@pytest.mark.parametrize("max_node", [16_384, 40, 5])
def test_pairs_join_what_brute_force_joins(spark, max_node):
    """One node for each fingerprint: pairs are between different labels, and join every pair that some run shows."""
    draw, prints = random.Random(8), set()
    for _ in range(10):
        base = draw.getrandbits(256)
        for _ in range(25):
            x = base
            for _ in range(draw.choice([0, 4, 12, 30])):
                x ^= 1 << draw.randrange(256)
            prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lanes = [[signed(x >> 64 * (3 - k) & (1 << 64) - 1) for k in range(4)] for x in prints]
    nodes = spark.createDataFrame([(i, i - i % 2 if i % 7 == 0 else i, *w) for i, w in enumerate(lanes)], "node long, label long, s0 long, s1 long, s2 long, s3 long")

    def shown(a, b):
        d = a ^ b
        return bin(d).count("1") <= similar.MOST_BITS and any(bin(d >> 256 - 24 * (k + 1) & (1 << 24) - 1).count("1") <= 2 for k in range(similar.SEGMENTS))

    def sets(links):
        top = list(range(len(prints)))
        for a, b in links:
            if top[a] != top[b]:
                top = [min(top[a], top[b]) if t in (top[a], top[b]) else t for t in top]
        return top

    given = [(i, i - i % 2) for i in range(0, len(prints), 7)]
    found = [(r["u"], r["v"]) for r in similar.pairs(nodes, range(similar.SEGMENTS), max_node=max_node).collect()]
    want = [(a, b) for a, b in itertools.combinations(range(len(prints)), 2) if shown(prints[a], prints[b])]
    assert all(shown(prints[a], prints[b]) for a, b in found)
    if max_node > 5:
        assert sets([*found, *given]) == sets([*want, *given])
    else:  # dense sets are split by further bits
        assert len(set(sets([*found, *given]))) <= 1.1 * len(set(sets([*want, *given])))


def test_pair_that_fails_hides_no_other(spark):
    """The two pairs of fewest bits join three sets and fail the comparison; the third pair is one of near copies."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(f"v{i}" for i in range(60)), " ".join([*words, "end"])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")
    prints = spark.createDataFrame([(0, True, 0, 0, 0, 0), (1, True, 0, 0, 0, 1), (2, True, 0, 0, 0, 7)], "node long, some boolean, s0 long, s1 long, s2 long, s3 long")
    nodes = prints.join(docs.select("node", F.xxhash64("text").alias("x")), "node")
    roots = similar.linked(nodes, docs.select(F.xxhash64("text").alias("x"), F.col("text").cast("binary").alias("text"))).collect()
    assert [tuple(r) for r in roots] == [(2, 0)]


@pytest.mark.parametrize("shared", [1, 30])
def test_large_groups_lose_no_pair(spark, shared):
    """Nodes of one run's bits, more than a task takes: every pair of different labels, and what joins them all, is found."""
    draw = random.Random(6)
    lanes = [tuple(sum(1 << b for b in draw.sample(range(60), 3)) for _ in range(3)) for _ in range(60)]
    rows = [(i, max(i, shared), 0, *w) for i, w in enumerate(lanes)]
    nodes = spark.createDataFrame(rows, "node long, label long, s0 long, s1 long, s2 long, s3 long")
    want = {(v, u) for u, v in itertools.combinations(range(60), 2) if max(u, shared) != max(v, shared)}
    top = {r[1]: r[1] for r in rows}
    for r in similar.pairs(nodes, range(1), max_node=5).collect():
        a, b = top[max(r["u"], shared)], top[max(r["v"], shared)]
        top = {k: min(a, b) if t in (a, b) else t for k, t in top.items()}
    assert len(set(top.values())) == 1
    assert {tuple(r) for r in similar.pairs(nodes, range(1), max_node=5, every=True).select("u", F.explode("vs")).collect()} == want


def test_compared_pairs_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    rows = planted(20)
    docs = spark.createDataFrame(rows, "node long, text string").withColumn("x", F.xxhash64("text"))
    sets = [slow_set(t) for _, t in rows]
    every = spark.createDataFrame([(u, list(range(u))) for u in range(1, len(rows))], "u long, vs array<long>")
    families = spark.createDataFrame([(u, 0) for u in range(1, len(rows))], "u long, root long")
    keyed = similar.blocked_pairs(every, families)
    found = similar.alike(keyed, docs.select("node", "x"), docs.select("x", F.col("text").cast("binary").alias("text")))
    want = {(u, v) for v, u in itertools.combinations(range(len(rows)), 2) if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])}
    assert keyed.select("key").distinct().count() > 50 and {tuple(r) for r in found.collect()} == want


def test_odd_tables(spark, docs, rows, no_docs):
    assert similar.components(docs.withColumns({n: F.lit(1) for n in ("node", "root", "label", "some", "s0", "x", "u", "v", "rep")})).count() == len(rows)
    assert similar.components(no_docs).count() == 0
