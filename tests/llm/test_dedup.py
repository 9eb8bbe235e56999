"""SimHash components and substring dedup against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash, substrings
from tests.llm.conftest import SCHEMA, corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(nodes):
    top = {v: v for v in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    return {v: find(v) for v in nodes}


def test_components(docs, rows):
    prints = [slow_fingerprint(r[1]) for r in rows]
    of = slow_components(sorted(set(prints)))
    least = defaultdict(list)
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[of[p]].append(r[0])
    want = Counter((r[0], f"{p:016x}", min(least[of[p]], default=None)) for r, p in zip(rows, prints, strict=True))
    got = simhash.components(docs).select("doc_id", simhash.hexed(F.col("fp")).alias("f"), "component_id").collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("max_node", [16_384, 20, 3])
def test_links_in_dense_sets(spark, max_node):
    import random

    draw, prints = random.Random(3), set()
    for _ in range(12):
        base = draw.getrandbits(64)
        for _ in range(30):
            x = base
            for _ in range(draw.choice([0, 1, 2, 3, 4])):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints = {int(np.uint64(x).astype(np.int64)) for x in prints}
    want = slow_components(sorted(prints))
    found = simhash.connect(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), max_node=max_node)).collect()
    assert {p: p for p in prints} | {r["u"]: r["root"] for r in found} == want


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    prints = {slow_fingerprint(r[1]) for r in rows}
    of = slow_components(sorted(prints))
    roots = [of[slow_fingerprint(r["text"])] for r in kept]
    assert len(roots) == len(set(roots)) == len(set(of.values()))
    named = {of[slow_fingerprint(r[1])] for r in rows if r[0] is not None}
    assert all((r["doc_id"] is not None) == (root in named) for r, root in zip(kept, roots, strict=True))


def test_names_that_helpers_have(docs):
    odd = docs.withColumns({n: F.lit(k) for k, n in enumerate(("__i", "__T", "__id", "__a", "t", "fp2", "root", "component_id", "owner", "copies", "start"))})
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert {tuple(r) for r in kept.select("__i", "__T", "__id", "__a").collect()} == {(0, 1, 2, 3)}
    assert kept.count() == simhash.keep_one(docs).count()
    assert substrings.digests(odd).count() == docs.count()


def test_empty(no_docs):
    assert simhash.components(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    assert substrings.digests(no_docs).count() == 0


def slow_kept(rows, window=50):
    first = {}
    words = [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        if r[0] is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, r[0]), r[0])
    for r, w in zip(rows, words, strict=True):
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            least = first.get(tuple(w[k : k + window]))
            if least is not None and (r[0] is None or least < r[0]):
                keep[k : k + window] = [False] * window
        yield r[0], w, [x for x, y in zip(w, keep, strict=True) if y]


def test_substrings(docs, rows):
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in slow_kept(rows))
    assert Counter(map(tuple, substrings.digests(docs).collect())) == want
    assert sum(n for (_, _, n, _) in want) > 500
    texts = Counter(map(tuple, substrings.deduplicated(docs).collect()))
    assert texts == Counter((i, " ".join(k)) for i, _, k in slow_kept(rows))


def test_passages_of_many(spark):
    """A passage of more documents than are counted, beside one of few, over many batches and salts."""
    rows = corpus(seed=12, n=60)
    shared = " ".join(f"s{i}" for i in range(70))
    rows += [(10_000 - i, f"own{i} words {shared} end", *rows[0][2:]) for i in range(substrings.MANY + 50)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(12)
    assert substrings.sketch(docs, substrings.SEGMENT)[2].any()
    want = Counter((i, len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, w, k in slow_kept(rows))
    assert Counter(map(tuple, substrings.digests(docs).collect())) == want


def test_sketch_loses_nothing(docs, rows):
    width = substrings.SEGMENT
    bits = substrings.sketch(docs, width)
    batch = substrings.Batch([r[0] for r in rows], [None if r[1] is None else r[1].encode() for r in rows])
    owners = defaultdict(set)
    for anchor, doc in zip(batch.anchors().tolist(), batch.doc.tolist(), strict=True):
        owners[anchor].add(rows[doc][0])
    repeated = np.array([a for a, o in owners.items() if len(o) > 1], np.uint64)
    assert len(repeated) and all(substrings._set(bits[k], c).all() for k, c in enumerate(substrings._cells(repeated, width)))
    alone = np.array([a for a, o in owners.items() if len(o) == 1], np.uint64)
    assert np.logical_and(*(substrings._set(bits[k], c) for k, c in enumerate(substrings._cells(alone, width)))).mean() < 0.05
