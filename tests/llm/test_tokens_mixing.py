"""Token shards and mixing against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing, tokens
from siltstone.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_encoder_is_exact(plain):
    draw = random.Random(1)
    alphabet = ["a", "B", "é", "ß", "7", "'s", "'", ".", ",", " ", " ", "  ", "\n", "\t", " ", " ", "字", "🙂", "-", "it's", "<|endoftext|>", "\x1c", "́", "x"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ["a b <|endoftext|> c", "<|endoftext|>", "x<|endoftext|>\n", "", None, " ", "a ", " a", "a  b", "a \n b"]
    got = tokens.Encoder(vocabulary()).encode(texts)
    assert [np.frombuffer(b, "<u2").tolist() for b in got] == [plain(t)[:-1] for t in texts]


def test_round_trip(docs, rows, plain):
    store = tokens.write(docs, vocabulary(), shard_bytes=20_000)
    assert store.manifest.count() > 4
    got = sorted(tokens.read(store).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i))
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r[0], len(x), crc(x)) for r in rows for x in [plain(r[1])])
    for key in (0, 3, rows[4][0], 361, 9_999_999, 1):
        assert sorted(x.tolist() for x in store.get(key)) == sorted(plain(r[1]) for r in rows if r[0] == key)


def test_perfect_hash():
    keys = np.array(random.Random(2).sample(range(-(1 << 40), 1 << 40), 20_000), np.int64)
    index = tokens.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))
    assert tokens.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_keyed_access_reads_little(tmp_path):
    """As many bytes from a shard of 200 as from one of 20,000 documents, ids apart; keys that aren't there give nothing."""

    class Counted:
        def __init__(self, file):
            self.file, self.n = file, 0

        def read_at(self, n, at):
            self.n += n
            return self.file.read_at(n, at)

    most = {}
    for n in (200, 20_000):
        writer = tokens.ShardWriter(str(tmp_path), f"{n}.shard", 2)
        for i in range(n):
            for _ in range(2 if i % 50 == 7 else 1):
                writer.add(3 * i, np.array([i % 60_000, 1], "<u2").tobytes())
        writer.close()
        shard = tokens.Shard(str(tmp_path), f"{n}.shard")
        shard.file = counted = Counted(shard.file)
        for i in random.Random(n).sample(range(n), 150):
            before = counted.n
            assert [x.tolist() for x in shard.get(3 * i)] == [[i % 60_000, 1]] * (2 if i % 50 == 7 else 1)
            most[n] = max(most.get(n, 0), counted.n - before)
        assert all(shard.get(3 * i + 1) == [] for i in range(300))
    assert most[20_000] <= most[200] + 16 * 8 < 400


def test_empty_tokens(no_docs):
    assert tokens.read(tokens.write(no_docs, vocabulary())).count() == 0


def slow_targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        total = sum(weights[s] for s in names if s not in full)
        now = {s for s in names if s in full or weights[s] * left / total >= most * sizes[s]}
        if now == full:
            return {s: most * sizes[s] if s in full else weights[s] * left / total for s in names}
        full = now


def test_mix(docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken, most = slow_targets(sizes), Counter(), Counter()
    first = sorted(map(tuple, mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=repr)
    again = sorted(map(tuple, mixing.plan(docs.repartition(3)).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=repr)
    assert first == again and len(first) == len(rows)
    assert Counter((r[0], r[1]) for r in first) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    for _, size, source_size, target, words, source in first:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and 0 <= words <= 2 * size
        taken[source] += words
        most[source] = max(most[source], size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("source", "text").collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words == +taken


def test_levels(spark):
    draw = random.Random(3)
    for k in range(6):
        sizes = {f"s{i:03d}": draw.choice([0, 1, 10, 10, 1000, draw.randint(1, 10**6)]) for i in range([1, 2, 5, 60, 60, 3][k])}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(slow_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_names_that_helpers_have(spark, docs):
    odd = docs.withColumns({n: F.lit(k) for k, n in enumerate(("__i", "__T", "__n", "__id", "__tag", "__copies", "copies", "rate", "p", "whole", "target"))})
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == mixing.mix(docs).count()
    assert {tuple(r) for r in mixed.select("__i", "__T", "__n", "__copies").collect()} == {(0, 1, 2, 5)}


def test_rounding_keeps_expectations(spark):
    rows = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("tag"), (F.col("id") % 50 + 1).alias("size"))
    goals = spark.createDataFrame([("s", 153_000, 0.3 * 153_000)], "source string, source_size long, target double")
    runs = [mixing.rounded(rows, goals, seed=s).groupBy((F.col("size") > 25).alias("large")).agg(F.avg("copies").alias("p"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect() for s in (1, 2, 3)]
    for run in runs:
        assert abs(sum(r["n"] for r in run) - 0.3 * 153_000) <= 50
        assert all(abs(r["p"] - 0.3) < 0.05 for r in run)


def test_empty_mix(no_docs):
    assert mixing.plan(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
