"""The pipeline's stages, each on what the one before kept, against plain versions."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.queries import vocabulary
from tests.llm.test_similar import slow_set
from tests.llm.test_texts import slow_hits
from tests.llm.test_tokens_mixing import slow_targets

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before the first stage and after each, as lists of rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        found.append(docs.collect())
    return found


def test_stages_have_the_columns_of_documents(steps):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert all(rows and set(rows[0].asDict()) == set(steps[0][0].asDict()) for rows in steps[:-1])


def test_toxicity(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    machine = lexicon.automaton()
    score = {r["doc_id"]: toxicity.probability(np.array([toxicity.figures(toxicity.fold(r["text"]), machine)]), lexicon.coefficients)[0] for r in steps[0]}
    assert {r["doc_id"] for r in steps[1]} == {i for i, s in score.items() if s < 0.3}


def test_near_duplicates(steps):
    """One of each set that all pairs of 80 % and more join; the runs find more than nine of ten of these."""
    sets = {r["doc_id"]: slow_set(r["text"]) for r in steps[1]}
    top = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if top[a] != top[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            old, new = max(top[a], top[b]), min(top[a], top[b])
            top = {i: new if t == old else t for i, t in top.items()}
    kept, want = {r["doc_id"] for r in steps[2]}, set(top.values())
    assert want <= kept and len(kept - want) <= 0.1 * (len(top) - len(want))


def test_decontamination(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {h[0] for h in slow_hits([(r["doc_id"], r["text"]) for r in steps[2]], items) if h[-1]}
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(r["doc_id"] for r in steps[2] if r["doc_id"] not in hit)


def test_mixing(steps):
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in steps[3]}
    sums, taken, most = Counter(), Counter(), Counter()
    for r in steps[3]:
        sums[r["source"]] += size[r["doc_id"]]
        most[r["source"]] = max(most[r["source"]], size[r["doc_id"]])
    for r in steps[4]:
        taken[r["source"]] += size[r["doc_id"]]
    assert all(abs(taken[s] - t) <= most[s] for s, t in slow_targets(sums).items())
    assert max(Counter(r["doc_id"] for r in steps[4]).values()) <= 2


def test_token_ids(steps):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    n = {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in steps[4]}
    assert Counter((r["doc_id"], r["n_tokens"]) for r in steps[5]) == Counter((r["doc_id"], n[r["doc_id"]]) for r in steps[4])
    at = 0
    for r in sorted(steps[5], key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_take_odd_rows(spark, docs, no_docs):
    """Nulls, repeated rows, very long texts, extra columns and no rows at all."""
    for rows in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, rows, SF)
            assert name == "token ids" or kept.columns == rows.columns
            kept.count()
