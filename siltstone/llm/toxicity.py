"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs to Latin letters, drops accents, and maps digits or signs inside a word to the letters they
stand for (l and i, for either of which a 1 is written, are one letter).
The lexicon holds whole words and word beginnings with the log odds of toxic documents among those that hold
them; exception phrases (a lexicon word with its neighbour that clean documents use) take a match back. The sum
of the weights is normalised by the document's length and two figures are mapped to a probability.

Defined cases: a null or empty text has no match and scores what the intercept gives; a null doc_id is scored
like any other and is never in the training rows; repeated rows get equal scores; without labels of both kinds the lexicon is
empty and every score is near 1 where all labels are toxic and near 0 else; terms of equal weight at one place count once; very long
texts are read whole; an empty table gives an empty result; extra columns are kept or ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, cut, local_rows, map_batches

# Letters of other scripts that look like Latin ones, and their Latin letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁԛԝһӏαβεηικνορτυχωɑɡıℓ", "abekmhopctyxijsdqwhlabenikvoptuxwagil", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}

_FOLD = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE) | {chr(c): None for c in range(0x300, 0x370)})  # and combining marks
_BETWEEN = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<!\w)(?:[^\W\d_]+[\d@$!|]+|[\d@$]+[^\W\d_]+)[\w@$!|]*(?<!\W)")
_REST = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The words of ``text``, folded, each between single spaces."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower().translate(_FOLD)
    else:
        text = text.lower()
    text = _MIXED.sub(lambda m: m[0].translate(_BETWEEN), text)
    text = text.replace("l", "i")  # which a 1 may stand for as well
    return f" {_REST.sub(' ', text).strip()} ".replace("  ", " ")


@dataclass
class Lexicon:
    """Weights of words (``" word "``) and beginnings (``" begin"``), exception phrases, and the logistic map."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    coefficients: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(machine):
            machine.make_automaton()
        return machine if len(machine) else None


def figures(folded: str, machine) -> tuple[float, float]:
    """The log of the summed weights, and of their share of the document's words."""
    best: dict[int, float] = {}
    pardoned: list[tuple[int, int]] = []
    if machine is not None:
        for end, (size, weight) in machine.iter(folded):
            at = end - size + 1
            if weight is None:
                pardoned.append((at, end))
            elif weight > best.get(at, 0.0):
                best[at] = weight
    for a, b in pardoned:
        for at in [at for at in best if a <= at < b]:
            del best[at]
    total, words = sum(best.values()), folded.count(" ") - 1
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def probability(x: np.ndarray, coefficients) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(coefficients[0] + x @ np.asarray(coefficients[1:]), -40, 40)))


def training_rows(labels: DataFrame, held_out: Column, max_labelled: int) -> DataFrame:
    """(doc_id, toxic) of at most ``max_labelled`` labelled documents that are not held out, chosen by a hash of the id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def held_out_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, least: int = 5, least_odds: float = 2.0, least_evidence: float = 15.0) -> Lexicon:
    """Learn lexicon, exceptions and map from labelled rows that are not held out.

    At most ``max_labelled`` labelled rows are read, once, and folded; near copies among them count once. Terms, exceptions and what
    reaches the driver are those of this sample, so they are bounded whatever the corpus, and they don't depend on how rows are dealt
    out. A term needs ``least`` toxic rows, odds and a likelihood ratio (G squared) against chance; beginnings that one
    longer term explains are dropped.
    """
    spark = docs.sparkSession
    sample = training_rows(labels, held_out_rows(F.col("doc_id")), max_labelled).collect()
    # bounded: max_labelled pairs of numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(local_rows(spark, sample, doc_id=pa.int64(), toxic=pa.int32())), "doc_id")
    rows = cut(map_batches(rows, _folded, FOLDED, split="text", most_bytes=2 << 20))
    for least_hash in ("m1", "m2"):
        rows = rows.groupBy(least_hash, "toxic").agg(F.min_by(F.struct("folded", "h", "m1", "m2"), "h").alias("r")).select("r.*", "toxic")
    rows = cut(rows.select("folded", "toxic"))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Lexicon(coefficients=(20.0 if toxic else -20.0, 0.0, 0.0))
    terms = map_batches(rows, _terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    share = toxic / (toxic + clean)
    n, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.greatest(F.col("neg"), F.lit(1e-9))
    evidence = 2 * (pos * F.log(pos / (n * share)) + neg * F.log(neg / (n * (1 - share))))
    chosen = terms.where(pos >= least).withColumn("odds", odds).where((F.col("odds") >= least_odds) & (evidence >= least_evidence))
    lexicon = Lexicon({r["term"]: float(r["odds"]) for r in _without_stumps(sorted(chosen.collect(), key=lambda r: r["term"]))})
    shipped = spark.sparkContext.broadcast(lexicon)
    phrases = map_batches(rows, lambda b: _phrases(b, shipped.value), "phrase string, pos long, neg long")
    phrases = phrases.groupBy("phrase").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pardon = F.log((F.col("neg") + 0.5) / (clean + 1)) - F.log((F.col("pos") + 0.5) / (toxic + 1))
    kept = phrases.where(F.col("neg") >= 3).withColumn("odds", pardon).where(F.col("odds") >= 1.0)
    lexicon.exceptions = sorted(r["phrase"] for r in kept.collect())
    ready = spark.sparkContext.broadcast(lexicon)
    points = map_batches(rows, lambda b: _points(b, ready.value), "x1 double, x2 double, y double").toPandas()
    points = points.sort_values(["x1", "x2", "y"])  # so that sums don't depend on the order of partitions
    lexicon.coefficients = _logistic(points[["x1", "x2"]].to_numpy(), points["y"].to_numpy())
    return lexicon


FOLDED = "folded string, toxic int, h long, m1 long, m2 long"


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Folded texts with a hash and two MinHash values of their five-word shingles, of which near copies share one mostly."""
    out = []
    for text, toxic in zip(column(batch, "text"), column(batch, "toxic"), strict=True):
        folded = fold(text)
        words = folded.encode().split()
        starts = range(max(1, len(words) - 4))
        least = [min(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), seed) for i in starts) for seed in (1, 2)]
        numbers = [int(np.uint64(x).astype(np.int64)) for x in (xxhash.xxh64_intdigest(folded.encode()), *least)]
        out.append((folded, toxic, *numbers))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["folded", "toxic", "h", "m1", "m2"])


def _without_stumps(found: list) -> list:
    """Terms without the beginnings that a single longer term mostly stands behind: those say no more than it does."""
    longest: dict[str, int] = {}
    for r in found:
        for n in range(5, min(9, len(r["term"]))):
            start = r["term"][:n]
            longest[start] = max(longest.get(start, 0), r["pos"])
    return [r for r in found if r["term"][-1] == " " or 2 * longest.get(r["term"], 0) < r["pos"]]


def _terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents with each word and each beginning of 4 to 7 letters, by label."""
    count: dict[str, list[int]] = {}
    for folded, toxic in zip(column(batch, "folded"), column(batch, "toxic"), strict=True):
        words = set(folded.split())
        found = {f" {w} " for w in words}
        found.update(f" {w[:n]}" for w in words for n in range(4, min(8, len(w))))
        for term in found:
            count.setdefault(term, [0, 0])[1 - toxic] += 1
    return pa.RecordBatch.from_pydict({"term": list(count), "pos": [c[0] for c in count.values()], "neg": [c[1] for c in count.values()]}, schema=pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))


_MACHINES: dict[int, object] = {}


def _machine(lexicon: Lexicon):
    """The lexicon's automaton, built once in each Python worker."""
    if id(lexicon) not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[id(lexicon)] = (lexicon, lexicon.automaton())
    return _MACHINES[id(lexicon)][1]


def _phrases(batch: pa.RecordBatch, lexicon: Lexicon) -> pa.RecordBatch:
    """Documents with each pair of neighbouring words of which one matches the lexicon, by label."""
    machine, count = _machine(lexicon), {}
    for folded, toxic in zip(column(batch, "folded"), column(batch, "toxic"), strict=True):
        found = set()
        for end, (size, _) in machine.iter(folded) if machine is not None else ():
            at = end - size + 1
            stop = folded.find(" ", at + 1)
            before, after = folded.rfind(" ", 0, max(at, 0)), folded.find(" ", stop + 1)
            if before >= 0:
                found.add(folded[before + 1 : stop])
            if after >= 0:
                found.add(folded[at + 1 : after])
        for phrase in found:
            count.setdefault(phrase, [0, 0])[1 - toxic] += 1
    return pa.RecordBatch.from_pydict({"phrase": list(count), "pos": [c[0] for c in count.values()], "neg": [c[1] for c in count.values()]}, schema=pa.schema([("phrase", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))


def _points(batch: pa.RecordBatch, lexicon: Lexicon) -> pa.RecordBatch:
    machine = _machine(lexicon)
    x = [figures(folded, machine) for folded in column(batch, "folded")]
    return pa.RecordBatch.from_pydict({"x1": [a for a, _ in x], "x2": [b for _, b in x], "y": [float(t) for t in column(batch, "toxic")]})


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[float, float, float]:
    """Newton's method on the penalised logistic loss."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(a.shape[1]), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> Column:
    """A column with the probability, in 0 to 1, that the whole text is toxic."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        model = shipped.value
        machine = _machine(model)
        x = np.array([figures(fold(t), machine) for t in texts], dtype=float).reshape(-1, 2)
        return pd.Series(probability(x, model.coefficients))

    return scored(docs[text])


def assess(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    scored = docs.select("doc_id", held_out_rows(docs["doc_id"]).alias("held_out"), score(docs, lexicon).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
