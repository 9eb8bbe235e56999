"""Full-text ranking and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import cut


def _equal(term: str):
    return lambda word: word == F.lit(term)


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the documents with any of ``terms``.

    Texts are read once: what is kept of each are its length and the terms' counts, and no text is shuffled.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    wanted = list(dict.fromkeys(terms))
    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("double").alias("len"), *(F.size(F.filter(w, _equal(t))).alias(f"tf{i}") for i, t in enumerate(wanted))))
    rows = cut(docs.select(key, F.inline(counted)))
    stats = rows.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))))
    both = rows.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        score += idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return both.select(key, score.alias("score")).where("score > 0")


def _packed(rows: DataFrame, key: str, vector: str, size: int, *by: str) -> DataFrame:
    """Vectors of unit length, ``size`` a row: their keys and numbers as bytes; rows of different ``by`` stay apart if they come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(2).to_numpy(zero_copy_only=False) if by else np.zeros(batch.num_rows, np.int64)
            ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if batch.num_rows else []
            for start, stop in zip([0, *ends], ends, strict=False):
                for at in range(start, stop, size):
                    some = batch.slice(at, min(size, stop - at))
                    matrix = np.array(some.column(1).to_pylist(), np.float64)
                    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
                    keys = some.column(0).to_numpy()
                    yield pa.RecordBatch.from_pydict({"g": pa.array([int(group[at])], pa.int64()), "keys": [keys.astype("<i8").tobytes()], "vectors": [matrix.tobytes()]})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), *by).where("vector IS NOT NULL AND key IS NOT NULL").mapInArrow(run, "g long, keys binary, vectors binary")


def _best(k: int, key: str):
    """The ``k`` nearest of each pair of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qk, qv, ak, av in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own, keys = np.frombuffer(qk, "<i8"), np.frombuffer(ak, "<i8")
                similar = np.round(np.frombuffer(qv).reshape(len(own), -1) @ np.frombuffer(av).reshape(len(keys), -1).T, 9)
                similar[own[:, None] == keys[None, :]] = -2.0
                n = min(k, len(keys))
                # all that reach the k-th similarity, ties too: the last step picks among them by key
                least = -np.partition(-similar, n - 1, axis=1)[:, n - 1 : n]
                q, a = np.nonzero((similar >= least) & (similar > -2))
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(keys[a]), pa.array(similar[q, a])], names=["query", key, "similarity"])

    return run


def _top(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return found.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k).drop("__n")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = 1_000) -> DataFrame:
    """(query, key, similarity): the ``k`` nearest rows by cosine for each query, exactly.

    Both sides are packed, some hundred vectors a row, and each block of queries meets each block of vectors in some task, as one
    matrix product: nothing goes through the driver or to all executors, and a task holds two blocks. Only the best ``k`` of a pair of blocks
    are shuffled. Rows with a null key or vector are left out.
    """
    q = _packed(queries, key, vector, block).select(F.col("keys").alias("qk"), F.col("vectors").alias("qv"))
    a = _packed(vectors, key, vector, block).select("keys", "vectors")
    met = q.repartition(vectors.sparkSession.sparkContext.defaultParallelism).hint("shuffle_replicate_nl").join(a)
    return _top(met.mapInArrow(_best(k, key), f"query long, {key} long, similarity double"), k, key)


class VectorLists:
    """An index for approximate search: every row is in the lists of its ``spill`` nearest centres.

    Centres are fitted by k-means on at most ``sample`` rows, chosen by a hash of the key; all rows are assigned. A query looks into the
    ``probes`` lists whose centres are nearest. A list with more than ``block`` rows is several blocks, each searched by a task of its
    own, so a crowded list is split.
    """

    def __init__(self, vectors: DataFrame, lists: int = 64, spill: int = 2, sample: int = 20_000, key: str = "vec_id", vector: str = "embedding", seed: int = 5):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.key, self.vector = key, vector
        whole = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        unit = F.transform(F.col(vector), lambda x: x / F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v)), F.lit(1e-300)))
        drawn = whole.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample).select(array_to_vector(unit).alias("features"))
        centres = np.array(KMeans(k=lists, seed=seed, maxIter=15).fit(drawn).clusterCenters())
        # bounded: a row for each list
        self.centres = vectors.sparkSession.sparkContext.broadcast(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300))
        self.rows = cut(self._near(whole, spill).repartition("list").sortWithinPartitions("list"))

    def _near(self, rows: DataFrame, n: int) -> DataFrame:
        """Each row once for each of its ``n`` nearest centres."""
        centres, kind = self.centres, rows.schema[self.vector].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    matrix = np.array(batch.column(1).to_pylist(), np.float64)
                    closest = np.argsort(-(matrix @ centres.value.T), axis=1, kind="stable")[:, :n]
                    again = pa.array(np.repeat(np.arange(batch.num_rows), closest.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns), pa.array(closest.ravel(), pa.int64())], names=[self_key, self_vector, "list"])

        self_key, self_vector = self.key, self.vector
        return rows.select(F.col(self.key).cast("long").alias(self.key), self.vector).mapInArrow(run, f"{self.key} long, {self.vector} {kind}, list long")

    def nearest(self, queries: DataFrame, k: int = 10, probes: int = 8, block: int = 1_000) -> DataFrame:
        """(query, key, similarity) of the ``k`` nearest rows in the lists looked into."""
        asked = self._near(queries.where(F.col(self.key).isNotNull() & F.col(self.vector).isNotNull()), probes).repartition("list").sortWithinPartitions("list")
        q = _packed(asked, self.key, self.vector, block, "list").select(F.col("keys").alias("qk"), F.col("vectors").alias("qv"), "g")
        a = _packed(self.rows, self.key, self.vector, block, "list").select("keys", "vectors", "g")
        met = q.join(a, "g").select("qk", "qv", "keys", "vectors").repartition(queries.sparkSession.sparkContext.defaultParallelism)
        found = met.mapInArrow(_best(k, self.key), f"query long, {self.key} long, similarity double")
        return _top(found.groupBy("query", self.key).agg(F.max("similarity").alias("similarity")), k, self.key)


def recall(exact: DataFrame, found: DataFrame, key: str = "vec_id") -> float:
    """The share of the exact neighbours that were found."""
    total = exact.count()
    return exact.join(found, ["query", key], "left_semi").count() / total if total else 1.0
