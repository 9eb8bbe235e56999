"""Substring dedup: words in windows that an earlier document has too are removed, after a count-min prefilter.

First pass: a window is stood for by the least hash of the runs of ``GRAM`` words in it, which equal windows share and
neighbouring windows mostly do too. Each batch of some megabytes counts the documents of each such hash in a sketch of two rows
of cells, sent as the cells that aren't zero; the sketches are merged segment by segment, and what goes on is one bit
a cell: whether two documents or more may share it. A cell counts too many, never too few, so no repeated window is lost.

Second pass: only windows whose two cells are set are grouped, by two hashes of all their words (96 bits, each from a word
hash of its own, so that two words that collide in one don't in the other). Texts that differ are taken for equal with a probability of
2^-96 a pair of windows: below one in a thousand for all pairs of 10^13 windows. Within a batch
a window is kept for its smallest doc_id alone, the batch's other documents having lost it already, so a passage that
many documents share is one row a batch. A window over such rows gives the smallest doc_id of each, and the
documents that aren't it lose their words. Passages that many documents share (a third line of bits, from ``MANY`` on) are no group of one
task: a reading of the texts for them alone, one row a batch, is written, their smallest doc_ids come from partial minima and are joined back,
a join that AQE splits.

The sketch has four cells for each hash expected, up to ``MOST_CELLS``; with more data than that it lets more windows
through to the exact pass, and is still right.

Defined cases: a null or empty text has no words and nothing removed (the hash of nothing); a text of fewer than
``WINDOW`` words keeps them all; rows with equal doc_id don't remove each other's words; a null doc_id counts as larger than any
other and removes nothing; repeated rows have one id, so they keep what no smaller id has; very long texts are read whole, in a batch of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.llm.common import column, cut, map_batches

WINDOW = 50
GRAM = 10
SEGMENT = 1 << 20
MOST_CELLS = 1 << 30
#: Documents from which on a passage is one of many.
MANY = 250
NO_ID = (1 << 63) - 1
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def _rolling(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A polynomial hash of every run of ``size``, mixed; the run's start doesn't matter."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, n), dtype=np.uint64)]
    inverse = pow(base, -1, 1 << 64)
    return _mixed((sums[size:] - sums[:-size]) * _powers(inverse, n - size + 1))


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """The minimum of every run of ``size``, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Batch:
    """The words of a batch's documents one after another, and the windows that lie within one document."""

    def __init__(self, ids: list, texts: list):
        # a document's words are held as hashes only
        self.texts = texts
        hashes = [np.fromiter(map(xxhash.xxh64_intdigest, (t or b"").split()), np.uint64) for t in texts]
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        lengths = np.array([len(d) for d in hashes], np.int64)
        self.first = np.r_[0, np.cumsum(lengths)]
        inner = np.maximum(lengths - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(hashes)), inner)
        self.at = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)  # the window's start within its document
        self.place = self.at + self.first[self.doc]

    def second(self, docs: np.ndarray) -> np.ndarray:
        """Other hashes of the words of some documents, at their places; zeros elsewhere."""
        out = np.zeros(len(self.hashes), np.uint64)
        for d in docs.tolist():
            out[self.first[d] : self.first[d + 1]] = np.fromiter((xxhash.xxh3_64_intdigest(w, 7) for w in self.texts[d].split()), np.uint64)
        return out

    def anchors(self) -> np.ndarray:
        """For each window the least hash of its runs of ``GRAM`` words, mixed again."""
        if not len(self.place):
            return np.zeros(0, np.uint64)
        return _mixed(_least(_rolling(self.hashes, GRAM, _B1), WINDOW - GRAM + 1)[self.place], 3)


def _cells(anchor: np.ndarray, width: int) -> list[np.ndarray]:
    """The two cells of each anchor; ``width`` is a power of two."""
    return [(anchor & np.uint64(width - 1)).astype(np.int64), ((anchor >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)]


SKETCH = pa.schema([("line", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary()), ("n", pa.binary())])


def _sketched(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        windows = Batch(column(batch, "doc_id"), column(batch, "text"))
        anchor = windows.anchors()
        if not len(anchor):
            return None
        owner = windows.ids[windows.doc]
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
        anchor, owner = anchor[fresh], owner[fresh]
        order = np.lexsort((owner, anchor))
        anchor, owner = anchor[order], owner[order]
        anchor = anchor[np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]]  # one for each document
        rows = []
        for line, cell in enumerate(_cells(anchor, width)):
            cell, n = np.unique(cell, return_counts=True)
            segment = cell // SEGMENT
            for s in np.unique(segment).tolist():
                mine = segment == s
                inside, count = (cell[mine] % SEGMENT).astype(np.uint32), n[mine]
                rows.append({"line": line, "segment": s, "cells": inside.tobytes(), "n": np.minimum(count, MANY).astype(np.uint8).tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=SKETCH)

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One segment's cells, summed over the batches' sketches: which are shared, and which by many."""
    count = np.zeros(SEGMENT, np.uint16)
    for cells, n in zip(frame["cells"], frame["n"], strict=True):
        cells = np.frombuffer(cells, np.uint32)
        count[cells] = np.minimum(count[cells] + np.frombuffer(n, np.uint8), MANY)
    shared, many = (np.packbits(count >= least, bitorder="little").tobytes() for least in (2, MANY))
    return pd.DataFrame({"line": frame["line"].iloc[:1], "segment": frame["segment"].iloc[:1], "bits": [shared], "many": [many]})


def cells_for(docs: DataFrame) -> int:
    """Four cells for each anchor expected of the corpus, a power of two between bounds."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    expected = chars / 6 * 2 / (WINDOW - GRAM + 2)
    width = SEGMENT
    while width < 4 * expected and width < MOST_CELLS:
        width *= 2
    return width


def sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Three lines of bits, packed: the cells of either kind that two documents or more may share, and those of the first that many may. Its size is bounded."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    counted = map_batches(rows, _sketched(width), "line int, segment int, cells binary, n binary", split="text")

    bits = np.zeros((3, width // 8), np.uint8)
    for row in counted.groupBy("line", "segment").applyInPandas(_merged, "line int, segment int, bits binary, many binary").toLocalIterator():
        at = row["segment"] * SEGMENT // 8
        bits[row["line"], at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
        if row["line"] == 0:
            bits[2, at : at + SEGMENT // 8] = np.frombuffer(row["many"], np.uint8)
    return bits


def _set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


#: A window or a range: two hashes of all its words (96 bits), where it is, and in one number its start and, of lost
#: ranges, its end. Few and narrow columns: these are the rows that the shuffle carries.
FOUND = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("owner", pa.int64()), ("tag", pa.int64()), ("span", pa.int64())])


def _candidates(shipped, width: int, many: bool):
    """Windows that may repeat: those of the batch's smallest doc_id to be compared, of passages of ``many`` or of the others; with the latter, as ranges, those of other documents, which are lost already."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        windows = Batch(column(batch, "doc_id"), column(batch, "text"))
        anchor, bits = windows.anchors(), shipped.value
        maybe = np.flatnonzero(np.logical_and.reduce([_set(bits[k], c) for k, c in enumerate(_cells(anchor, width))])) if len(anchor) else anchor
        if many and len(maybe):
            maybe = maybe[_set(bits[2], _cells(anchor[maybe], width)[0])]
        if not len(maybe):
            return None
        place, doc = windows.place[maybe], windows.doc[maybe]
        h1, h2 = (_rolling(h, WINDOW, b)[place] for h, b in ((windows.hashes, _B1), (windows.second(np.unique(doc)), _B2)))
        owner, tag = windows.ids[doc], np.array(column(batch, "tag"), np.int64)[doc]
        order = np.lexsort((owner, h2, h1))
        group = np.cumsum(np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]) - 1
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.empty(len(maybe), np.int64)
        least[order] = owner[order][first][group]
        lost = owner > least
        ask = np.flatnonzero(~lost & (_set(bits[2], _cells(anchor[maybe], width)[0]) == many))
        start = windows.at[maybe]
        gone = np.flatnonzero(lost) if not many else np.zeros(0, np.int64)
        # windows of one document that follow each other closely lose one range
        split = np.r_[True, (doc[gone][1:] != doc[gone][:-1]) | (start[gone][1:] > start[gone][:-1] + WINDOW)] if len(gone) else np.zeros(0, bool)
        begin = gone[split]
        end = gone[np.r_[split[1:], True]] if len(gone) else gone
        spread = _mixed((begin + 1).astype(np.uint64) ^ tag[begin].view(np.uint64), 9).view(np.int64)
        columns = (
            np.r_[h1[ask].view(np.int64), spread],
            np.r_[h2[ask].view(np.int64), spread].astype(np.int32),
            np.r_[owner[ask], owner[begin]],
            np.r_[tag[ask], tag[begin]],
            np.r_[start[ask] << 32, (start[begin] << 32) + start[end] + WINDOW],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    return run


def removed(docs: DataFrame) -> DataFrame:
    """(owner, tag, ranges) of every document that loses words: where, as an array of (start, stop)."""
    spark = docs.sparkSession
    width = cells_for(docs)
    shipped = spark.sparkContext.broadcast(sketch(docs, width))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("tag"))
    read = lambda many: map_batches(rows, _candidates(shipped, width, many), "h1 long, h2 int, owner long, tag long, span long", split="text")
    start, stop = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    least = F.min(F.when(stop == 0, F.col("owner"))).over(W.partitionBy("h1", "h2"))
    lost = read(False).withColumn("least", least).where((stop > 0) | (F.col("owner") > F.col("least"))).select("owner", "tag", "span")
    if bool(shipped.value[2].any()):
        shared = cut(read(True))
        first = shared.groupBy("h1", "h2").agg(F.min("owner").alias("least"))
        lost = lost.union(shared.join(first, ["h1", "h2"]).where(F.col("owner") > F.col("least")).select("owner", "tag", "span"))
    ends = F.when(stop > 0, stop).otherwise(start + WINDOW)
    return lost.groupBy("owner", "tag").agg(F.collect_list(F.struct(start.alias("start"), ends.alias("stop"))).alias("ranges"))


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _kept(text: bytes | None, ranges: list | None) -> tuple[list[bytes], int]:
    words = (text or b"").split()
    if not ranges:
        return words, 0
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, [r["start"] for r in ranges], 1)
    np.add.at(change, [r["stop"] for r in ranges], -1)
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], int((~keep).sum())


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for doc_id, text, ranges in zip(column(batch, "doc_id"), column(batch, "text"), column(batch, "ranges"), strict=True):
        words, n = _kept(text, ranges)
        out.append((doc_id, len(words) + n, n, hashlib.sha256(b" ".join(words)).hexdigest()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id and text (binary) of every row, with the ranges of words to remove (null: none)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("o"), F.xxhash64("text").alias("t"))
    lost = removed(docs)
    both = rows.join(lost, (F.col("o") == F.col("owner")) & (F.col("t") == F.col("tag")), "left")
    return both.select("doc_id", F.col("text").cast("binary").alias("text"), "ranges")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    return map_batches(marked(docs), _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", split="text")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id and the kept text of every row of ``docs``."""

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [b" ".join(_kept(t, r)[0]).decode() for t, r in zip(column(batch, "text"), column(batch, "ranges"), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["doc_id", "text"])

    return map_batches(marked(docs), texts, "doc_id long, text string", split="text")
