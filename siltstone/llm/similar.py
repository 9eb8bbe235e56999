"""Near-duplicates by SimHash: texts that share 80 % of their five-word shingles, and chains of them.

A text is its set of shingle hashes (64 bits; words as in simhash); equal sets are one node. A node has a fingerprint of
``LANES`` x 64 bits, in each of which sets of similarity 0.8 differ in 15 % of the bits. The binary trie of
simhash is joined with itself once for each part of the fingerprint: in each of ``SEGMENTS`` runs of 24 bits, pairs
of nodes that differ in at most two bits are walked together from one of the run's three bytes, which is equal then; pairs
that differ in more than ``MOST_BITS`` of all bits are dropped. In a first pass pairs within a set that is joined already are left out, so a
dense set gives about as many pairs as it has members. Every pair that is left is compared exactly, on the whole
shingle sets. The first run goes first, alone: what it joins is not paired again in the others. Where a pair that joined sets
fails the comparison, it may have hidden others: a second pass over all nodes of pairs gives every pair between sets that compared pairs have not joined,
and these are compared too. So no pair that a run shows is lost, unless compared pairs chain its ends.

Two texts of similarity 0.8 are paired by some run with a probability of 0.96, of 0.9 with 0.9996 (``recall``), and are within all bits
allowed with 0.99 and more. Groups that are too large for a task are split by the trie down to the run's end, and then by pairs of blocks.

Defined cases: a null text counts as empty; texts without words are one set; texts of fewer words than a shingle are one
shingle; components and null ids as in simhash; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from siltstone.llm.common import column, cut, parts
from siltstone.llm.simhash import BUDGET, _walk, connect, deepen

SHINGLE = 5
SIMILARITY = 0.8
LANES = 4
SEGMENTS, BYTES = 10, 3
#: 15 % of the bits and 2.3 standard deviations.
MOST_BITS = 52
SLICE = 200_000
#: Pairs that a task looks at at once.
MOST_PAIRS = 300_000
#: Pairs of numbers that are broadcast at most.
MOST_BROADCAST = 1_000_000
#: Nodes of a block whose pairs are compared together, and keys of one node's pairs.
BLOCK, PARTS = 256, 64
NAMES = [f"s{i}" for i in range(LANES)]


def recall(similarity: float) -> float:
    """The probability that a pair of nodes of this similarity is found in some run, by the normal share of differing bits."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = 8 * BYTES
    return 1 - (1 - sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(BUDGET + 1))) ** SEGMENTS


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different shingle hashes of a whole text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64))


def signature(hashes: np.ndarray) -> list[int]:
    """The fingerprint of a set, as signed numbers; a tie is broken by the smallest hash."""
    found = []
    for lane in range(LANES):
        set_bits = np.zeros(64, np.int64)
        for at in range(0, len(hashes), SLICE):
            x = hashes[at : at + SLICE] + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_bits += 2 * bits.sum(axis=0, dtype=np.int64)
            if not at:
                set_bits += bits[0]
        found.append(int(np.packbits(set_bits > len(hashes), bitorder="little").view(np.int64)[0]))
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared shingles by all shingles of two sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


@F.pandas_udf(StructType([StructField("node", LongType()), StructField("some", BooleanType()), *(StructField(n, LongType()) for n in NAMES)]))
def _nodes(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        s = shingles(text)
        rows.append((int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).astype(np.int64)), len(s) > 0, *(signature(s) if len(s) else [0] * LANES)))
    return pd.DataFrame(rows, columns=["node", "some", *NAMES])


def _bits(at: int, n: int) -> Column:
    """``n`` bits of the fingerprint from bit ``at`` on, which may go over its end, as a number."""
    value = F.lit(0).cast("long")
    while n:
        lane, inside = at // 64 % LANES, at % 64
        take = min(n, 64 - inside)
        part = F.shiftrightunsigned(F.shiftleft(NAMES[lane], inside), 64 - take) if take < 64 else F.col(NAMES[lane])
        value = part if n == take == 64 else F.shiftleft(value, take).bitwiseOR(part)
        at, n = at + take, n - take
    return value


def _turned(nodes: DataFrame, segments: range) -> DataFrame:
    """Each node once for each byte of each run: the byte names a trie node, joined with itself; r has the run's other bytes and what follows."""
    turns = []
    for k in segments:
        for j in range(BYTES):
            start = 8 * BYTES * k
            others = [_bits(start + 8 * ((j + i) % BYTES), 8) for i in range(1, BYTES)]
            r = _bits(start + 8 * BYTES, 64 - 8 * len(others))
            for i, other in enumerate(others):
                r = F.shiftleft(other, 56 - 8 * i).bitwiseOR(r)
            turns.append(F.struct(F.concat_ws(":", F.lit(str(k)), F.lit(str(j)), F.hex(_bits(start + 8 * j, 8))).alias("path"), r.alias("r")))
    rows = nodes.select("node", "label", *NAMES, F.explode(F.array(*turns)).alias("t"))
    return rows.select("t.path", F.lit(0).alias("err"), F.lit(0).alias("side"), "t.r", "node", "label", *NAMES)


class Joined:
    """Sets of rows that are joined already. What a walk finds between different sets becomes a pair; unless ``every`` pair is
    wanted, it joins them for the rest of the walk, before it is compared."""

    def __init__(self, label: np.ndarray, node: np.ndarray, words: np.ndarray, every: bool = False):
        self.label = np.unique(label, return_inverse=True)[1].reshape(-1)
        self.node, self.words, self.every, self.bounds = node, words, every, {}

    def known(self, level: int, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if level not in self.bounds:
            self.bounds[level] = (np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts))
        low, high = self.bounds[level]
        return (low[a] == high[b]) & (low[b] == high[a]) & (low[a] == low[b])

    def take(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, of few bits first, that join sets: at most one less than there are sets; or every pair between different sets."""
        differ = np.zeros(len(a), np.int16)
        for lane in range(LANES):
            differ += np.bitwise_count(self.words[a, lane] ^ self.words[b, lane])
        order = np.argsort(differ, kind="stable")
        order = order[: np.searchsorted(differ[order], MOST_BITS, "right")]
        a, b, chosen = a[order], b[order], []
        if self.every:
            apart = self.label[a] != self.label[b]
            u, v = self.node[a[apart]], self.node[b[apart]]
            return np.maximum(u, v), np.minimum(u, v)
        while True:
            apart = np.flatnonzero(self.label[a] != self.label[b])
            if not len(apart):
                break
            a, b = a[apart], b[apart]
            x, y = self.label[a], self.label[b]
            # each set's first pair; the sets that these join get the least label of them
            first = np.unique(np.r_[np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1]])
            top: dict[int, int] = {}

            def find(v: int, top: dict = top) -> int:
                while (up := top.setdefault(v, v)) != v:
                    top[v] = top[up]
                    v = top[v]
                return v

            for i, u, v in zip(first.tolist(), x[first].tolist(), y[first].tolist(), strict=True):
                if (u := find(u)) != (v := find(v)):
                    top[max(u, v)] = min(u, v)
                    chosen.append((a[i], b[i]))
            new = np.arange(int(self.label.max()) + 1)
            for v in top:
                new[v] = find(v)
            self.label, self.bounds = new[self.label], {}
        u, v = (self.node[np.array(z, np.int64)] for z in (zip(*chosen, strict=True) if chosen else ([], [])))
        return np.maximum(u, v), np.minimum(u, v)


def _paired(depth: int, stop: int, chunk: int, every: bool):
    """Walks all whole groups of about ``chunk`` rows at once; a partition's rows come sorted by path."""

    def whole(path: np.ndarray, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        side, err, r, node, label, *words = rows
        group = np.cumsum(np.r_[0, path[1:] != path[:-1]])
        order = np.lexsort((r.view(np.uint64), side, group))
        # sets are those of one group: a chain through another group isn't seen by this one's pairs
        joined = Joined(_numbers(group[order], label[order]), node[order], np.stack([w[order] for w in words], axis=1).view(np.uint64), every)
        for a, b in _walk(group[order], side[order], err[order], r.view(np.uint64)[order], depth, stop, joined.known, MOST_PAIRS):
            u, v = joined.take(a, b)
            if len(u) and every:  # a row for each u
                order = np.argsort(u, kind="stable")
                u, starts = np.unique(u[order], return_index=True)
                ends = pa.array(np.r_[starts, len(order)], pa.int32())
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "vs": pa.ListArray.from_arrays(ends, pa.array(v[order], pa.int64()))})
            elif len(u):
                yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((np.array(batch.column(0).to_pylist(), dtype=object), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns))))
            n += batch.num_rows
            if n >= chunk:
                path, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.flatnonzero(path != path[-1])[-1]) + 1 if path[0] != path[-1] else 0
                if end:
                    yield from whole(path[:end], [x[:end] for x in rest])
                held, n = [(path[end:], *(x[end:] for x in rest))], len(path) - end
        if n:
            path, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from whole(path, rest)

    return run


def _numbers(group: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A number for each label of each group."""
    order = np.lexsort((label, group))
    fresh = np.r_[True, (group[order][1:] != group[order][:-1]) | (label[order][1:] != label[order][:-1])]
    out = np.empty(len(group), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _blocked(rows: DataFrame, max_node: int) -> DataFrame:
    """The rows of large groups below which the trie has no more to tell, dealt out by blocks: each pair of blocks is a group of its own.

    The group's most frequent label has blocks of its own, which are not paired with each other.
    """
    sizes = rows.groupBy("path", "label").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    some = lambda n: F.ceil(2 * n / max_node)
    sizes = sizes.select("path", F.col("top.label").alias("most"), some(F.col("n") - F.col("top.n")).cast("int").alias("others"), some(F.col("top.n")).cast("int").alias("its"))
    rows, top = rows.join(sizes, "path"), F.col("label") == F.col("most")
    own = F.when(top, F.col("others") + F.pmod(F.xxhash64("node"), "its")).otherwise(F.pmod(F.xxhash64("node"), "others")).cast("int")
    blocks = F.filter(F.sequence(F.lit(0), F.col("others") + F.col("its") - 1), lambda o: ~top | (o < F.col("others")))
    rows = rows.select("*", own.alias("c"), F.explode(blocks).alias("o"))
    same = F.col("side") == 0
    left = F.when(same, F.least("c", "o")).when(F.col("side") == 1, F.col("c")).otherwise(F.col("o"))
    right = F.when(same, F.greatest("c", "o")).when(F.col("side") == 1, F.col("o")).otherwise(F.col("c"))
    side = F.when(~same, F.col("side")).when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2)
    return rows.select(F.concat_ws(":", "path", left, right).alias("path"), "err", side.cast("int").alias("side"), "r", "node", "label", *NAMES)


def pairs(nodes: DataFrame, segments: range, max_node: int = 16_384, chunk: int = 50_000, every: bool = False) -> DataFrame:
    """(u, v) of ``nodes`` (node, label, fingerprint) of different labels that are few bits apart: as many as join their sets, or ``every`` one, as (u, vs)."""
    rows, depth, stop, found, last = _turned(nodes, segments), 0, 8 * (BYTES - 1), None, False
    while True:
        big = None
        if not last:
            big = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > max_node).select("path"))
            big = None if big.isEmpty() else big
        leaves = rows if big is None else rows.join(big, "path", "left_anti")
        dealt = leaves.select("path", "side", "err", "r", "node", "label", *NAMES).repartition(parts(nodes.sparkSession), "path").sortWithinPartitions("path")
        paired = dealt.mapInArrow(_paired(depth, stop, chunk, every), "u long, vs array<long>" if every else "u long, v long")
        found = paired if found is None else found.union(paired)
        if big is None:
            return cut(found.groupBy("u").agg(F.array_distinct(F.flatten(F.collect_list("vs"))).alias("vs")) if every else found.distinct())
        rows, last = rows.join(big, "path", "left_semi"), depth == stop
        rows = cut(_blocked(rows, max_node) if last else deepen(rows, depth, stop))
        depth = min(stop, depth + 4)


def _compare(at_least: float):
    """Pairs whose sets reach the similarity; of each key the texts (u, text) come before the pairs (u, vs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, {}  # of one key, whose texts are few
        for batch in batches:
            key, u, vs = (column(batch, name) for name in ("key", "u", "vs"))
            texts, found = batch.column(3), []
            for at, k in enumerate(key):
                if k != last:
                    last, sets = k, {}
                if vs[at] is None:
                    sets[u[at]] = shingles(texts[at].as_py())
                else:
                    found += [(u[at], v) for v in vs[at] if similarity(sets[u[at]], sets[v]) >= at_least]
            if found:
                yield pa.RecordBatch.from_pydict({n: pa.array(x, pa.int64()) for n, x in zip("uv", zip(*found, strict=True), strict=True)})

    return run


def blocked_pairs(found: DataFrame, families: DataFrame) -> DataFrame:
    """(key, u, vs) of ``found`` (u, vs), whose pairs lie within ``families`` (u, root), a key for each pair of blocks of a family's nodes that has some."""
    of = families.select(F.explode(F.array("u", "root")).alias("node"), "root").distinct()
    of = of.join(of.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "root")
    rows = found.join(of, F.col("u") == F.col("node"))
    block = lambda node: F.pmod(F.xxhash64(node), "blocks")
    rows = rows.select("*", block(F.col("u")).alias("i"), F.explode(F.array_distinct(F.transform("vs", block))).alias("j"))
    key = F.concat_ws(":", "root", F.least("i", "j"), F.greatest("i", "j"))
    return cut(rows.select(key.alias("key"), "u", F.filter("vs", lambda v: block(v) == F.col("j")).alias("vs")))


def alike(found: DataFrame, nodes: DataFrame, texts: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) of ``found`` (key, u, vs) whose texts reach the similarity; only texts of nodes in a pair are shuffled, once for each key."""
    of_key = found.groupBy("key").agg(F.array_distinct(F.concat(F.collect_list("u"), F.flatten(F.collect_list("vs")))).alias("nodes"))
    ends = cut(of_key.select("key", F.explode("nodes").alias("node")))
    need = cut(ends.select("node").distinct().join(nodes.select("node", "x"), "node"))
    needed = texts.join(F.broadcast(need) if need.count() <= MOST_BROADCAST else need, "x")
    needed = needed.groupBy("node").agg(F.first("text").alias("text"))
    rows = ends.join(needed, "node").select("key", F.col("node").alias("u"), F.lit(None).cast("array<long>").alias("vs"), "text")
    rows = rows.union(found.select("key", "u", "vs", F.lit(None).cast("binary").alias("text")))
    dealt = rows.repartition(parts(nodes.sparkSession), "key").sortWithinPartitions("key", F.col("vs").isNotNull())
    return cut(dealt.mapInArrow(_compare(at_least), "u long, v long"))


def linked(nodes: DataFrame, texts: DataFrame, at_least: float = SIMILARITY) -> DataFrame:
    """(u, root) of every node of ``nodes`` (node, x, some, fingerprint) but the roots of the components; ``texts`` (x, text) has their texts."""
    filled = nodes.where("some")
    labelled = filled.withColumn("label", F.col("node"))
    seen, links, roots = None, None, None
    for segments in (range(1), range(1, SEGMENTS)):
        found = pairs(labelled, segments)
        keys = F.concat_ws(":", "u", F.pmod("v", F.lit(PARTS)))  # a node of very many pairs is several keys
        same = alike(found.select(keys.alias("key"), "u", F.array("v").alias("vs")), nodes, texts, at_least)
        seen, links = (found, same) if links is None else (seen.union(found), links.union(same))
        # stars of what is joined already stand for its links
        roots = connect(same if roots is None else roots.union(same).toDF("u", "v"))
        labelled = filled.join(roots, F.col("node") == F.col("u"), "left").withColumn("label", F.coalesce("root", "node")).drop("u", "root")
    if seen.count() == links.count():
        return roots
    # a pair that failed may have hidden others between its sets: both ends of these are in some pair
    ends = cut(seen.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    rest = pairs(cut(labelled.join(ends, "node", "left_semi")), range(SEGMENTS), every=True)
    return roots if rest.isEmpty() else connect(roots.union(alike(blocked_pairs(rest, connect(seen)), nodes, texts, at_least)).toDF("u", "v"))


def components(docs: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """doc_id (with ``extra`` columns), node, root (the component's smallest node) and component_id of every row of ``docs``."""
    rows = cut(docs.select("doc_id", *(extra or []), F.xxhash64("text").alias("x"), _nodes(docs["text"].cast("binary")).alias("s")))
    rows = rows.select("*", F.col("s.node").alias("node"))
    firsts = [F.first(f"s.{n}").alias(n) for n in ("some", *NAMES)]
    nodes = cut(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("x").alias("x"), *firsts))
    of = linked(nodes, docs.select(F.xxhash64("text").alias("x"), F.col("text").cast("binary").alias("text")))
    rooted = cut(nodes.select("node", "rep").join(of, F.col("node") == F.col("u"), "left").select("node", "rep", F.coalesce("root", "node").alias("root")))
    of_root = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rows.drop("s", "x").join(rooted.join(of_root, "root").select("node", "root", "component_id"), "node", "left")
