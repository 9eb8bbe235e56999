"""SimHash near-duplicates: fingerprints, and the links between them by a self-join of a binary trie.

The 64 bits are read in three rotations; two fingerprints that differ in at most two bits share the first 21 bits
of one rotation at least. So in each rotation the trie's nodes of depth 21 are joined with themselves only, and
below them pairs of nodes are walked together, four bits at a time: the differing bits add up and a pair of nodes
is dropped as soon as they exceed the budget. A node with more than ``max_node`` fingerprints is not given to one
task: its pairs of child nodes become groups of their own, again and again until they are small. Each task returns
a star for each set of linked fingerprints it sees; alternating large and small stars join the sets of all tasks.
Equal fingerprints are one trie leaf, so copies are never paired. Rows get their component by a join on the fingerprint, of which
one may be that of very many rows (all empty texts, a third of the corpus); AQE splits that partition, as the other side has one row of it.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other;
repeated rows are returned as often as they come; the component of a row is the smallest doc_id other than null
that it reaches (null where there is none); very long texts are read whole; an empty table gives an empty result; extra columns, of any
name, are ignored (in ``keep_one`` kept).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siltstone.llm.common import cut, fresh, parts

BUDGET = 2
EXACT = 21
ROTATIONS = (0, 21, 42)
STEP = 4
SLICE = 500_000
#: Pairs of nodes that a task looks at at once.
PAIRS = 2_000_000
#: Rows of one node that are paired at once.
BLOCK = 256
#: Edges of a partition while components are joined.
EDGES = 4_000
NO_ID = -(1 << 63)


def simhash(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of a whole text as a signed 64-bit integer."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    if len(words) < shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), seed)).astype(np.int64))
    set_bits, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.int64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint(text: Column) -> Column:
    """A column of fingerprints (signed) of whole texts."""
    return _fingerprints(text.cast("binary"))


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


_POP = np.array([bin(i).count("1") for i in range(1 << STEP)], np.int8)


def _codes(value: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def rotated(fps: DataFrame) -> DataFrame:
    """Each fingerprint once a rotation: (path, err, side, depth, r, fp); path names a pair of trie nodes, here one with itself."""
    turns = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("fp") if not k else F.shiftleft("fp", k).bitwiseOR(F.shiftrightunsigned("fp", 64 - k))).alias("r")) for k in ROTATIONS))
    rows = fps.select("fp", F.explode(turns).alias("t"))
    path = F.concat_ws(":", F.col("t.k").cast("string"), F.hex(F.shiftrightunsigned("t.r", 64 - EXACT)))
    return rows.select(path.alias("path"), F.lit(0).alias("err"), F.lit(0).alias("side"), F.col("t.r").alias("r"), "fp")


def deepen(rows: DataFrame, depth: int, stop: int = 64) -> DataFrame:
    """Give each row of large node pairs to the pairs of children it can have links in: those within the bits left.

    From depth ``stop`` on, children are paired with themselves only.
    """
    bits = min(STEP, 64 - depth if depth >= stop else stop - depth)
    code = _codes(F.col("r"), 64 - depth - bits, bits)
    masks = {e: [m for m in range(1 << bits) if bin(m).count("1") <= (BUDGET - e if depth < stop else 0)] for e in range(BUDGET + 1)}
    mask = F.when(F.col("err") == 0, F.array(*map(F.lit, masks[0]))).when(F.col("err") == 1, F.array(*map(F.lit, masks[1]))).otherwise(F.array(*map(F.lit, masks[2])))
    rows = rows.select("*", code.alias("c"), F.explode(mask).alias("m")).withColumn("o", F.col("c").bitwiseXOR(F.col("m")))
    same = F.col("side") == 0  # 0: a node with itself; 1 and 2: the two nodes of a pair
    left = F.when(same, F.least("c", "o")).when(F.col("side") == 1, F.col("c")).otherwise(F.col("o"))
    right = F.when(same, F.greatest("c", "o")).when(F.col("side") == 1, F.col("o")).otherwise(F.col("c"))
    side = F.when(same & (F.col("m") == 0), 0).when(same, F.when(F.col("c") < F.col("o"), 1).otherwise(2)).otherwise(F.col("side"))
    path = F.concat_ws(":", "path", F.hex(left), F.hex(right))
    kept = [c for c in rows.columns if c not in ("path", "err", "side", "c", "m", "o")]
    return rows.select(path.alias("path"), (F.col("err") + F.bit_count("m")).cast("int").alias("err"), side.cast("int").alias("side"), *kept)


def _walk(group: np.ndarray, side: np.ndarray, err: np.ndarray, r: np.ndarray, depth: int, stop: int = 64, joined: Callable | None = None, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of linked rows, in arrays of bounded size; rows come sorted by group, side and r (unsigned).

    The trie ends at depth ``stop``; below it all rows of a pair of nodes are paired, by blocks of ``BLOCK``. ``joined`` tells for a level and
    pairs of its nodes (their first rows) which pairs have nothing more to say.
    """
    n = len(r)
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    alone = side[first] == 0
    twin = np.flatnonzero(~alone[:-1] & ~alone[1:] & (group[first][:-1] == group[first][1:]))
    a = np.concatenate([np.flatnonzero(alone), twin])
    b = np.concatenate([np.flatnonzero(alone), twin + 1])
    # the trie, level by level: rows of each node, its last letter, its children
    levels, starts = [], first
    while True:
        node = np.cumsum(np.bincount(starts, minlength=n)) - 1
        size = np.diff(np.r_[starts, n])
        bits = min(STEP, stop - depth)
        if bits <= 0:
            if stop < 64:
                blocks = np.flatnonzero((np.arange(n) - starts[node]) % BLOCK == 0)
                levels.append((size, np.zeros(len(blocks), np.int8), np.searchsorted(blocks, np.r_[starts, n]), starts))
                levels.append((np.diff(np.r_[blocks, n]), np.zeros(n, np.int8), np.r_[blocks, n], blocks))
            levels.append((size if stop == 64 else np.ones(n, np.int64), None, None, starts if stop == 64 else np.arange(n)))
            break
        code = ((r >> np.uint64(64 - depth - bits)) & np.uint64((1 << bits) - 1)).astype(np.int8)
        below = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (code[1:] != code[:-1])])
        levels.append((size, code[below], np.searchsorted(node[below], np.arange(len(starts) + 1)), starts))
        starts, depth = below, depth + bits
    # pairs of nodes, deepest first, a bounded number at a time
    open_pairs = [(0, a, b, err[first][a].astype(np.int8))]
    while open_pairs:
        level, a, b, e = open_pairs.pop()
        size, letter, start, rows = levels[level]
        live = (a != b) | (size[a] > 1)
        if joined is not None:
            live &= ~joined(level, rows, a, b)
        a, b, e = a[live], b[live], e[live]
        if letter is None:
            yield rows[a], rows[b]
            continue
        count = np.diff(start)
        total = count[a] * count[b]
        if len(a) > 1 and total.sum() > most:
            half = len(a) // 2
            open_pairs += [(level, a[half:], b[half:], e[half:]), (level, a[:half], b[:half], e[:half])]
            continue
        at = np.repeat(np.arange(len(a)), total)
        within = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        ca, cb = start[a[at]] + within // count[b[at]], start[b[at]] + within % count[b[at]]
        ce = e[at] + _POP[letter[ca] ^ letter[cb]]
        keep = (ce <= BUDGET) & ((a[at] != b[at]) | (ca <= cb))
        if keep.any():
            open_pairs.append((level + 1, ca[keep], cb[keep], ce[keep]))


def _stars(links: Iterator[tuple[np.ndarray, np.ndarray]], fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Each linked fingerprint but the smallest of its set, and that smallest one."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = top[up]
            x = top[x]
        return x

    for left, right in links:
        for x, y in zip(fp[left].tolist(), fp[right].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                top[max(x, y)] = min(x, y)
    return list(zip(*((x, r) for x in top if (r := find(x)) != x), strict=True)) or ([], [])


LINKS = "u long, v long"


def _links(depth: int, chunk: int):
    """Walks all whole groups of about ``chunk`` rows at once; a partition's rows come sorted."""

    def whole(path: np.ndarray, side: np.ndarray, err: np.ndarray, r: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, path[1:] != path[:-1]])
        order = np.lexsort((r.view(np.uint64), side, group))  # signed order is the wrong one for a trie
        u, v = _stars(_walk(group[order], side[order], err[order], r.view(np.uint64)[order], depth), fp[order])
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((np.array(batch.column(0).to_pylist(), dtype=object), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))))
            rows += batch.num_rows
            if rows >= chunk:
                path, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                stop = int(np.flatnonzero(path != path[-1])[-1]) + 1 if path[0] != path[-1] else 0
                if stop:
                    yield whole(path[:stop], *(x[:stop] for x in rest))
                held, rows = [(path[stop:], *(x[stop:] for x in rest))], len(path) - stop
        if rows:
            yield whole(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(fps: DataFrame, max_node: int = 16_384, chunk: int = 50_000) -> DataFrame:
    """Stars (u, v) that join all fingerprints of ``fps`` (distinct, column fp) with a chain of links of at most two bits."""
    spark = fps.sparkSession
    rows, depth, found = rotated(fps), EXACT, None
    while True:
        big = None
        if depth < 64:
            big = cut(rows.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > max_node).select("path"))
            big = None if big.isEmpty() else big
        leaves = rows if big is None else rows.join(big, "path", "left_anti")
        dealt = leaves.select("path", "side", "err", "r", "fp").repartition(parts(spark), "path").sortWithinPartitions("path")
        linked = dealt.mapInArrow(_links(depth, chunk), LINKS)
        found = linked if found is None else found.union(linked)
        if big is None:
            return found
        rows = cut(deepen(rows.join(big, "path", "left_semi"), depth))
        depth += min(STEP, 64 - depth)


def connect(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) of every node but the roots: connected components by alternating large and small stars.

    Each round regroups the edges by node with partial aggregates, so a node with very many edges is no row of its own. Few edges are
    kept in few partitions, of about ``EDGES`` each: what a round costs besides is its tasks.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, total) == before:
            break
        before, few = (n, total), -(-n // EDGES)
        both = edges.coalesce(few).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u <> v").distinct().coalesce(few))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select("u", F.col("v").alias("root"))


def components(docs: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """doc_id (with ``extra`` columns), fp, root (the component's smallest fingerprint) and component_id of every row of ``docs``."""
    rows = cut(docs.select("doc_id", *(extra or []), fingerprint(docs["text"]).alias("fp")))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = connect(links(fps.select("fp")))
    rooted = fps.join(linked, fps["fp"] == linked["u"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    of_root = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = rooted.join(of_root, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp", "left")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame, list[Column]], DataFrame] = components) -> DataFrame:
    """The rows of ``docs`` less all but one of each component that ``grouped`` gives: that of the smallest doc_id.

    Of rows that share the id, one stays; of a component whose ids are all null, one row stays.
    """
    # rows that share an id are told apart by their text; keys that are never null let the last step keep the join's partitions
    i, t, least, its = fresh(docs, "__i", "__t", "__id", "__a")
    keys = {i: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), t: F.xxhash64("text")}
    rows = grouped(docs, [keys[t].alias("t")])
    chosen = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("t").alias(its))
    chosen = chosen.select(F.coalesce("component_id", F.lit(NO_ID)).alias(least), its)
    kept = docs.withColumns(keys).join(chosen, (F.col(i) == F.col(least)) & (F.col(t) == F.col(its)), "left_semi")
    return kept.dropDuplicates([i, t]).select(*docs.columns)
