"""Benchmark decontamination by suffix arrays of the training texts.

The benchmark's windows are hashed into a Bloom filter of bounded size, which every document is read against: only documents with a
window that may be the benchmark's go on. These are packed into shards of some megabytes. A shard's words become numbers
(words that no item has are all 0 and end a suffix, as the end of a document does) and its suffix array holds the places from
which at least the shortest window can be read, sorted by prefix doubling. Items come in blocks of bounded size, each of which
meets each shard in some task. The item suffixes whose first window the shard may have are searched in the array by
bisection: the range of equal windows, which are its places, and from each place on the longest verbatim match.

So nothing that grows with the benchmark or the corpus is in the driver or in one task: the filter has ``MOST_BITS`` bits at most (beyond some
ten million windows it lets more documents through, and all is still right), blocks and shards are packed by size.

Defined cases: a null or empty text has no words and no hits; an item without words has no window, and one with fewer than
``window`` words is a single window of all of them; items with equal windows are each counted; a null item_id is
left out of the list of ids but counts as an item; repeated rows are judged alike; a null doc_id is judged like any;
with an empty benchmark nothing is contaminated; an empty table gives an empty result; extra columns are ignored (in ``clean`` kept).
"""

from __future__ import annotations

import hashlib
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import column, cut, map_batches
from siltstone.llm.substrings import _B1, _mixed, _rolling

WINDOW = 10
SEGMENT = 1 << 20
MOST_BITS = 1 << 28
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
#: Rows (of two numbers) that are broadcast at most.
MOST_BROADCAST = 1_000_000
_KEPT = (string.ascii_letters + string.digits).encode()
_TABLE = bytes(ord(chr(c).lower()) if c in _KEPT else c if c > 0x7F else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of ASCII letters, digits and all other characters than ASCII ones, A-Z lower-cased."""
    return (text or b"").translate(_TABLE).split()


def _hashed(text: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, text), np.uint64, len(text))


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` words."""
    return _mixed(_rolling(hashes, size, _B1), size)


def _places(window: np.ndarray, width: int) -> list[np.ndarray]:
    """The two bits of each window in a filter of ``width`` bits, a power of two."""
    return [(window & np.uint64(width - 1)).astype(np.int64), ((window >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64)]


@dataclass
class Filter:
    """Bits of the benchmark's windows, and the sizes that windows have."""

    bits: np.ndarray
    sizes: list[int]

    def may_hold(self, text: list[bytes]) -> bool:
        """Whether a window of the text may be one of the benchmark's."""
        if not self.sizes or len(text) < self.sizes[0]:
            return False
        hashes = _hashed(text)
        for size in self.sizes:
            places = _places(_windows(hashes, size), len(self.bits) * 8)
            if np.logical_and(*((self.bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1 for p in places)).any():
                return True
        return False


def _set_bits(width: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in column(batch, "text"):
            if w := words(text):
                size = min(WINDOW, len(w))
                places = np.unique(np.concatenate(_places(_windows(_hashed(w), size), width)))
                for segment in np.unique(places // SEGMENT).tolist():
                    rows.append({"segment": segment, "size": size, "bits": (places[places // SEGMENT == segment] % SEGMENT).astype("<u4").tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("segment", pa.int32()), ("size", pa.int32()), ("bits", pa.binary())]))

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """One segment's bits."""
    found = np.zeros(SEGMENT, bool)
    for bits in frame["bits"]:
        found[np.frombuffer(bits, "<u4")] = True
    return pd.DataFrame({"segment": frame["segment"].iloc[:1], "sizes": [sorted(set(frame["size"].tolist()))], "bits": [np.packbits(found, bitorder="little").tobytes()]})


def window_filter(benchmark: DataFrame) -> Filter:
    """The filter of all items' windows: 32 bits a window expected, a power of two between bounds."""
    texts = benchmark.select(F.col("text").cast("binary").alias("text"))
    width, expected = SEGMENT, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 5
    while width < 32 * expected and width < MOST_BITS:
        width *= 2
    bits, sizes = np.zeros(width // 8, np.uint8), set()
    merged = map_batches(texts, _set_bits(width), "segment int, size int, bits binary").groupBy("segment").applyInPandas(_merged, "segment int, sizes array<int>, bits binary")
    for row in merged.toLocalIterator():  # bounded: MOST_BITS
        at = row["segment"] * SEGMENT // 8
        bits[at : at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
        sizes.update(row["sizes"])
    return Filter(bits, sorted(sizes))


@dataclass
class Items:
    """A block of the benchmark: ids and word numbers of its items, the number of each word, hashes of their windows."""

    ids: list
    tokens: list[list[int]]
    numbers: dict[bytes, int]
    windows: np.ndarray  # of all items, one after another
    owner: np.ndarray  # item of each window
    at: np.ndarray  # its place there

    @classmethod
    def of(cls, ids: list, texts: list[bytes | None]) -> Items:
        numbers: dict[bytes, int] = {}
        kept = [(i, w) for i, t in zip(ids, texts, strict=True) if (w := words(t))]
        tokens = [[numbers.setdefault(x, len(numbers) + 1) for x in w] for _, w in kept]
        found = [_windows(_hashed(w), min(WINDOW, len(w))) for _, w in kept]
        n = np.array([len(f) for f in found], np.int64)
        owner = np.repeat(np.arange(len(found)), n)
        return cls([i for i, _ in kept], tokens, numbers, np.concatenate([*found, np.zeros(0, np.uint64)]), owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

    @property
    def sizes(self) -> list[int]:
        return sorted({min(WINDOW, len(t)) for t in self.tokens})


def suffix_array(tokens: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` sorted by the ``depth`` tokens from each on, by prefix doubling."""
    rank, have = tokens.astype(np.int64), 1
    while have < depth and len(rank):
        after = np.zeros_like(rank)
        after[:-have] = rank[have:] + 1
        both = rank * (int(after.max()) + 1) + after
        rank = np.unique(both, return_inverse=True)[1].reshape(-1)
        have *= 2
    return places[np.argsort(rank[places], kind="stable")]


class Shard:
    """The suffix array of some documents, as far as a block's items can match it."""

    def __init__(self, docs: list[list[bytes]], items: Items):
        flat = [number for d in docs for number in (*map(items.numbers.get, d, (0,) * len(d)), 0)]
        tokens = np.array(flat, np.int64)
        # run: known words from here to the next unknown one or the end of the document
        ends = np.flatnonzero(tokens == 0)
        run = ends[np.searchsorted(ends, np.arange(len(flat)))] - np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
        self.text, self.run = flat, run
        self.array = suffix_array(tokens, np.flatnonzero(run >= items.sizes[0]), WINDOW).tolist() if items.tokens else []

    def places(self, start: list[int]) -> list[int]:
        """Places of all suffixes that begin with ``start``, of ``WINDOW`` words at most."""
        cut_off = len(start)
        low = bisect_left(self.array, start, key=lambda at: self.text[at : at + cut_off])
        return self.array[low : bisect_right(self.array, start, lo=low, key=lambda at: self.text[at : at + cut_off])]

    def longest(self, place: int, suffix: list[int]) -> int:
        """How many words from ``place`` on are the suffix's."""
        most = min(int(self.run[place]), len(suffix))
        here = self.text[place : place + most]
        if here == suffix[:most]:
            return most
        return next(i for i, (a, b) in enumerate(zip(here, suffix, strict=False)) if a != b)


def matches(docs: list[list[bytes]], items: Items) -> Iterator[tuple[int, int, list[tuple[int, int]], tuple[int, int, int]]]:
    """(document, item, ranges of the document's words, longest match as document place, item place and words)."""
    shard = Shard(docs, items)
    if not shard.array:
        return
    hashes = [_hashed(d) for d in docs]
    seen = np.unique(np.concatenate([_windows(h, size) for h in hashes for size in items.sizes]))
    first = np.cumsum([0, *(len(d) + 1 for d in docs)])
    found: dict[tuple[int, int], list] = {}
    for k in np.flatnonzero(np.isin(items.windows, seen)).tolist():
        n, at = int(items.owner[k]), int(items.at[k])
        item = items.tokens[n]
        width = min(WINDOW, len(item))
        for place in shard.places(item[at : at + width]):
            doc = int(np.searchsorted(first, place, "right")) - 1
            own = found.setdefault((doc, n), [[], (0, 0, 0)])
            start = place - int(first[doc])
            own[0].append((start, start + width))
            # a match that goes on from the word before was told there
            if own[1][2] == 0 or not (place and at and shard.text[place - 1] == item[at - 1]):
                length = shard.longest(place, item[at:])
                if length > own[1][2]:
                    own[1] = (start, at, length)
    for (doc, n), (ranges, best) in found.items():
        yield doc, n, _joined(ranges), best


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges."""
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _packed(rows: DataFrame, key: str, most_bytes: int) -> DataFrame:
    """(keys, texts): rows of (key, text) packed into arrays of about ``most_bytes`` of text, unless one alone has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0
        schema = None
        for batch in batches:
            schema = pa.schema([("keys", pa.list_(batch.column(0).type)), ("texts", pa.list_(pa.binary()))])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size and size + len(t or b"") > most_bytes:
                    yield pa.RecordBatch.from_pydict({"keys": [keys], "texts": [texts]}, schema=schema)
                    keys, texts, size = [], [], 0
                keys.append(k)
                texts.append(t)
                size += len(t or b"")
        if keys:
            yield pa.RecordBatch.from_pydict({"keys": [keys], "texts": [texts]}, schema=schema)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, f"keys array<{kind}>, texts array<binary>")


_BLOCKS: dict[tuple, Items] = {}


def _block(ids: list, texts: list) -> Items:
    """The block that this worker had last, or a new one."""
    key = (len(ids), hashlib.sha256(b"\x00".join(t or b"" for t in texts)).digest(), tuple(map(str, ids)))
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Items.of(ids, texts)
    return _BLOCKS[key]


def _met(kind: str):
    schema = {"row": pa.int64(), "item_id": None, "starts": pa.list_(pa.int32()), "stops": pa.list_(pa.int32()), "doc_at": pa.int64(), "item_at": pa.int64(), "length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.field(2).type.value_type
            for rows, texts, ids, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block, out = _block(ids, items), []
                for doc, n, ranges, best in matches([words(t) for t in texts], block):
                    out.append((rows[doc], block.ids[n], [a for a, _ in ranges], [b for _, b in ranges], *best))
                if out:
                    kinds = [of if k is None else k for k in schema.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(schema))

    return run, f"row long, item_id {kind}, starts array<int>, stops array<int>, doc_at long, item_at long, length long"


def read_against(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, mark, n_words, text) of every row of ``docs``; the text is there only where a window may be the benchmark's."""
    shipped = docs.sparkSession.sparkContext.broadcast(window_filter(benchmark))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, kept = [], []
        for text in column(batch, "text"):
            w = words(text)
            n.append(len(w))
            kept.append(text if shipped.value.may_hold(w) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "mark", "n_words", "text"])

    rows = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"), docs["text"].cast("binary").alias("text"))
    read = map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, n_words long, text binary", split="text", most_bytes=4 << 20)
    return cut(read).withColumn("row", F.monotonically_increasing_id())


def found(rows: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, item_id, ranges, longest match) of every pair of a row of ``read_against`` and an item of which it has a window."""
    # cut: packing and matching in one stage would be two Python workers a task, and these stay with the executor
    shards = cut(_packed(rows.where("text IS NOT NULL").select("row", "text"), "row", SHARD_BYTES)).withColumnsRenamed({"keys": "rows", "texts": "docs"})
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = cut(_packed(items.coalesce(-(-size // block_bytes) or 1), "item_id", block_bytes))
    few = blocks.count()
    # one block of bounded size goes to all tasks; more meet the shards pair by pair
    met = shards.crossJoin(F.broadcast(blocks)) if few == 1 else shards.hint("shuffle_replicate_nl").join(blocks)
    run, schema = _met(benchmark.schema["item_id"].dataType.simpleString())
    return met.mapInArrow(run, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_at and item_at (words before it) and length of the longest verbatim match of each document and item that share a window."""
    rows = read_against(docs, benchmark)
    return found(rows, benchmark).join(rows.select("row", "doc_id"), "row").select("doc_id", "item_id", "doc_at", "item_at", "length")


def _summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for row, hits in zip(column(batch, "row"), column(batch, "hits"), strict=True):
        ranges = _joined([r for h in hits for r in zip(h["starts"], h["stops"], strict=True)])
        listed = ",".join(sorted(str(h["item_id"]) for h in hits if h["item_id"] is not None))
        out.append((row, sum(b - a for a, b in ranges), len(hits), hashlib.sha256(listed.encode()).hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["row", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    rows = read_against(docs, benchmark)
    hits = found(rows, benchmark, block_bytes).groupBy("row").agg(F.collect_list(F.struct("item_id", "starts", "stops")).alias("hits"))  # a row's own items
    summed = cut(map_batches(hits, _summed, "row long, n_hit long, n_items long, items_sha256 string"))
    # few rows as a rule: then the others needn't be shuffled
    summed = F.broadcast(summed) if summed.count() <= MOST_BROADCAST else summed
    none, n = hashlib.sha256(b"").hexdigest(), F.coalesce("n_hit", F.lit(0))
    return rows.select("row", "doc_id", "n_words").join(summed, "row", "left").select(
        "doc_id", "n_words", n.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (n > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window."""
    rows = read_against(docs, benchmark)
    bad = cut(found(rows, benchmark).select("row").distinct().join(rows.select("row", F.col("doc_id").alias("__of"), F.col("mark").alias("__mark")), "row").select("__of", "__mark").distinct())
    bad = F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad
    # equal texts of one id are equal rows to this stage
    same = docs["doc_id"].eqNullSafe(bad["__of"]) & (F.xxhash64(docs["text"]) == bad["__mark"])
    return docs.join(bad, same, "left_anti")
