"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

The documents are dealt out by ranges of their key and sorted; each task encodes its texts and writes them to shard files
as it goes, so a shard holds neighbouring documents and shards follow each other. A shard file is

    "TOKSHRD1" | payload: ids, little-endian, 2 bytes each if the vocabulary allows, else 4
    | arrays of the index and of the records | JSON: lengths of the arrays and levels | length of the JSON (8 bytes) | "TOKSHRD1"

The index is a minimal perfect hash over the shard's keys: levels of bit arrays, each key at the first level where no
other one falls on its bit, the number of bits before it being its slot. A slot has a fingerprint of the key, so that keys
that aren't there are told (the stored key settles it), the key's first record and how many follow each other; records have their offset.
Keyed access reads one word at each level (two on average), the slot, the key, the offsets and the ids, however many documents there are.

Files are written under a name of the attempt's own, and only the names that tasks return are read: a lost or
repeated task leaves a file that nothing refers to.

Defined cases: a null or empty text is the end id alone; equal keys follow each other (ordered by a hash of the text)
and keyed access returns all of them; null keys come last, are in the files and can't be asked for; an empty table makes no
shard; very long texts are encoded whole, by one task; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress, count
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import arrow_store, cut, local_rows, parts, shared_uri

MAGIC = b"TOKSHRD1"
END_ID = 2
SHARD_BYTES = 64 << 20
CACHED_PIECES = 300_000
GROUP = 64


class Encoder:
    """Ids of whole texts, as the tokenizer gives them.

    Byte-level pre-tokenizers always cut before a single space between two characters that aren't white space, before
    a full stop or comma after an ASCII letter at a piece's end, and on both sides of a single line feed between two that
    aren't white space. So the pieces between single spaces are encoded on their own and kept, in two generations of bounded size;
    a text with other white space beside a space, or with the string of an added token (one id then), is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.splits = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and self.tokenizer.normalizer is None
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # by the piece without the space before it; what has none, after a line feed or letters, is under a space and itself
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.type.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that don't begin or end with white space, but for one space before them.

        Short texts cost more to hand over than to encode, so pieces go in groups, a line each: a line feed is always one token of its own there.
        """
        lone = self.tokenizer.encode("\n", add_special_tokens=False).ids
        groups = [pieces[i : i + GROUP] for i in range(0, len(pieces), GROUP)]
        if len(lone) != 1:
            return self._plain(pieces)
        out: list[bytes] = []
        for group, ids in zip(groups, self._plain(["\n".join(g) for g in groups]), strict=True):
            feeds = np.flatnonzero(np.frombuffer(ids, self.type) == lone[0])
            assert len(feeds) == len(group) - 1, "a line feed isn't a token of its own"
            size = self.type.itemsize
            start = [0, *((feeds + 1) * size).tolist()]
            out += [ids[a:b] for a, b in zip(start, [*(feeds * size).tolist(), len(ids)], strict=True)]
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of all pieces that don't begin or end with white space in ``known``."""
        if len(self.known) > CACHED_PIECES:
            self.known, self.old = {}, self.known
        known, old, new, made = self.known, self.old, set(), []
        for piece in pieces:
            if (ids := old.get(piece)) is not None:
                known[piece] = ids
                continue
            if not piece or piece[0] in _SPACES or piece[-1] in _SPACES:
                continue
            if (piece[-1] in ".," or "\n" in piece) and len(parts := _parts(piece)) > 1:
                made.append((piece, parts))
                new.update(parts)
            else:
                new.add(piece)
        fresh, rest = [], []
        for part in new.difference(known):
            if (ids := old.get(part)) is not None:
                known[part] = ids
            else:
                (rest if "\n" in part else fresh).append(part)
        known.update(zip(fresh, self._many([p[1:] if p[0] == " " else " " + p for p in fresh]), strict=True))
        if rest:
            known.update(zip(rest, self._plain([p[1:] if p[0] == " " else " " + p for p in rest]), strict=True))
        for piece, parts in made:
            known[piece] = b"".join([known[p] for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.splits:
            return self._plain([t or "" for t in texts])
        get, rows, missing = self.known.get, [], set()
        marked = {i for a in self.added for i, text in enumerate(texts) if text and a in text}
        for i, text in enumerate(texts):
            if i in marked:
                rows.append((text, "", [], [], []))
                continue
            pieces = (text or "").split(" ")
            first = pieces.pop(0)
            ids = list(map(get, pieces))
            at = list(compress(count(), map(not_, ids)))
            new = [pieces[k] for k in at]
            missing.update(new)
            rows.append((text or "", first, ids, at, new))
        self._learn(missing)
        get, heads, tails = self.known.get, [], []
        for text, first, ids, at, new in rows:
            for k, piece in zip(at, new, strict=True):
                ids[k] = get(piece)
            # white space beside a space: the text is encoded whole
            apart = ids and first and first[-1] not in _SPACES and None not in map(ids.__getitem__, at)
            heads.append(first if apart else text)
            tails.append(b"".join(ids) if apart else b"")
        return [head + tail for head, tail in zip(self._plain(heads), tails, strict=True)]


_LETTERS = frozenset(string.ascii_letters)
_SPACES = frozenset(c for c in map(chr, range(0x110000)) if c.isspace())


def _parts(piece: str) -> list[str]:
    """The keys of the parts of a piece that can be encoded apart: lines, and a stop or comma after letters."""
    if "\n" not in piece:
        return [piece[:-1], " " + piece[-1]] if len(piece) > 1 and piece[-1] in ".," and piece[-2] in _LETTERS else [piece]
    lines, out = piece.split("\n"), []
    if any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
        return [piece]
    for i, line in enumerate(lines):
        mark = " " if i else ""
        if i:
            out.append(" \n")
        if len(line) > 1 and line[-1] in ".," and line[-2] in _LETTERS:
            out += [mark + line[:-1], " " + line[-1]]
        else:
            out.append(mark + line)
    return out

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys (splitmix64's finaliser)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WORD = np.dtype([("bits", "<u8"), ("before", "<i8")])


@dataclass
class PerfectHash:
    """Words of 64 bits of all levels, each with the number of bits set before it, and the bits of each level."""

    words: np.ndarray
    sizes: list[int]

    @classmethod
    def build(cls, keys: np.ndarray, load: float = 2.0) -> PerfectHash:
        found, sizes, left, level = [np.zeros(0, np.uint64)], [], keys.astype(np.int64), 0
        while len(left):
            size = -(-int(load * len(left) + 1) // 64) * 64
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            found.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left, level = left[~alone[at]], level + 1
        words = np.zeros(sum(map(len, found)), WORD)
        words["bits"] = np.concatenate(found)
        set_bits = np.bitwise_count(words["bits"]).astype(np.int64)
        words["before"] = np.cumsum(set_bits) - set_bits
        return cls(words, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots in 0 to n-1, -1 for a key that falls on no bit."""
        return _slots(keys, self.sizes, self.words.__getitem__)


def _slots(keys: np.ndarray, sizes: list[int], words: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Slots of keys, level by level; ``words`` gives the index's words at some places."""
    out, base = np.full(len(keys), -1, np.int64), 0
    open_keys = np.arange(len(keys))
    for level, size in enumerate(sizes):
        if not len(open_keys):
            break
        at = (_mixed(keys[open_keys], level) % np.uint64(size)).astype(np.int64) + base
        word, bit = words(at >> 6), (at & 63).astype(np.uint64)
        here = (word["bits"] >> bit) & np.uint64(1) == 1
        below = np.bitwise_count(word["bits"][here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
        out[open_keys[here]] = word["before"][here] + below
        open_keys = open_keys[~here]
        base += size
    return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("run", "<u4")])
ARRAYS = {"words": WORD, "slots": SLOT, "keys": np.dtype("<i8"), "offsets": np.dtype("<i8")}


class ShardWriter:
    """One shard file; documents come in the order of their keys, null ones last."""

    def __init__(self, folder: str, name: str, width: int):
        store, path = arrow_store(folder)
        store.create_dir(path, recursive=True)
        self.file, self.name, self.width = store.open_output_stream(f"{path}/{name}"), name, width
        self.file.write(MAGIC)
        self.keys: list[int] = []
        self.counts: list[int] = []
        self.nulls = 0

    @property
    def ids(self) -> int:
        return sum(self.counts)

    def add(self, key: int | None, payload: bytes) -> None:
        self.file.write(payload)
        self.counts.append(len(payload) // self.width)
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)

    def close(self) -> dict:
        """Write the index; what the manifest has of the shard."""
        keys = np.array(self.keys, np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        index = PerfectHash.build(keys[first])
        at, slots = index.slots(keys[first]), np.zeros(len(first), SLOT)
        for name, values in (("print", _prints(keys[first])), ("first", first), ("run", np.diff(np.r_[first, len(keys)]))):
            slots[name][at] = values
        offsets = np.r_[0, np.cumsum(self.counts)].astype(np.int64)
        arrays = {"words": index.words, "slots": slots, "keys": keys, "offsets": offsets}
        note = {"width": self.width, "nulls": self.nulls, "levels": index.sizes, "arrays": [len(arrays[k]) for k in ARRAYS]}
        for value in arrays.values():
            self.file.write(value.tobytes())
        raw = json.dumps(note).encode()
        self.file.write(raw + len(raw).to_bytes(8, "little") + MAGIC)
        self.file.close()
        return {"file": self.name, "first_key": self.keys[0] if self.keys else None, "last_key": self.keys[-1] if self.keys else None, "n_docs": len(self.counts), "n_ids": int(offsets[-1])}


class Shard:
    """A shard file that is open for reading."""

    def __init__(self, folder: str, name: str):
        store, path = arrow_store(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        assert tail[8:] == MAGIC, f"{name} is not a whole shard"
        length = int.from_bytes(tail[:8], "little")
        note = json.loads(self.file.read_at(length, size - 16 - length))
        self.type, self.nulls, self.levels = np.dtype(f"<u{note['width']}"), note["nulls"], note["levels"]
        self.length = dict(zip(ARRAYS, note["arrays"], strict=True))
        self.start, at = {}, size - 16 - length
        for name in reversed(ARRAYS):
            at -= ARRAYS[name].itemsize * self.length[name]
            self.start[name] = at

    def part(self, name: str, at: int = 0, n: int | None = None) -> np.ndarray:
        """Some entries of one of the file's arrays, or all; only these are read."""
        width = ARRAYS[name].itemsize
        n = self.length[name] - at if n is None else n
        return np.frombuffer(self.file.read_at(width * n, self.start[name] + width * at), ARRAYS[name])

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key; what is read doesn't grow with the shard."""
        wanted = np.array([key], np.int64)
        slot = int(_slots(wanted, self.levels, lambda at: self.part("words", int(at[0]), 1))[0])
        if slot < 0:
            return []
        found = self.part("slots", slot, 1)[0]
        first, run = int(found["first"]), int(found["run"])
        if found["print"] != _prints(wanted)[0] or self.part("keys", first, 1)[0] != key:
            return []
        offsets = self.part("offsets", first, run + 1).tolist()
        return [self.ids(a, b) for a, b in zip(offsets, offsets[1:], strict=False)]

    def ids(self, a: int, b: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((b - a) * self.type.itemsize, len(MAGIC) + a * self.type.itemsize), self.type)

    def records(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, offset and ids of all documents, each key's through the index; those of null keys come last."""
        keys, offsets = self.part("keys"), self.part("offsets")
        slots, words = self.part("slots"), self.part("words")
        different = np.unique(keys)
        found = slots[_slots(different, self.levels, words.__getitem__)]
        for key, first, run in zip(different.tolist(), found["first"].tolist(), found["run"].tolist(), strict=True):
            for i in range(first, first + run):
                yield key, int(offsets[i]), self.ids(int(offsets[i]), int(offsets[i + 1]))
        for i in range(len(keys), len(offsets) - 1):
            yield None, int(offsets[i]), self.ids(int(offsets[i]), int(offsets[i + 1]))


MANIFEST = "part int, seq int, file string, first_key long, last_key long, n_docs long, n_ids long"


@dataclass
class Store:
    """A folder of shards and their manifest, a row for each."""

    folder: str
    manifest: DataFrame

    def get(self, key: int) -> list[np.ndarray]:
        """Keyed access from the driver: the shards whose range has the key, then their indexes."""
        rows = self.manifest.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "seq").collect()
        return [ids for r in rows for ids in Shard(self.folder, r["file"]).get(key)]


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, batch: int = 250) -> Store:
    """Encode the texts of ``docs`` and write shards in ascending order of doc_id to a folder of their own in the shared one."""
    spark = docs.sparkSession
    folder = f"{shared_uri(spark)}/tokens-{uuid.uuid4().hex}"
    arrow_store(folder)  # a store that tasks can't write to is told here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, seq, shard, done = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None, []
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.type).tobytes()
        size = 0

        def close() -> None:
            nonlocal shard, seq, size
            if shard is not None:
                done.append({"part": part, "seq": seq} | shard.close())
                shard, seq, size = None, seq + 1, 0

        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                for key, payload in zip(some.column(0).to_pylist(), encode.encode(some.column(1).to_pylist()), strict=True):
                    if shard is None:
                        shard = ShardWriter(folder, f"{part:06d}-{seq:05d}-{own}.shard", encode.type.itemsize)
                    shard.add(key, payload + end)
                    size += len(payload)
                    if size >= shard_bytes:
                        close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    # equal ids are told apart by text, equal rows by where they come from
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("m")]
    dealt = keyed.repartitionByRange(max(1, parts(spark)), *order).sortWithinPartitions(*order)
    return Store(folder, cut(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST)))


def read(store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as the shard files have them, found through their indexes."""
    spark = store.manifest.sparkSession
    before, bases = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in store.manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # a row for each partition
        bases.append((part, before))
        before += n
    base = F.broadcast(local_rows(spark, bases, p=pa.int32(), base=pa.int64()))
    from pyspark.sql import Window

    earlier = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = store.manifest.withColumn("earlier", earlier).join(base, F.col("part") == F.col("p")).select("file", (F.col("base") + F.col("earlier")).alias("start"))
    folder = store.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [(key, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, at, ids in Shard(folder, name).records()]
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(parts(spark), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
