"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share, by weight, of the mix, never above ``most`` times its size. Each of its documents is
taken target / size times in expectation: a whole number of copies for certain, and one more with the fractional
probability that is left. Pairs of such documents pass probability to each other, at random and so that both
expectations and the words taken stay as they are, until one of the two is 0 or 1. What is left of a bucket of documents, and one of each order of size, go
up a tree of buckets, ``FAN`` to one, until one document of a source is left: that one is drawn. Large documents come
first everywhere, so it is a small one as a rule, and the words taken are those of the target to within it.

Defined cases: a null text has size 0; a document of size 0 is never taken beyond the whole copies of its rate, which
are no words; a null source is a source, the last one; repeated rows are drawn one by one; an empty table gives an
empty mix; very long texts are documents like any, at most twice taken; extra columns, of any name, are ignored (in ``mix`` kept). Draws depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, cut, fresh, local_rows, parts

WEIGHTS = (5, 2, 1)
FAN = 32
BUCKET = 1_000
EPS = 1e-12


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the number of words of every row."""
    return docs.select(*keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their rank from 0 by code point, null last; sorted and counted by partition, never in one task."""
    spark = sources.sparkSession
    sources = sources.orderBy(F.col("source").asc_nulls_last())
    from siltstone.llm.common import shared_dir

    shared_dir(spark)
    sources = sources.checkpoint().withColumn("at", F.monotonically_increasing_id())  # keeps the partitions' order
    rows = sources.select("*", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    before, bases = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect()):  # a row for each partition
        bases.append((part, before))
        before += n
    base = local_rows(spark, bases, part=pa.int32(), base=pa.int64())
    return rows.join(F.broadcast(base), "part").select("source", "source_size", (F.col("base") + F.col("nth")).alias("rank"))


def targets(rows: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of every source: ``share`` of all words by weight, the excess of full sources reshared."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = ranked(sums).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    table = cut(table)
    whole, total = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level = fill_level(table, share * whole, most) if total else 0.0
    reached = F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", reached.alias("target"))


def fill_level(table: DataFrame, goal: float, most: int, width: int = 64) -> float:
    """The target per weight at which the targets, none above ``most`` times its source's size, sum up to ``goal``.

    A source is full from its own level on (``most`` times size by weight). Each job looks at ``width`` levels at once, so
    their number is bounded by the digits of a level, not by the number of sources.
    """
    room, weight, low, high = most * F.col("source_size"), F.col("weight"), -1.0, float("inf")
    own = room / weight
    while True:
        inside = (own > low) & (own < high)
        near, far, full, rest = table.agg(F.min(F.when(inside, own)), F.max(F.when(inside, own)), F.sum(F.when(own <= low, room).otherwise(0)), F.sum(F.when(own <= low, 0).otherwise(weight))).first()
        if near is None:
            return (goal - full) / rest if rest else max(low, 0.0)
        steps = sorted({near, far, *(near + (far - near) * k / width for k in range(1, width))})
        sums = table.agg(*(F.sum(F.least(room.cast("double"), weight * F.lit(x))) for x in steps)).first()
        low = max([low, *(x for x, n in zip(steps, sums, strict=True) if n < goal)])
        high = min([high, *(x for x, n in zip(steps, sums, strict=True) if n >= goal)])


def transfer(a: list, b: list, draw: random.Random) -> None:
    """Pass probability between two rows [probability, size, ...] until one of them is whole."""
    ratio = a[1] / b[1]
    up, down = min(1 - a[0], b[0] / ratio), min(a[0], (1 - b[0]) / ratio)
    if draw.random() * (up + down) < down:
        a[0], b[0] = a[0] + up, b[0] - up * ratio
    else:
        a[0], b[0] = a[0] - down, b[0] + down * ratio
    for x in (a, b):
        x[0] = 0.0 if x[0] < EPS else 1.0 if x[0] > 1 - EPS else x[0]


SCHEMA = "bucket long, source string, p double, size long, doc_id long, whole long, source_size long, target double, tag long"
ROW = pa.schema([("bucket", pa.int64()), ("source", pa.string()), ("p", pa.float64()), ("size", pa.int64()), ("doc_id", pa.int64()), ("whole", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("tag", pa.int64())])


def _rounded(level: int, last: bool, seed: int):
    """Pairs the rows of each (bucket, source), which come sorted, large ones first.

    A task holds one row and the last of each power of two of sizes, which go up the tree as they are: going down in size,
    they take up there what larger rows leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, draw, reserve = None, None, random.Random(), {}

        def put(row: tuple, out: list) -> None:
            x, bucket, source, rest = row
            out.append((bucket, source, x[0], x[1], *rest))

        def pair(row: tuple, out: list) -> None:
            nonlocal held
            if held is None:
                held = row
                return
            transfer(held[0], row[0], draw)
            both, held = (held, row), None
            for one in both:
                if 0 < one[0][0] < 1:
                    held = one
                else:
                    put(one, out)

        def close(out: list) -> None:
            nonlocal held
            for row in reserve.values():
                put(row, out)
            reserve.clear()
            if held is not None:
                if last:
                    held[0][0] = float(draw.random() < held[0][0])
                put(held, out)
            held = None

        for batch in batches:
            out: list[tuple] = []
            for bucket, source, p, size, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, source) != key:
                    close(out)
                    key = (bucket, source)
                    draw = random.Random(f"{seed}:{level}:{bucket}:{source}")
                if not 0 < p < 1 or not size:
                    out.append((bucket, source, float(p >= 1), size, *rest))
                    continue
                row = ([p, size], bucket, source, rest)
                if not last:
                    row, reserve[size.bit_length()] = reserve.get(size.bit_length()), row
                if row is not None:
                    pair(row, out)
            if out:
                yield _batch(out)
        close(rest := [])
        if rest:
            yield _batch(rest)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROW, strict=True)], schema=ROW)


def rounded(rows: DataFrame, goals: DataFrame, seed: int = 17, broadcast_rows: int = 10_000) -> DataFrame:
    """Rows (doc_id, source, size, tag) with source_size, target and the copies drawn."""
    spark = rows.sparkSession
    if goals.limit(broadcast_rows + 1).count() <= broadcast_rows:
        goals = F.broadcast(goals)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.select(F.col("source").alias("of"), "source_size", "target")
    rows = rows.join(goals, rows["source"].eqNullSafe(goals["of"])).withColumn("rate", rate)
    n = max(1, -(-rows.count() // BUCKET))
    rows = rows.select(
        F.pmod(F.xxhash64("doc_id", "tag", "size"), F.lit(n)).alias("bucket"), "source", (F.col("rate") - F.floor("rate")).alias("p"), "size", "doc_id", F.floor("rate").cast("long").alias("whole"), "source_size", "target", "tag"
    )
    keys, done, level = ["bucket"], None, 0
    while True:
        dealt = rows.repartition(parts(spark), *keys).sortWithinPartitions("bucket", "source", F.desc("size"), "doc_id", "tag")
        out = cut(dealt.mapInArrow(_rounded(level, n == 1, seed), SCHEMA))
        settled = out.where("p = 0 or p = 1")
        done = settled if done is None else done.union(settled)
        if n == 1:
            break
        n, level, keys = -(-n // FAN), level + 1, ["source", "bucket"]
        rows = out.where("p > 0 and p < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long")).select(*ROW.names)
    return done.withColumn("copies", F.col("whole") + F.col("p").cast("long"))


def plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, tag, size, source_size, target, copies and taken of every row of ``docs``; tag tells texts of one id apart."""
    tagged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text", F.xxhash64("text", "source", F.isnull("doc_id")).alias("tag"))
    rows = cut(sized(tagged, ["doc_id", "source", "tag"]))
    out = rounded(rows, targets(rows, **how))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    i, t, n, of, mark, copies = fresh(docs, "__i", "__t", "__n", "__id", "__tag", "__copies")
    drawn = plan(docs, **how).groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(of), F.col("tag").alias(mark)).agg(F.sum("copies").alias(copies))
    tag = F.xxhash64("text", F.col("source").cast("string"), F.isnull("doc_id"))
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), t: tag})
    found = keyed.join(drawn.where(F.col(copies) > 0), (F.col(i) == F.col(of)) & (F.col(t) == F.col(mark)))
    found = found.dropDuplicates([i, t])  # equal rows: their copies are summed
    return found.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
