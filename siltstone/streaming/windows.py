"""Structured Streaming over an event table: event-time windows, late data, deduplication, joins and per-key state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.sources.shared import new_folder


def events(spark: SparkSession, path: str, time: str = "ts", late: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files below ``path``, with event time and a watermark.

    Files that are there already come in one batch unless ``files_per_trigger`` is given: none of their rows is late then.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    # a table may be one file or a folder of files
    rows = stream.option("recursiveFileLookup", True).parquet(f"{folder}/{name}*")
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(rows: DataFrame, size: str, keys: list[str], time: str = "ts", slide: str | None = None) -> DataFrame:
    """Rows and summed values of each window and key."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")).select(F.col("w.start").alias("start"), *keys, "n", "s")


def sessions(rows: DataFrame, gap: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """Rows of each session: events of a key with less than ``gap`` between them."""
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first of equal events within the watermark."""
    return rows.dropDuplicatesWithinWatermark(keys)


def enriched(rows: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """A stream beside a static table."""
    return rows.join(static, on, "left")


def matched(left: DataFrame, right: DataFrame, key: str, within: str) -> DataFrame:
    """Pairs of two streams (columns ts and key on both sides) where the right comes at most ``within`` later; both watermarks bound the state."""
    a, b = left.alias("a"), right.alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near)


def running_totals(rows: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, n, total) after each batch that has rows of the key, from state that is two numbers a key."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [round(total, 4)]})

    return rows.select(key, value).groupBy(key).applyInPandasWithState(update, f"{key} long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def settle(stream: DataFrame, mode: str = "append", merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what there is now and return what it wrote, as a table in the session's shared folder.

    Each batch is written under its own number, so a batch that runs twice replaces itself. In complete mode the last
    batch counts; ``merge`` makes one table of the batches of update mode, which have a column ``batch``.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{folder}/table").parquet(f"{folder}/table")
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")
    return merge(rows) if merge else rows.drop("batch")
