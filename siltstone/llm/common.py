"""What several corpus operators need: tables, cut lineage, word patterns and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import arrow_store, cut, shared_dir, shared_uri  # noqa: F401

#: A word is a run of characters other than these, in the patterns of Java, RE2 and Python alike.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: The same characters as text, for translate().
SPACE_CHARS = " \t\n\x0b\f\r"


#: The folder that this package is imported from.
ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, whatever store the path is in."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # tasks import this package too
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in count() if (n := name + "_" * k).lower() not in taken) for name in names]


def local_rows(spark: SparkSession, rows: list[tuple], **kinds: pa.DataType) -> DataFrame:
    """A frame of a few rows of the driver's, through Arrow: a list given to createDataFrame goes through Python workers of a daemon of its own."""
    names = list(kinds)
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns, strict=True)], names=names))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batch: pa.RecordBatch, name: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in runs whose column ``name`` has at most ``most_bytes``, unless one row alone has more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, split: str | None = None, most_bytes: int = 16 << 20) -> DataFrame:
    """Rows of ``function`` over each Arrow batch of ``df``; batches are bounded in rows and bytes by Spark, and further by the text column ``split``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, split, most_bytes) if split else [batch]:
                if part.num_rows and (out := function(part)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    """The number of partitions that this session deals a shuffle out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
