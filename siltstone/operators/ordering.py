"""Row numbers over a whole table, and what needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.shared import cut


def numbered(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """``df`` with its rows numbered from 1 in ``order``, which should be total.

    The rows are dealt out by ranges and written so, as another run might draw other ranges; each partition numbers its
    own and starts after the ones before it, of which only the counts (a row for each partition) are gathered.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy("__part").orderBy(*order)
    rows = rows.withColumn("__own", F.row_number().over(own))
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return rows.join(F.broadcast(counts.withColumn("__before", earlier)), "__part").withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__part", "__own", "__n", "__before")


def positional_join(a: DataFrame, b: DataFrame, a_order: list[Column], b_order: list[Column]) -> DataFrame:
    """The i-th row of ``a`` beside the i-th of ``b``; the longer side's rest stands alone."""
    return numbered(a, a_order, "__i").join(numbered(b, b_order, "__i"), "__i", "full").drop("__i")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps ``k`` for each task and group before it shuffles."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """A sample of ``share`` of the keys, the same one each time: all rows of a key or none."""
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
