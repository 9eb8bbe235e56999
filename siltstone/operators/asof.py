"""As-of join: each left row with the latest right row of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: dict[str, str], bucket_seconds: int = 86_400, tolerance: str | None = None) -> DataFrame:
    """``left`` with the columns ``take`` {right column: new name} of the last right row with ``right_time <= left_time``.

    Rows are dealt out by key and time bucket, so that a key with very many rows is many tasks. Within a bucket both sides
    are merged by a window; what a bucket starts with is the last right row of the buckets before it, which is found from one row
    for each key and bucket. Ties in the right time go to the largest of ``take``. Left rows without a match, key or time get nulls.
    """
    keys = [F.col(k) for k in by]
    time_bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / bucket_seconds)
    payload = F.struct(F.col(right_time).alias("__at"), *(F.col(c).alias(n) for c, n in take.items()))
    r = right.dropna(subset=[*by, right_time]).select(*keys, F.col(right_time).alias("__t"), payload.alias("__r")).withColumn("__b", time_bucket(F.col("__t")))
    rows = left.select("*", F.col(left_time).alias("__t")).withColumn("__b", time_bucket(F.col("__t")))
    # the last right row of each bucket, and of all buckets before each that has left rows
    closing = r.groupBy(*by, "__b").agg(F.max("__r").alias("__c"))
    wanted = rows.select(*by, "__b").distinct().withColumn("__c", F.lit(None).cast(closing.schema["__c"].dataType))
    both = closing.withColumn("__left", F.lit(False)).unionByName(wanted.withColumn("__left", F.lit(True)))
    # the bucket's own closing row is later than some of its left rows, so only earlier buckets count
    strict = Window.partitionBy(*by).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    opening = both.withColumn("__o", F.max(F.when(~F.col("__left"), F.struct("__b", "__c"))).over(strict)["__c"]).where("__left").select(*by, "__b", "__o")
    start = opening.where(F.col("__o").isNotNull()).select(*by, "__b", F.lit(None).cast(left.schema[left_time].dataType).alias("__t"), F.col("__o").alias("__r"), F.lit(0).alias("__side"))
    mid = r.select(*by, "__b", "__t", "__r", F.lit(1).alias("__side"))
    empty = F.lit(None).cast(mid.schema["__r"].dataType)
    asked = rows.select(*by, "__b", "__t", empty.alias("__r"), F.lit(2).alias("__side"), F.struct(*(F.col(c) for c in left.columns)).alias("__l"))
    none = F.lit(None).cast(left.schema)
    merged = asked.unionByName(mid.withColumn("__l", none)).unionByName(start.withColumn("__l", none))
    upto = Window.partitionBy(*by, "__b").orderBy(F.col("__t").asc_nulls_first(), "__side", "__r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("__m", F.last("__r", ignorenulls=True).over(upto)).where("__side = 2")
    if tolerance:
        found = found.withColumn("__m", F.when(F.col("__m")["__at"] >= F.col("__t") - F.expr(f"INTERVAL {tolerance}"), F.col("__m")))
    return found.select("__l.*", *(F.col("__m")[n].alias(n) for n in take.values()))
