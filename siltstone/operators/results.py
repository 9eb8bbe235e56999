"""Results that are fetched bit by bit, as they were when asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltstone.sources.shared import cut


class Snapshot:
    """The rows of a frame, fixed now, in its order, fetched in pages of any size.

    The rows are written once and numbered by partition, of which a count each is gathered; a page is a filter on the numbers, so
    rows that are passed over never leave the executors.
    """

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        rows = cut(df).select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
        rows = rows.select("row", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
        self.rows, self.starts, self.count = rows, {}, 0
        for part, n in sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect()):  # a row for each partition
            self.starts[part] = (self.count, n)
            self.count += n
        self.position = 0

    def fetch(self, n: int = 1) -> list[Row]:
        """The next ``n`` rows, fewer at the end and none after it."""
        low, high = self.position, min(self.position + n, self.count)
        wanted = F.lit(False)
        for part, (start, size) in self.starts.items():
            if start < high and start + size > low:
                wanted |= (F.col("part") == part) & F.col("nth").between(max(low - start, 0), high - start - 1)
        self.position = high
        return self.rows.where(wanted).orderBy("part", "nth").select("row.*").collect() if low < high else []

    def skip(self, n: int) -> int:
        """Pass over up to ``n`` rows; how many there were."""
        passed = min(n, self.count - self.position)
        self.position += passed
        return passed
