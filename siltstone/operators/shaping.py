"""Reshaping and profiling of any frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(df: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each column: name, type, min, max (as text), nulls, rows and distinct values, from one aggregate.

    Distinct values are estimated by sketches, which partial aggregates merge; ``exact`` repeats each row for every column instead.
    """
    distinct, parts = (F.count_distinct if exact else F.approx_count_distinct), []
    for name, kind in df.dtypes:
        parts += [F.min(name).cast("string").alias(f"{name}|lo"), F.max(name).cast("string").alias(f"{name}|hi"), F.count(name).alias(f"{name}|n"), distinct(name).alias(f"{name}|d")]
    one = df.agg(F.count("*").alias("|rows"), *parts)
    rows = [
        F.struct(
            F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"), F.col(f"`{name}|lo`").alias("min"), F.col(f"`{name}|hi`").alias("max"),
            (F.col("`|rows`") - F.col(f"`{name}|n`")).alias("nulls"), F.col("`|rows`").alias("row_count"), F.col(f"`{name}|d`").alias("distinct_count"),
        )
        for name, kind in df.dtypes
    ]
    return one.select(F.inline(F.array(*rows)))


def pivot_values(df: DataFrame, by: list[str], on: str, value: str, most: int = 1_000) -> DataFrame:
    """Sums of ``value`` in a column for each value of ``on``, which are looked up first; more than ``most`` is an error."""
    found = sorted(r[0] for r in df.select(on).where(F.col(on).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{on} has more than {most} values")
    return df.groupBy(*by).pivot(on, found).agg(F.sum(value))


def copy_text(df: DataFrame, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """Rows as lines of text: fields between delimiters, nulls marked, special characters escaped with a backslash."""

    def field(name: str):
        text = F.col(name).cast("string")
        for plain, escaped in (("\\", "\\\\"), (delimiter, "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.coalesce(text, F.lit(null))

    return df.select(F.concat_ws(delimiter, *map(field, df.columns)).alias("line"))
