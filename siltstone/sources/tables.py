"""Parquet tables of a data directory, as frames and as temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; any path scheme that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, text: str | None = None) -> None:
    """(Re)create temporary views, so that SQL can name the tables: those that ``text`` mentions, or all."""
    for name in TABLES:
        if text is None or re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
