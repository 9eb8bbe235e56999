"""The corpus pipeline: documents through five stages, each over all that the one before kept.

Every stage but the last returns the columns of documents; each is written as Parquet to the shared folder and read
again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, mixing, simhash, similar, tokens, toxicity
from siltstone.llm.common import shared_uri, table
from siltstone.llm.queries import vocabulary

TOXIC = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon scores below the threshold; it is learned from the labels of the stage's own input.

    A null or empty text scores what the intercept gives and stays as a rule; very long texts are read whole; repeated rows go or stay
    together; a null doc_id is judged like any; an empty table, and one without labels, is kept as it is; extra columns stay.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(docs, lexicon) < TOXIC)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set that shares 80 % of its five-word shingles, or is chained by such: that of the smallest doc_id.

    All null, empty and blank texts are one set, of which one row stays; so does one of repeated rows and one of rows of
    one id in a set; a row with a null doc_id stays only where its set has no other; an empty table stays empty; extra columns stay.
    """
    return simhash.keep_one(docs, similar.components)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; very long texts are read whole; repeated rows go or stay together; with an empty
    benchmark all stay; an empty table stays empty; extra columns stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null and empty texts have size 0 and are taken for the whole part of their source's rate only; a null source is one of its own;
    the copies of repeated rows are drawn one by one; an empty table gives an empty mix; extra columns stay.
    """
    return mixing.mix(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's token ids are in the binary output.

    A null or empty text is the end id alone; repeated rows and rows of one id follow each other; null ids come last; an empty
    table has no output; extra columns are left out.
    """
    return tokens.read(tokens.write(docs, vocabulary()))


STAGES = [("toxicity", without_toxic), ("near duplicates", without_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("token ids", tokenized)]

#: No SQL: trained scores, drawn copies and a tokenizer's ids. The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents below ``sf_dir``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_uri(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
