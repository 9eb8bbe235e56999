"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, html_main, licenses, mixing, oracles, quality, secret_scan, simhash, substrings, tokens, toxicity
from siltstone.llm.common import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to shards and read back."""
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), vocabulary()))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows that an earlier one has."""
    return substrings.digests(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to the sources' target weights."""
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in all documents."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.assess(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_tokens, op2_substrings, op3_licenses, op4_mixing, op5_html, op6_secrets, op7_toxicity, op8_simhash, op9_quality, op10_decontaminate)
}
ORACLE: dict[str, str] = {"op2_substrings": oracles.SUBSTRINGS, "op3_licenses": licenses.oracle(), "op9_quality": oracles.cutoffs(), "op10_decontaminate": oracles.CONTAMINATION}
