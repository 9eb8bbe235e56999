"""Functions of the engine that SQL text can call by name: scalar and table functions of a session, in SQL, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALAR = {
    "similar_to": ("value STRING, regexp STRING", "BOOLEAN", "value RLIKE concat('^(?:', regexp, ')$')"),
    "age_in_days": ("day DATE, upto DATE", "BIGINT", "CAST(datediff(upto, day) AS BIGINT)"),
    "bucket_start": ("seconds BIGINT, at TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "CAST(timestamp_seconds(unix_seconds(CAST(at AS TIMESTAMP)) - pmod(unix_seconds(CAST(at AS TIMESTAMP)), seconds)) AS TIMESTAMP_NTZ)"),
}
TABLE = {
    "split_rows": ("value STRING, by STRING", "nth INT, part STRING", "SELECT pos + 1, col FROM posexplode(split(value, concat('\\\\Q', by, '\\\\E')))"),
    "series": ("first BIGINT, last BIGINT, step BIGINT", "n BIGINT", "SELECT explode(CASE WHEN (last - first) * step >= 0 THEN sequence(first, last, step) END)"),
}


def install(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names."""
    for name, (takes, gives, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    for name, (takes, gives, body) in TABLE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
    return [*SCALAR, *TABLE]
