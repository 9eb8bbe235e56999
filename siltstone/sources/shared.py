"""The folder that the driver and all executors share, and frames that are cut off from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; else, where driver and executors are one process, one of our own."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that the driver and all executors of {context.master} share")
        where = tempfile.mkdtemp(prefix="siltstone-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def shared_uri(spark: SparkSession) -> str:
    """That folder with its scheme, so that a task's file library finds the store that Spark means."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


#: Schemes that Hadoop and Arrow spell differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def arrow_store(uri: str):
    """Arrow's file system and path for a URI of Spark's: local files, S3, GCS, Azure and HDFS (where its native library is installed).

    Raises ValueError, naming the scheme, for a store that Arrow can't write to; ask for it on the driver before a job relies on it.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{colon}{rest}")
    except (OSError, ValueError) as error:
        raise ValueError(f"tasks can't write files to {scheme}: {error}") from error


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that no later stage computes it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
