"""Relations over paths: delimited text, JSON, Delta logs and plain text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.sources.shared import cut

#: Timestamps in text keep their microseconds.
TIMES = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, delimiter: str | None = None, header: bool | None = None, sample_lines: int = 200, types_from: float = 1.0) -> DataFrame:
    """Delimited text, plain or compressed.

    The delimiter is the one that is steady over the first lines; the first line is a header unless one of its fields is empty,
    a number or there twice. Files in which a line has an odd number of quotes have line feeds inside fields: they
    are read a file a task, others in splits. Types are inferred from the share ``types_from`` of the rows unless ``schema`` is given.
    """
    lines = [r["value"] for r in spark.read.text(path).limit(sample_lines).collect()]
    if delimiter is None:
        bare = re.sub(r'"(?:[^"]|"")*"', "", "\n".join(lines)).split("\n")  # without what is between quotes
        counts = {d: [line.count(d) for line in bare] for d in (",", "\t", ";", "|")}
        delimiter = max(counts, key=lambda d: (min(counts[d], default=0) > 0, -len(set(counts[d])), sum(counts[d])))
    if header is None:
        names = [f.strip().strip('"') for f in lines[0].split(delimiter)] if lines else []
        header = len(set(names)) == len(names) and all(n and not _number(n) for n in names)
    odd = spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)
    reader = spark.read.option("header", header).option("sep", delimiter).option("escape", '"').option("multiLine", not odd.isEmpty())
    reader = reader.option("timestampFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True).option("samplingRatio", types_from)).csv(path)


def _number(text: str) -> bool:
    try:
        return float(text) is not None
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON lines, or files that are one array of objects each; which of them, the first character tells."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0]["value"].lstrip().startswith("[")
    reader = spark.read.option("timestampNTZFormat", TIMES).option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def _any(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob matches a file, in whatever store it is."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob))


#: Rows of the log that are read, and what readers have to know to read the table.
_KINDS = (
    "add STRUCT<path: STRING, partitionValues: MAP<STRING, STRING>, deletionVector: STRUCT<storageType: STRING>>, remove STRUCT<path: STRING>, "
    "metaData STRUCT<schemaString: STRING, partitionColumns: ARRAY<STRING>, configuration: MAP<STRING, STRING>>, protocol STRUCT<minReaderVersion: INT, readerFeatures: ARRAY<STRING>>"
)
_KNOWN_FEATURES = {"timestampNtz", "vacuumProtocolCheck", "deletionVectors", "columnMapping", "appendOnly", "invariants"}
MOST_BROADCAST = 100_000


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _place(path: Column) -> Column:
    """A decoded path without its scheme's slashes, the same however the store spells them."""
    return F.regexp_replace(_decoded(path), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table at ``path`` as of ``version``, from its log: files added and not removed since, with partition values as columns.

    The log is read as a table itself (JSON commits and the last Parquet checkpoint before ``version``); only the paths of the
    live files go to the driver, as any scan's file list does. Where folders are named for the partition values, Spark reads them from
    there and prunes by them; else they are joined by the whole path. Tables that need more of a reader are refused with the
    reason: files with deletion vectors, mapped columns, checkpoints with sidecars, and features that aren't known here.
    """
    log = f"{path}/_delta_log"
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    columns = ["add", "remove", "metaData", "protocol", F.regexp_extract(name, r"^(\d+)\.", 1).cast("long").alias("version")]
    wanted = F.lit(True) if version is None else F.col("version") <= version
    entries = spark.read.json(f"{log}/*.json", schema=_KINDS).select(*columns).where(wanted)
    if _any(spark, f"{log}/*.checkpoint*.parquet"):
        saved = spark.read.schema(_KINDS).parquet(f"{log}/*.checkpoint*.parquet").select(*columns).where(wanted)
        last = saved.agg(F.max("version")).first()[0]
        if last is not None:
            entries = entries.where(F.col("version") > last).unionByName(saved.where(F.col("version") == last))
    heads = entries.where("metaData IS NOT NULL OR protocol IS NOT NULL").agg(
        F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("meta"), F.max_by("protocol", F.when(F.col("protocol").isNotNull(), F.col("version"))).alias("protocol")
    ).first()
    meta = heads["meta"]
    if meta is None:
        raise FileNotFoundError(f"no table metadata in {log}")
    _check(path, heads["protocol"], meta["configuration"] or {})
    moves = entries.where("add IS NOT NULL OR remove IS NOT NULL").select(
        F.coalesce("add.path", "remove.path").alias("path"), F.col("add.partitionValues").alias("parts"), F.col("add").isNotNull().alias("there"), F.col("add.deletionVector").isNotNull().alias("deleted"), "version"
    )
    order = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), F.desc("there")))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    own = F.when(F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), _decoded(F.col("path"))).otherwise(F.concat(F.lit(f"{root}/"), _decoded(F.col("path"))))
    live = cut(moves.withColumn("n", order).where("n = 1 AND there").select(own.alias("file"), "parts", "deleted"))
    if not live.where("deleted").isEmpty():
        raise NotImplementedError(f"{path} has files with deletion vectors; they can't be left out, so the table is not read")
    schema = StructType.fromJson(json.loads(meta["schemaString"]))
    parts = meta["partitionColumns"] or []
    # the folders below the table's own that the values name
    folders = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col("parts")[c], F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in parts))
    named = live.where(~F.startswith(_decoded(F.col("file")), F.concat(F.lit(f"{root}/"), folders, F.lit("/")))).isEmpty() if parts else True
    paths = [r["file"] for r in live.select("file").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], schema)
    if named:
        rows = spark.read.schema(schema).option("basePath", path).parquet(*paths) if parts else spark.read.schema(schema).parquet(*paths)
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    stored = StructType([f for f in schema if f.name not in parts])
    values = live.select(F.regexp_replace("file", "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/").alias("__file"), *(F.col("parts")[c].alias(c) for c in parts))
    values = F.broadcast(values) if len(paths) <= MOST_BROADCAST else values
    rows = spark.read.schema(stored).parquet(*paths).withColumn("__file", _place(F.col("_metadata.file_path"))).join(values, "__file").drop("__file")
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def _check(path: str, protocol: dict | None, settings: dict) -> None:
    """Refuse a table that a plain reader would read wrongly."""
    needed = set((protocol["readerFeatures"] if protocol else None) or [])
    if protocol and protocol["minReaderVersion"] > 3:
        raise NotImplementedError(f"{path} needs a reader of version {protocol['minReaderVersion']}")
    if unknown := needed - _KNOWN_FEATURES:
        raise NotImplementedError(f"{path} needs reader features that are not handled: {', '.join(sorted(unknown))}")
    if settings.get("delta.columnMapping.mode", "none") != "none":
        raise NotImplementedError(f"{path} maps its columns to other names in its files; this is not handled")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content): a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("filename"), F.col("value").alias("content"))
