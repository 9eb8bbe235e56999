"""What keeps executors small: one Python worker a task, none for rows of the driver, few tasks for few edges."""

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.llm import common, decontaminate, simhash


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_benchmark_items_meet_shards_in_a_stage_with_one_python_worker(spark, docs):
    items = docs.select(F.col("doc_id").cast("string").alias("item_id"), "text").limit(20)
    rows = decontaminate.read_against(docs, items)
    found = decontaminate.found(rows, items)
    assert physical(found).count("MapInArrow") == 1
    assert found.count() >= 20 - 4  # the items are documents; some have no words


def test_rows_of_the_driver_need_no_python_worker(spark):
    for rows in ([(3, None), (4, 1 << 40)], []):
        df = common.local_rows(spark, rows, part=pa.int32(), base=pa.int64())
        assert df.dtypes == [("part", "int"), ("base", "bigint")] and [tuple(r) for r in df.orderBy("part").collect()] == rows
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_few_edges_are_few_tasks(spark, monkeypatch):
    """Chains of 50 nodes, some by way of a node of very many edges: the same components whatever the edges of a partition."""
    edges = [(1000 * k + i, 1000 * k + i + 1) for k in range(20) for i in range(50)] + [(7, 20_000 + i) for i in range(300)]
    want = {(u, 1000 * (u // 1000)) for e in edges[:1000] for u in e if u % 1000} | {(20_000 + i, 0) for i in range(300)}
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most, few in ((simhash.EDGES, 1), (700, 2)):
            monkeypatch.setattr(simhash, "EDGES", most)
            found = simhash.connect(spark.createDataFrame(edges, "u long, v long"))
            assert {tuple(r) for r in found.collect()} == want
            assert found.rdd.getNumPartitions() <= few < common.parts(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
