"""Queries over the operators that SQL lacks, over sources and over streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import network, postgres, registry
from siltstone.operators import asof, ordering, ranges, search, shaping
from siltstone.plans.catalog import frame_query
from siltstone.sources import files
from siltstone.sources.shared import new_folder
from siltstone.sources.tables import register, table
from siltstone.streaming import windows


@frame_query(
    """
    SELECT e.event_id, c.value AS last_value, c.event_id AS last_id
    FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) c
      ON e.user_id = c.user_id AND e.ts >= c.ts
    """
)
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event beside the user's last click."""
    rows = table(spark, sf_dir, "events")
    clicks = rows.where("event_type = 'click'")
    found = asof.asof_join(rows.where("event_type <> 'click'"), clicks, ["user_id"], "ts", "ts", {"event_id": "last_id", "value": "last_value"})
    return found.select("event_id", "last_value", "last_id")


@frame_query("SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_retailprice BETWEEN s_acctbal - 5 AND s_acctbal + 5")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose price is near a supplier's balance."""
    near = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal - 5 AS low", "s_acctbal + 5 AS high")
    return ranges.point_in_range(table(spark, sf_dir, "part"), near, "p_retailprice", "low", "high", 10.0).select("p_partkey", "s_suppkey")


@frame_query("SELECT a.p_partkey AS a, s_suppkey AS b FROM part a JOIN supplier ON a.p_retailprice <= s_acctbal + 3 AND s_acctbal <= a.p_retailprice + a.p_size / 10.0::DOUBLE")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ranges that overlap balance ranges."""
    a = table(spark, sf_dir, "part").selectExpr("p_partkey AS a", "p_retailprice AS a1", "p_retailprice + p_size / 10.0D AS a2")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS b", "s_acctbal AS b1", "s_acctbal + 3 AS b2")
    return ranges.overlaps(a, b, ("a1", "a2"), ("b1", "b2"), 5.0).select("a", "b")


@frame_query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS WHERE a.event_type = 'view' AND b.event_type = 'click'")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within 12 hours of a view."""
    rows = table(spark, sf_dir, "events")
    a = rows.where("event_type = 'view'").selectExpr("user_id", "event_id AS a", "ts AS a_ts")
    b = rows.where("event_type = 'click'").selectExpr("user_id", "event_id AS b", "ts AS b_ts")
    return ranges.within_time(a, b, "a_ts", "b_ts", "12 hours", ["user_id"]).select("a", "b")


@frame_query("SELECT a.c_custkey, b.s_suppkey FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC) a POSITIONAL JOIN (SELECT s_suppkey FROM supplier ORDER BY s_acctbal, s_suppkey) b")
def join_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers side by side, each in an order of its own."""
    a, b = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier")
    return ordering.positional_join(a, b, [F.desc("c_custkey")], [F.col("s_acctbal"), F.col("s_suppkey")]).select("c_custkey", "s_suppkey")


@frame_query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered by price, without a window over one partition."""
    return ordering.numbered(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], "n").select("o_orderkey", "n")


@frame_query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5")
def topk_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest lines of each supplier."""
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ordering.top_per_group(table(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber")


@frame_query()
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders, by a hash of the key."""
    return ordering.hash_sample(table(spark, sf_dir, "orders"), "o_orderkey", 0.1)


@frame_query(
    "SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' ELSE 'double' END AS column_type, nulls, row_count, distinct_count FROM ("
    "SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS column_name, unnest(['BIGINT', 'VARCHAR', 'VARCHAR', 'VARCHAR', 'INTEGER', 'DOUBLE']) AS column_type, CAST(0 AS BIGINT) AS nulls, count(*) AS row_count, "
    "unnest([count(DISTINCT p_partkey), count(DISTINCT p_name), count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT p_size), count(DISTINCT p_retailprice)]) AS distinct_count FROM part)"
)
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of the parts table."""
    return shaping.summarize(table(spark, sf_dir, "part"), exact=True).select("column_name", "column_type", "nulls", "row_count", "distinct_count")


@frame_query("SELECT l_returnflag, CAST(sum(l_linenumber) FILTER (l_linestatus = 'F') AS BIGINT) AS F, CAST(sum(l_linenumber) FILTER (l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY l_returnflag")
def pivot_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot whose columns are looked up."""
    return shaping.pivot_values(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", "l_linenumber")


@frame_query("SELECT n_nationkey || chr(9) || n_name || chr(9) || coalesce(NULLIF(n_regionkey, 2)::VARCHAR, '\\N') AS line FROM nation")
def copy_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as lines of text."""
    return shaping.copy_text(table(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name", "NULLIF(n_regionkey, 2) AS r"))


@frame_query("SELECT n_nationkey AS k, n_name AS name, NULL::BIGINT AS c FROM nation UNION ALL BY NAME SELECT c_custkey AS c, c_name AS name FROM customer")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and customers, columns matched by name."""
    a = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name AS name")
    return a.unionByName(table(spark, sf_dir, "customer").selectExpr("c_custkey AS c", "c_name AS name"), allowMissingColumns=True)


@frame_query("SELECT o_orderkey, round(abs(o_totalprice - (SELECT median(o_totalprice) FROM orders)), 4) AS off, (SELECT round(mad(o_totalprice), 4) FROM orders) AS mad FROM orders")
def mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the median, and the median of those."""
    rows = table(spark, sf_dir, "orders")
    middle = rows.agg(F.median("o_totalprice").alias("m"))
    off = rows.crossJoin(F.broadcast(middle)).select("o_orderkey", F.abs(F.col("o_totalprice") - F.col("m")).alias("off"))  # one row
    spread = off.agg(F.round(F.median("off"), 4).alias("mad"))
    return off.crossJoin(F.broadcast(spread)).select("o_orderkey", F.round("off", 4).alias("off"), "mad")


@frame_query(
    """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
    t AS (SELECT unnest(['the', 'license', 'released']) AS term),
    f AS (SELECT doc_id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, t),
    s AS (SELECT term, count(*) AS n, avg(len) AS a, count(*) FILTER (tf > 0) AS df FROM f GROUP BY term)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 4) AS score
    FROM f JOIN s USING (term) GROUP BY doc_id HAVING sum(tf) > 0
    """
)
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for three words."""
    return search.bm25(table(spark, sf_dir, "documents"), ["the", "license", "released"]).select("doc_id", F.round("score", 4).alias("score"))


@frame_query(
    """
    SELECT query, vec_id, similarity FROM (
      SELECT q.vec_id AS query, a.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], a.embedding::DOUBLE[]), 5) AS similarity,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) DESC, a.vec_id) AS n
      FROM embeddings q JOIN embeddings a ON q.vec_id <> a.vec_id WHERE q.vec_id % 20 = 0) WHERE n <= 10
    """
)
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every twentieth."""
    rows = table(spark, sf_dir, "embeddings")
    return search.nearest(rows, rows.where("vec_id % 20 = 0")).select("query", "vec_id", F.round("similarity", 5).alias("similarity"))


@frame_query()
def vec_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of lists; the tests hold its recall against the exact search."""
    rows = table(spark, sf_dir, "embeddings")
    return search.VectorLists(rows, lists=16).nearest(rows.where("vec_id % 20 = 0")).select("query", "vec_id", F.round("similarity", 5).alias("similarity"))


@frame_query(
    "SELECT event_id, user_id % 4 = 1 AS inside, CAST(167772160 + (user_id % 4) * 65536 + event_id % 256 AS BIGINT) AS number, "
    "printf('20010db8%024x', event_id % 65536) AS hex, event_id % 65536 < 256 AS inside6, CAST(NULL AS BIGINT) AS none FROM events"
)
def inet_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether made-up addresses of both versions are in a network."""
    address = F.concat_ws(".", F.lit("10"), F.col("user_id") % 4, F.lit("0"), F.col("event_id") % 256)
    six = F.concat(F.lit("2001:db8::"), F.lower(F.hex(F.col("event_id") % 65536)))
    return table(spark, sf_dir, "events").select(
        "event_id", network.in_network(address, "10.1.0.0/16").alias("inside"), network.address_number(address).alias("number"),
        network.address_hex(six).alias("hex"), network.in_network(six, "2001:db8::/120").alias("inside6"), network.address_number(F.lit("300.1.1.1")).alias("none"),
    )


@frame_query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y at %H:%M') AS text, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS day, [regexp_extract(o_orderpriority, '[A-Z]+')] AS words FROM orders")
def pg_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PostgreSQL's formatting functions."""
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey",
        postgres.to_char(F.col("o_orderdate"), 'DD.MM.YYYY "at" HH24:MI').alias("text"),
        postgres.to_date(postgres.to_char(F.col("o_orderdate"), "YYYYMMDD"), "YYYYMMDD").alias("day"),
        F.slice(postgres.regexp_matches(F.col("o_orderpriority"), "[A-Z]+"), 1, 1).alias("words"),
    )


@frame_query("SELECT * FROM part WHERE p_size > 25")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet by path and glob."""
    return spark.read.parquet(f"{sf_dir}/par[t].parquet").where("p_size > 25")


@frame_query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through delimited text."""
    path = new_folder(spark)
    table(spark, sf_dir, "supplier").write.option("header", True).option("sep", ";").csv(path)
    rows = files.read_csv(spark, path)
    return rows.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@frame_query("SELECT event_id, ts, value FROM events WHERE event_type = 'view'")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through JSON lines."""
    path = new_folder(spark)
    rows = table(spark, sf_dir, "events")
    rows.write.option("timestampNTZFormat", files.TIMES).json(path)
    return files.read_json(spark, path, rows.schema).where("event_type = 'view'").select("event_id", "ts", "value")


def _delta_commit(df: DataFrame, path: str, version: int, by: tuple[str, ...] = (), removed: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Files and a log entry as a Delta writer leaves them, for the scans below to read; the paths of the files."""
    spark = df.sparkSession
    folder = f"data-{version}" if not by else ""
    before = set() if version == 0 or folder else {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").distinct().collect()}
    df.write.mode("append").partitionBy(*by).parquet(f"{path}/{folder}")
    rows = spark.read.parquet(f"{path}/{folder}").select("_metadata.file_path", "_metadata.file_size", *by).distinct().collect()  # a row for each file
    paths = {r["file_path"]: r["file_path"].split(f"{path}/", 1)[-1] for r in rows if r["file_path"] not in before}
    actions = [
        {"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}},
        {"metaData": {"id": "t", "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(), "partitionColumns": list(by), "configuration": {}}},
        *({"remove": {"path": p, "dataChange": True}} for p in removed),
        *({"add": {"path": paths[r["file_path"]], "partitionValues": {c: str(r[c]) for c in by}, "size": r["file_size"], "modificationTime": 0, "dataChange": True}} for r in rows if r["file_path"] in paths),
    ]
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_delta_log/{version:020d}.json")
    out = log.getFileSystem(spark._jsc.hadoopConfiguration()).create(log, False)
    out.write(bytearray("\n".join(map(json.dumps, actions)).encode()))
    out.close()
    return tuple(paths.values())


@frame_query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def scan_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers through a Delta table."""
    path = new_folder(spark)
    _delta_commit(table(spark, sf_dir, "supplier"), path, 0)
    return files.read_delta(spark, path).where("s_acctbal > 0")


@frame_query("SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'")
def scan_delta_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers through a Delta table of a folder for each segment, whose files have the same names; one segment is pruned."""
    path = new_folder(spark)
    _delta_commit(table(spark, sf_dir, "customer").coalesce(1), path, 0, ("c_mktsegment",))
    return files.read_delta(spark, path).where("c_mktsegment <> 'BUILDING'")


@frame_query("SELECT 0 AS version, count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, count(*), sum(o_orderkey)::BIGINT FROM orders UNION ALL SELECT 2, count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey % 2 = 1")
def scan_delta_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a Delta table: half of the orders, all, the other half."""
    path, orders = new_folder(spark), table(spark, sf_dir, "orders")
    first = _delta_commit(orders.where("o_orderkey % 2 = 0"), path, 0)
    _delta_commit(orders.where("o_orderkey % 2 = 1"), path, 1)
    _delta_commit(orders.limit(0), path, 2, removed=first)
    found = [files.read_delta(spark, path, v).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("o_orderkey").alias("s")) for v in range(3)]
    return found[0].union(found[1]).union(found[2])


@frame_query("SELECT column_name AS col_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp_ntz' END AS data_type FROM (DESCRIBE SELECT * FROM orders)")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of a query's columns, from analysis alone."""
    rows = table(spark, sf_dir, "orders")
    return spark.createDataFrame(rows.dtypes, "col_name string, data_type string")


@frame_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT'")
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed parameters, bound and not spliced."""
    text = "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :least AND o_orderpriority = :priority"
    return spark.sql(text, args={"least": 150000, "priority": "1-URGENT"}, orders=table(spark, sf_dir, "orders"))


@frame_query("SELECT page_id, CAST(i AS INT) AS nth FROM (SELECT page_id, unnest(range(1, page_id % 4 + 1)) AS i FROM pages)")
def repeat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as many times as a column of it says, none among them."""
    times = F.when(F.col("page_id") % 4 > 0, F.sequence(F.lit(1), (F.col("page_id") % 4).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(times).alias("nth"))


@frame_query()
def now_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's date and time, once for the whole query; the tests hold them against the clock."""
    return spark.sql("SELECT now() AS now, current_timestamp() AS stamp, current_date() AS today, localtimestamp() AS local, CAST(now() AS DATE) = current_date() AS same_day")


@frame_query("SELECT n_regionkey, product(n_nationkey + 1) AS p FROM nation GROUP BY n_regionkey")
def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, merged from partial ones."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.product(F.col("n_nationkey") + 1).alias("p"))


@frame_query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%d/%m/%y') AS b, strftime(o_orderdate, '%b %B %a %A %j') AS c, strftime(o_orderdate, '%I %p') AS d, "
    "strftime(o_orderdate, '%G-W%V ') || (dayofweek(o_orderdate) + 1)::VARCHAR || ' ' || right(strftime(o_orderdate, '%G'), 2) || ' ' || lpad(((dayofyear(o_orderdate) - 1) // 7 + 1)::VARCHAR, 2, '0') AS e FROM orders"
)
def to_char_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text by PostgreSQL's templates, ISO weeks among them."""
    templates = {"a": "YYYY-MM-DD HH24:MI:SS", "b": "DD/MM/YY", "c": "Mon Month Dy Day DDD", "d": "HH12 AM", "e": 'IYYY-"W"IW D IY WW'}
    return table(spark, sf_dir, "orders").select("o_orderkey", *(postgres.to_char(F.col("o_orderdate"), t).alias(n) for n, t in templates.items()))


@frame_query("SELECT CAST(strptime('15/01/2024', '%d/%m/%Y') AS DATE) AS a, CAST(strptime('2024-01-15', '%Y-%m-%d') AS DATE) AS b")
def to_date_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as dates."""
    return spark.range(1).select(postgres.to_date(F.lit("15/01/2024"), "DD/MM/YYYY").alias("a"), postgres.to_date(F.lit("2024-01-15"), "YYYY-MM-DD").alias("b"))


@frame_query("SELECT strptime('2024-01-15 10:30:00', '%Y-%m-%d %H:%M:%S') AS a, try_strptime('nonsense', '%Y') IS NULL AS b")
def to_timestamp_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as timestamps; null where a text has another form."""
    return spark.range(1).select(postgres.to_timestamp(F.lit("2024-01-15 10:30:00"), "YYYY-MM-DD HH24:MI:SS").alias("a"), postgres.try_to_timestamp(F.lit("nonsense"), "YYYY").isNull().alias("b"))


@frame_query("SELECT CAST('12345.67' AS DOUBLE) AS a, CAST(replace('12,345.67', ',', '') AS DOUBLE) AS b, -12.5::DOUBLE AS c, CAST(NULL AS DOUBLE) AS d")
def to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as numbers, by template; null where a text isn't of it."""
    of = lambda text, template=None: postgres.to_number(F.lit(text), template)
    return spark.range(1).select(of("12345.67").alias("a"), of("12,345.67", "99,999.99").alias("b"), of("12.5-", "99.9S").alias("c"), of("1x", "99").alias("d"))


@frame_query()
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts and suppliers, estimated by sketches; the tests hold them against the exact counts."""
    parts = F.approx_count_distinct("l_partkey", 0.01).alias("parts")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(parts, F.hll_sketch_estimate(F.hll_sketch_agg("l_suppkey", F.lit(14))).alias("suppliers"))


@frame_query()
def approx_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated quantiles; the tests hold their ranks against the exact ones."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.percentile_approx("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)), 10_000).alias("q"))


_HOURLY = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2"


def _plain_times(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@frame_query(_HOURLY)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of the event stream; all of them, so in complete mode."""
    rows = windows.events(spark, f"{sf_dir}/events.parquet")
    return _plain_times(windows.settle(windows.tumbling(rows, "1 hour", ["event_type"]), mode="complete"))


@frame_query("SELECT user_id, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user, kept as state: the last ones."""
    rows = windows.running_totals(windows.events(spark, f"{sf_dir}/events.parquet"))
    last = lambda t: t.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("user_id", "x.n", F.round("x.total", 3).alias("total"))
    return windows.settle(rows, mode="update", merge=last)


@frame_query("SELECT DISTINCT event_id, user_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream without repeats, beside a static table."""
    rows = windows.unique(windows.events(spark, f"{sf_dir}/events.parquet"), ["event_id"])
    return windows.settle(windows.enriched(rows, table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_name"), "user_id").select("event_id", "user_id", "c_name"))


@frame_query("SELECT start, count(*) AS n, round(sum(value), 4) AS s FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that begin every half hour."""
    rows = windows.events(spark, f"{sf_dir}/events.parquet")
    return _plain_times(windows.settle(windows.tumbling(rows, "1 hour", [], slide="30 minutes"), mode="complete"))


@frame_query(
    """
    SELECT user_id, min(ts) AS start, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s
    """
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, closed by ten minutes without an event; all of them, so in complete mode."""
    return _plain_times(windows.settle(windows.sessions(windows.events(spark, f"{sf_dir}/events.parquet"), "10 minutes"), mode="complete"))


@frame_query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'view' AND b.event_type = 'click'")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of one stream within six hours of a view of another."""
    rows = lambda kind, name: windows.events(spark, f"{sf_dir}/events.parquet").where(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    return windows.settle(windows.matched(rows("view", "a"), rows("click", "b"), "user_id", "6 hours").select("a", "b"))


@frame_query("SELECT p_partkey, p_brand FROM part WHERE p_brand SIMILAR TO 'Brand#[1-3].*'")
def filter_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that has to match whole values, through a registered function."""
    registry.install(spark)
    register(spark, sf_dir, "part")
    return spark.sql("SELECT p_partkey, p_brand FROM part WHERE similar_to(p_brand, 'Brand#[1-3].*')")


@frame_query("SELECT event_id, time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, DATE '2030-01-01' - CAST(ts AS DATE) AS days FROM events")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions by name in SQL text."""
    registry.install(spark)
    register(spark, sf_dir, "events")
    return spark.sql("SELECT event_id, bucket_start(420, ts) AS start, age_in_days(CAST(ts AS DATE), DATE '2030-01-01') AS days FROM events")


@frame_query(
    "SELECT p_partkey, CAST(i AS INT) AS nth, a[i] AS part, n FROM (SELECT p_partkey, p_size, string_split(p_type, ' ') AS a, unnest(range(1, len(string_split(p_type, ' ')) + 1)) AS i FROM part), LATERAL (SELECT unnest(range(0, p_size + 1, 10)) AS n)"
)
def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table functions by name, beside each row."""
    registry.install(spark)
    register(spark, sf_dir, "part")
    return spark.sql("SELECT p_partkey, w.nth, w.part, s.n FROM part, LATERAL split_rows(p_type, ' ') w, LATERAL series(0, p_size, 10) s")
