"""Operators, functions, sources and streams on small made-up tables, with nulls, ties and empty sides."""

import datetime as dt
import gzip
import json
import random
import urllib.parse

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from siltstone.functions import network, postgres
from siltstone.operators import asof, ordering, ranges, search, shaping
from siltstone.plans import catalog
from siltstone.sources import files, shared
from siltstone.streaming import windows

START = dt.datetime(2024, 1, 1)


def moments(seed, n, days=6):
    draw = random.Random(seed)
    return [(i, draw.choice(["a", "a", "b", "c"]), START + dt.timedelta(minutes=draw.randint(0, days * 1440))) for i in range(n)]


@pytest.mark.parametrize("bucket", [3_600, 86_400, 10**7])
def test_asof(spark, bucket):
    left, right = [*moments(1, 80), (900, "none", START), (901, None, START), (902, "a", None)], moments(2, 60)
    l = spark.createDataFrame(left, "id long, k string, t timestamp_ntz")  # noqa: E741
    r = spark.createDataFrame(right, "rid long, k string, u timestamp_ntz")
    got = {row["id"]: row["m"] for row in asof.asof_join(l, r, ["k"], "t", "u", {"rid": "m"}, bucket_seconds=bucket).collect()}
    want = {i: max(((u, j) for j, kk, u in right if kk == k and t and u <= t), default=(None, None))[1] for i, k, t in left}
    assert got == want
    near = {row["id"]: row["m"] for row in asof.asof_join(l, r, ["k"], "t", "u", {"rid": "m"}, bucket_seconds=bucket, tolerance="2 hours").collect()}
    assert near == {i: max(((u, j) for j, kk, u in right if kk == k and t and u <= t and u >= t - dt.timedelta(hours=2)), default=(None, None))[1] for i, k, t in left}
    assert asof.asof_join(l.limit(0), r, ["k"], "t", "u", {"rid": "m"}).count() == 0
    assert asof.asof_join(l, r.limit(0), ["k"], "t", "u", {"rid": "m"}).where("m IS NOT NULL").count() == 0


def test_ranges(spark):
    draw = random.Random(3)
    points = [(i, draw.randint(-500, 500) / 10) for i in range(150)] + [(999, None)]
    spans = [(i, lo := draw.randint(-500, 500) / 10, lo + draw.choice([-1, 0, 0.5, 2.5, 3, 40, 600, 1e6, 1e12])) for i in range(60)] + [(998, None, 3.0)]
    p = spark.createDataFrame(points, "p long, x double")
    s = spark.createDataFrame(spans, "s long, lo double, hi double")
    got = sorted((r["p"], r["s"]) for r in ranges.point_in_range(p, s, "x", "lo", "hi", 2.5).collect())
    assert got == sorted((i, j) for i, x in points for j, lo, hi in spans if None not in (x, lo, hi) and lo <= x <= hi)
    assert ranges.point_in_range(p, s.limit(0), "x", "lo", "hi", 2.5).count() == 0
    s = s.where("hi < lo + 100")
    spans = [x for x in spans if x[1] is not None and x[2] < x[1] + 100]
    other = s.select(F.col("s").alias("q"), F.col("lo").alias("lo2"), (F.col("hi") + 1).alias("hi2"))
    got = sorted((r["s"], r["q"]) for r in ranges.overlaps(s, other, ("lo", "hi"), ("lo2", "hi2"), 2.5).collect())
    assert got == sorted((i, j) for i, a, b in spans for j, c, d in spans if None not in (a, c) and a <= b and c <= d + 1 and a <= d + 1 and c <= b)


def test_within_time(spark):
    a, b = moments(4, 50), moments(5, 50)
    x = spark.createDataFrame(a, "i long, k string, t timestamp_ntz")
    y = spark.createDataFrame(b, "j long, k string, u timestamp_ntz")
    got = sorted((r["i"], r["j"]) for r in ranges.within_time(x, y, "t", "u", "3 hours", ["k"]).collect())
    assert got == sorted((i, j) for i, k, t in a for j, m, u in b if k == m and t <= u <= t + dt.timedelta(hours=3))


def test_ordering(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x long")
    assert sorted(tuple(r) for r in ordering.numbered(rows, [F.desc("x")]).collect()) == [(x, 101 - x) for x in range(101)]
    pairs = ordering.positional_join(rows, rows.where("x < 3").withColumnRenamed("x", "y"), [F.col("x")], [F.desc("y")]).orderBy("x").limit(4).collect()
    assert [tuple(p) for p in pairs] == [(0, 2), (1, 1), (2, 0), (3, None)]
    assert ordering.numbered(rows.limit(0), [F.col("x")]).count() == 0
    assert ordering.hash_sample(rows, "x", 1.0).count() == 101 and ordering.hash_sample(rows, "x", 0.0).count() == 0


def test_shaping(spark):
    rows = spark.createDataFrame([(1, "a\tb"), (2, None), (2, "x\\y\n")], "k long, v string")
    got = {r["column_name"]: (r["min"], r["max"], r["nulls"], r["row_count"], r["distinct_count"]) for r in shaping.summarize(rows, exact=True).collect()}
    assert got == {"k": ("1", "2", 0, 3, 2), "v": ("a\tb", "x\\y\n", 1, 3, 2)}
    assert {r["distinct_count"] for r in shaping.summarize(rows).collect()} == {2}
    assert [r["line"] for r in shaping.copy_text(rows).collect()] == ["1\ta\\tb", "2\t\\N", "2\tx\\\\y\\n"]
    with pytest.raises(ValueError):
        shaping.pivot_values(rows, ["v"], "k", "k", most=1)


def test_nearest(spark):
    draw = random.Random(6)
    vectors = [(i, [draw.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    got = search.nearest(rows, rows.where("vec_id % 20 = 0"), k=4, block=2).collect()

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    for q, v in vectors[::20]:
        want = [i for _, i in sorted((-cosine(v, w), i) for i, w in vectors if i != q)[:4]]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: -r["similarity"]) if r["query"] == q] == want
    assert search.nearest(rows, rows.limit(0)).count() == 0
    more = spark.createDataFrame([(1000, None), (None, vectors[0][1])], rows.schema)
    assert search.nearest(rows.union(more), rows.where("vec_id = 0")).where("vec_id IS NULL OR vec_id = 1000").isEmpty()


def test_ties_go_to_the_smaller_key(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "vec_id long, embedding array<double>")
    got = search.nearest(rows, rows.where("vec_id < 2"), k=3, block=7).collect()
    assert sorted((r["query"], r["vec_id"]) for r in got) == [(0, 2), (0, 4), (0, 6), (1, 3), (1, 5), (1, 7)]


def test_lists_of_vectors(spark):
    """Every row is in a list, and nine of ten exact neighbours are found."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    index = search.VectorLists(rows, lists=16)
    assert index.rows.select("vec_id").distinct().count() == rows.count()
    found = index.nearest(asked)
    assert found.groupBy("query").count().where("count > 10").isEmpty()
    assert search.recall(search.nearest(rows, asked), found) >= 0.9
    assert index.nearest(asked.limit(0)).count() == 0


def test_estimates(spark):
    """Within the sketches' error of the exact figures."""
    sf = "/root/testdata/sf0.01"
    lines, orders = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders"))
    exact = {r["l_returnflag"]: r for r in lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("p"), F.count_distinct("l_suppkey").alias("s")).collect()}
    for r in catalog.QUERIES["approx_distinct"](spark, sf).collect():
        assert abs(r["parts"] - exact[r[0]]["p"]) <= 0.04 * exact[r[0]]["p"] and abs(r["suppliers"] - exact[r[0]]["s"]) <= 0.04 * exact[r[0]]["s"]
    for r in catalog.QUERIES["approx_quantile"](spark, sf).collect():
        prices = sorted(x[0] for x in orders.where(F.col("o_orderstatus") == r[0]).select("o_totalprice").collect())
        for q, x in zip((0.25, 0.5, 0.9), r["q"], strict=True):
            assert abs(sum(p <= x for p in prices) - q * len(prices)) <= 0.001 * len(prices) + 1


def test_sample_has_its_share(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "k")
    drawn = ordering.hash_sample(rows, "k", 0.1)
    assert abs(drawn.count() - 20_000) < 5 * (20_000 * 0.9) ** 0.5
    assert drawn.exceptAll(ordering.hash_sample(rows.repartition(7), "k", 0.1)).isEmpty()
    assert drawn.exceptAll(ordering.hash_sample(rows, "k", 0.2)).isEmpty()
    halves = {r["h"]: r["n"] for r in drawn.groupBy((F.col("k") < 100_000).alias("h")).agg(F.count("*").alias("n")).collect()}
    assert abs(halves[True] - halves[False]) < 5 * 20_000**0.5


def test_now(spark):
    before = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    r = spark.sql("SELECT 1").crossJoin(catalog.QUERIES["now_functions"](spark, "").selectExpr("CAST(now AS TIMESTAMP_NTZ) AS n", "stamp = now AS same", "today", "local", "same_day")).first()
    after = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    assert before - dt.timedelta(seconds=1) <= r["n"] <= after and r["same"] and r["same_day"] and r["today"] == r["n"].date() and r["local"] == r["n"]


@pytest.mark.parametrize(
    ("template", "want"),
    [("YYYY-MM-DD", "yyyy-MM-dd"), ("YYYY-MM-DD HH24:MI:SS", "yyyy-MM-dd HH:mm:ss"), ("DD Mon YY", "dd MMM yy"), ("HH12:MI AM", "hh:mm a"), ('YYYY"year"', "yyyy'year'"), ("DDD", "DDD")],
)
def test_templates(template, want):
    assert postgres.pattern(template) == want


def test_unknown_letters_are_errors():
    for template in ("YYYY at", "DD-XX", "J"):
        with pytest.raises(ValueError, match="no pattern"):
            postgres.pattern(template)
    with pytest.raises(ValueError, match="not read"):
        postgres.pattern("IYYY-IW")
    with pytest.raises(ValueError, match="no pattern"):
        postgres.to_number(F.lit("1"), "99x")


def test_weeks(spark):
    days = [dt.datetime(y, 12, 28) + dt.timedelta(days=i) for y in range(2014, 2027) for i in range(9)]
    rows = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    got = {r["d"]: r["t"] for r in rows.select("d", postgres.to_char(F.col("d"), 'IYYY IY IW WW D "it\'s" Q').alias("t")).collect()}
    for d in days:
        year, week, _ = d.isocalendar()
        assert got[d] == f"{year} {year % 100:02d} {week:02d} {(d.timetuple().tm_yday - 1) // 7 + 1:02d} {d.isoweekday() % 7 + 1} it's {(d.month + 2) // 3}"


def test_addresses(spark):
    import ipaddress

    texts = ["10.0.0.1", "255.255.255.255", "300.1.1.1", "1.2.3", "01.2.3.4", "a.b.c.d", "", None, "::", "::1", "1::", "2001:db8::8a2e:370:7334", "2001:0DB8:0:0:0:0:0:1", "::ffff:192.0.2.128", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "12345::", "1:2:3:4:5:6:7", "g::", "fe80::1%eth0", ":::"]
    nets = ["10.0.0.0/8", "2001:db8::/33", "::/0", "0.0.0.0/0", "::ffff:0:0/96"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string")
    got = rows.select("a", network.address_hex(F.col("a")), network.address_number(F.col("a")), *(network.in_network(F.col("a"), n) for n in nets)).collect()

    def want(text):
        try:
            a = ipaddress.ip_address(text or "")
        except ValueError:
            return (None, None, *(None for _ in nets))
        own = [ipaddress.ip_network(n) for n in nets]
        return (f"{int(a):0{a.max_prefixlen // 4}x}", int(a) if a.version == 4 else None, *(a.version == n.version and a in n for n in own))

    assert {r[0]: tuple(r)[1:] for r in got if r[0] != "fe80::1%eth0"} == {t: want(t) for t in texts if t != "fe80::1%eth0"}


def test_postgres_functions(spark):
    row = spark.range(1).select(
        postgres.to_char(F.lit("2024-01-15 10:30:00").cast("timestamp_ntz"), "YYYY-MM-DD HH24:MI:SS").alias("a"),
        postgres.to_date(F.lit("2024-01-15"), "YYYY-MM-DD").alias("b"),
        postgres.to_timestamp(F.lit("2024-01-15 10:30:00"), "YYYY-MM-DD HH24:MI:SS").alias("c"),
        postgres.to_number(F.lit("12,345.67")).alias("d"),
        postgres.regexp_matches(F.lit("x@y.z"), "@(.+)$").alias("e"),
        postgres.age(F.current_date()).alias("f"),
        network.in_network(F.lit("192.168.3.4"), "192.168.0.0/16").alias("g"),
        network.in_network(F.lit("192.169.3.4"), "192.168.0.0/16").alias("h"),
    ).first()
    assert tuple(row) == ("2024-01-15 10:30:00", dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 10, 30), 12345.67, ["@y.z"], 0, True, False)


def test_csv_and_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k|v\n1|x,y\n2|z\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).orderBy("k").collect()] == [(1, "x,y"), (2, "z")]
    (tmp_path / "b.csv").write_text('a,b\n1,"two\nlines ""quoted"""\n2,x\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv")).orderBy("a").collect()] == [(1, 'two\nlines "quoted"'), (2, "x")]
    (tmp_path / "c.csv").write_text("1;x\n2;y\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c.csv")).orderBy("_c0").collect()] == [(1, "x"), (2, "y")]
    with gzip.open(tmp_path / "d.csv.gz", "wt") as out:
        out.write("k\tv\n1\tx\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "d.csv.gz")).collect()] == [(1, "x")]
    (tmp_path / "e.json").write_text('\n [{"a": 1}, {"a": 2,\n "b": "x"}]\n')
    assert sorted(r["a"] for r in files.read_json(spark, str(tmp_path / "e.json")).collect()) == [1, 2]
    (tmp_path / "f.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json(spark, str(tmp_path / "f.json")).collect()) == [1, 2]
    assert files.read_text(spark, str(tmp_path / "a.csv")).first()["content"] == "k|v\n1|x,y\n2|z\n"


def test_delta_log(spark, tmp_path):
    log = tmp_path / "t" / "_delta_log"
    log.mkdir(parents=True)
    schema = {"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("id", "long"), ("v", "string"), ("day", "date"))]}
    for name, ids in (("p1", [1, 2]), ("p2", [3]), ("p3", [4, 5])):
        spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string").coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / "t" / f"{name}.parquet")
    add = lambda p, day: {"add": {"path": f"{p}.parquet", "partitionValues": {"day": day}, "size": 1, "dataChange": True}}
    commits = [
        [{"metaData": {"id": "x", "schemaString": json.dumps(schema), "partitionColumns": ["day"]}}, add("p1", "2024-01-01")],
        [add("p2", "2024-01-02")],
        [{"remove": {"path": "p1.parquet", "dataChange": True}}, add("p3", None)],
    ]
    for n, actions in enumerate(commits):
        (log / f"{n:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    at = lambda v=None: sorted(tuple(r) for r in files.read_delta(spark, str(tmp_path / "t"), v).fillna({"v": ""}).selectExpr("id", "v", "CAST(day AS STRING)").collect())
    assert at(0) == [(1, "v1", "2024-01-01"), (2, "v2", "2024-01-01")]
    assert at(1) == [(1, "v1", "2024-01-01"), (2, "v2", "2024-01-01"), (3, "v3", "2024-01-02")]
    assert at() == [(3, "v3", "2024-01-02"), (4, "v4", None), (5, "v5", None)]
    # a checkpoint of version 1 stands for the commits up to it
    kinds = "add STRUCT<path: STRING, partitionValues: MAP<STRING, STRING>>, remove STRUCT<path: STRING>, metaData STRUCT<schemaString: STRING, partitionColumns: ARRAY<STRING>>"
    (tmp_path / "saved").write_text("\n".join(json.dumps(a) for c in commits[:2] for a in c))
    spark.read.json(str(tmp_path / "saved"), schema=kinds).coalesce(1).write.parquet(str(tmp_path / "c"))
    next((tmp_path / "c").glob("part-*.parquet")).rename(log / f"{1:020d}.checkpoint.parquet")
    for n in (0, 1):
        (log / f"{n:020d}.json").unlink()
    assert at(1) == [(1, "v1", "2024-01-01"), (2, "v2", "2024-01-01"), (3, "v3", "2024-01-02")]
    assert at() == [(3, "v3", "2024-01-02"), (4, "v4", None), (5, "v5", None)]


def delta_table(spark, path, commits, schema, by=("day",), settings=None, protocol=None):
    """A table whose files and log entries are given: commits of (path, ids, values) to add, or a path to remove."""
    log = path / "_delta_log"
    log.mkdir(parents=True)
    fields = [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in schema]
    for n, commit in enumerate(commits):
        actions = []
        if n == 0:
            actions = [{"protocol": protocol or {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": {"id": "x", "schemaString": json.dumps({"type": "struct", "fields": fields}), "partitionColumns": list(by), "configuration": settings or {}}}]
        for what in commit:
            if isinstance(what, str):
                actions.append({"remove": {"path": what, "dataChange": True}})
                continue
            name, ids, values, *more = what
            target = path / urllib.parse.unquote(name)
            if not target.exists():
                target.parent.mkdir(parents=True, exist_ok=True)
                pq.write_table(pa.table({"id": pa.array(ids, pa.int64())}), target)
            actions.append({"add": {"path": name, "partitionValues": values, "size": 1, "dataChange": True} | (more[0] if more else {})})
        (log / f"{n:020d}.json").write_text("\n".join(map(json.dumps, actions)))
    return str(path)


SCHEMA = (("id", "long"), ("day", "string"))


@pytest.mark.parametrize("folders", [True, False])
def test_delta_files_of_one_name(spark, tmp_path, folders):
    """Equal base names in several folders, named for their values or not; values with special characters; added again after a removal."""
    place = (lambda d: "day=" + (d or "__HIVE_DEFAULT_PARTITION__").replace("%", "%25").replace(" ", "%20").replace("+", "%2B")) if folders else (lambda d: f"x{abs(len(d or ''))}")
    days = ["a", "b b", "c+dd", None]
    names = {d: f"{place(d)}/part-0.parquet" for d in days}
    commits = [[(names[d], [i, 10 + i], {"day": d}) for i, d in enumerate(days)], [names["a"]], [(names["a"], [0, 10], {"day": "a"})]]
    path = delta_table(spark, tmp_path / "t", commits, SCHEMA)
    rows = lambda v=None: sorted(((r["id"], r["day"]) for r in files.read_delta(spark, path, v).collect()), key=repr)
    want = sorted(((i + k, d) for i, d in enumerate(days) for k in (0, 10)), key=repr)
    assert rows() == rows(0) == want and rows(1) == [w for w in want if w[1] != "a"]
    plan = files.read_delta(spark, path).where("day = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert ("PartitionFilters: [isnotnull(day" in plan) == folders
    assert [r["id"] for r in files.read_delta(spark, path).where("day = 'b b'").orderBy("id").collect()] == [1, 11]


def test_delta_refuses_what_it_would_read_wrongly(spark, tmp_path):
    file = ("p.parquet", [1, 2], {})
    dv = {"deletionVector": {"storageType": "u", "pathOrInlineDv": "x", "sizeInBytes": 1, "cardinality": 1}}
    three = lambda *features: {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": list(features), "writerFeatures": []}
    made = lambda name, **how: delta_table(spark, tmp_path / name, how.pop("commits", [[file]]), SCHEMA[:1], by=(), **how)
    with pytest.raises(NotImplementedError, match="deletion vectors"):
        files.read_delta(spark, made("a", commits=[[(*file, dv)]], protocol=three("deletionVectors")))
    with pytest.raises(NotImplementedError, match="maps its columns"):
        files.read_delta(spark, made("b", settings={"delta.columnMapping.mode": "name"}, protocol={"minReaderVersion": 2, "minWriterVersion": 5}))
    with pytest.raises(NotImplementedError, match="v2Checkpoint"):
        files.read_delta(spark, made("c", protocol=three("v2Checkpoint")))
    with pytest.raises(FileNotFoundError):
        files.read_delta(spark, made("d"), version=-1)
    # the feature alone does no harm, nor do vectors of files that are gone
    ok = made("e", commits=[[(*file, dv)], ["p.parquet", ("q.parquet", [3], {})]], protocol=three("deletionVectors", "timestampNtz"))
    assert [r["id"] for r in files.read_delta(spark, ok).collect()] == [3]
    with pytest.raises(NotImplementedError):
        files.read_delta(spark, ok, version=0)


def test_shared_folder(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
            getConf = staticmethod(dict)  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(Elsewhere)
    assert shared.shared_uri(spark).startswith("file:")
    assert shared.arrow_store(shared.shared_uri(spark))[0].type_name == "local"
    assert shared.arrow_store("s3a://bucket/folder?region=us-east-1")[1] == "bucket/folder"
    with pytest.raises(ValueError, match="nosuch"):
        shared.arrow_store("nosuch://x/y")


@pytest.fixture(scope="module")
def stream_path(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stream") / "events.parquet"
    rows = [(i, START + dt.timedelta(minutes=i * 7), i % 5, "view" if i % 3 else "click", float(i)) for i in range(300)]
    spark.createDataFrame([*rows, rows[10]], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartitionByRange(4, "ts").write.parquet(str(path))
    return str(path)


def test_streams(spark, stream_path):
    batch = spark.read.parquet(stream_path)
    hourly = windows.settle(windows.tumbling(windows.events(spark, stream_path), "1 hour", ["event_type"]), mode="complete")
    want = windows.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", ["event_type"])
    assert sorted(map(tuple, hourly.collect())) == sorted(map(tuple, want.collect()))
    closed = windows.settle(windows.tumbling(windows.events(spark, stream_path), "1 hour", []))
    assert 0 < closed.count() < want.select("start").distinct().count() + 1
    assert windows.settle(windows.unique(windows.events(spark, stream_path), ["event_id"])).count() == 300
    slept = windows.settle(windows.sessions(windows.events(spark, stream_path), "40 minutes"), mode="append")
    assert set(slept.columns) == {"user_id", "start", "n"}
    last = lambda t: t.groupBy("user_id").agg(F.max("n").alias("n"))
    totals = windows.settle(windows.running_totals(windows.events(spark, stream_path, files_per_trigger=1)), mode="update", merge=last)
    assert {r["user_id"]: r["n"] for r in totals.collect()} == {r["user_id"]: r["count"] for r in batch.groupBy("user_id").count().collect()}


def test_stream_join(spark, stream_path):
    rows = windows.events(spark, stream_path)
    views = rows.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("a"))
    clicks = windows.events(spark, stream_path).where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("b"))
    got = windows.settle(windows.matched(views, clicks, "user_id", "1 hour").select("a.a", "b.b"))
    batch = spark.read.parquet(stream_path)
    want = ranges.within_time(batch.where("event_type = 'view'").selectExpr("user_id", "event_id AS a", "ts AS t"), batch.where("event_type = 'click'").selectExpr("user_id", "event_id AS b", "ts AS u"), "t", "u", "1 hour", ["user_id"])
    assert sorted(map(tuple, got.distinct().collect())) == sorted(map(tuple, want.select("a", "b").distinct().collect()))


def test_snapshot(spark, tmp_path):
    from siltstone.operators.results import Snapshot

    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    rows = Snapshot(spark.read.parquet(path).orderBy(F.desc("id")))
    spark.range(5).write.mode("append").parquet(path)
    assert [r["id"] for r in rows.fetch(3)] == [99, 98, 97]
    assert rows.skip(90) == 90
    assert [r["id"] for r in rows.fetch(1000)] == [6, 5, 4, 3, 2, 1, 0]
    assert rows.fetch() == []
