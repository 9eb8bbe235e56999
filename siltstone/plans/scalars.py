"""Scalar functions by family; where the two dialects differ, the Spark side is the adapted one."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 8) AS s, power(c_custkey, 2) AS p, round(ln(c_custkey + 1), 8) AS l, round(log10(c_custkey + 1), 8) AS l10, round(log2(c_custkey + 1), 8) AS l2, CAST(sign(c_acctbal) AS INT) AS g, c_custkey % 7 AS m, round(cbrt(c_custkey), 8) AS cb, round(exp(c_custkey / 1000.0D), 6) AS e FROM customer",
          "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 8) AS s, power(c_custkey, 2) AS p, round(ln(c_custkey + 1), 8) AS l, round(log(c_custkey + 1), 8) AS l10, round(log2(c_custkey + 1), 8) AS l2, CAST(sign(c_acctbal) AS INT) AS g, c_custkey % 7 AS m, round(cbrt(c_custkey), 8) AS cb, round(exp(c_custkey / 1000.0::DOUBLE), 6) AS e FROM customer")
sql_query("fn_trig", "SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0D), 8) AS a, round(acos(p_size / 100.0D), 8) AS o, round(atan(p_size), 8) AS n, round(atan2(p_size, p_partkey), 8) AS n2, round(degrees(p_size), 6) AS d, round(radians(p_size), 8) AS r, round(sinh(p_size / 10.0D), 6) AS h, round(pi(), 8) AS pi FROM part",
          "SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0::DOUBLE), 8) AS a, round(acos(p_size / 100.0::DOUBLE), 8) AS o, round(atan(p_size), 8) AS n, round(atan2(p_size, p_partkey), 8) AS n2, round(degrees(p_size), 6) AS d, round(radians(p_size), 8) AS r, round(sinh(p_size / 10.0::DOUBLE), 6) AS h, round(pi(), 8) AS pi FROM part")
sql_query("fn_bits", "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1024 AS o, CAST(bit_count(o_orderkey) AS INT) AS n, shiftright(o_orderkey, 3) AS r, factorial(CAST(o_orderkey % 10 AS INT)) AS f FROM orders",
          "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1024 AS o, CAST(bit_count(o_orderkey) AS INT) AS n, o_orderkey >> 3 AS r, CAST(factorial(CAST(o_orderkey % 10 AS INT)) AS BIGINT) AS f FROM orders")
sql_query(
    "fn_string",
    "SELECT c_custkey, concat_ws('', c_name, NULL, c_mktsegment) AS c, CAST(length(c_name) AS BIGINT) AS n, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim('  x ') AS t, ltrim(concat(' ', c_name)) AS lt, rtrim(concat(c_name, ' ')) AS rt, substring(c_name, 2, 4) AS s, replace(c_mktsegment, 'U', '_') AS r, reverse(c_name) AS v FROM customer",
    "SELECT c_custkey, concat(c_name, NULL, c_mktsegment) AS c, length(c_name) AS n, lower(c_name) AS lo, upper(c_mktsegment) AS up, trim('  x ') AS t, ltrim(' ' || c_name) AS lt, rtrim(c_name || ' ') AS rt, substring(c_name, 2, 4) AS s, replace(c_mktsegment, 'U', '_') AS r, reverse(c_name) AS v FROM customer",
)
sql_query("fn_split_part", "SELECT DISTINCT o_orderpriority, split_part(o_orderpriority, '-', 1) AS a, split_part(o_orderpriority, '-', 2) AS b, split_part(o_orderpriority, '-', 9) AS z FROM orders")
sql_query("fn_left_right", "SELECT p_partkey, left(p_name, 3) AS l, right(p_name, 4) AS r FROM part")
sql_query(
    "fn_string2",
    "SELECT p_partkey, CAST(levenshtein(p_brand, p_type) AS BIGINT) AS d, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(p_brand, 2) AS re, translate(p_brand, 'Bra', 'bRA') AS tr, startswith(p_brand, 'Brand#1') AS st, endswith(p_brand, '1') AS en, CAST(instr(p_name, 'a') AS BIGINT) AS po, CAST(ascii(p_name) AS INT) AS a, chr(65 + p_size % 26) AS ch, contains(p_name, 'e') AS co FROM part",
    "SELECT p_partkey, levenshtein(p_brand, p_type) AS d, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-') AS rp, repeat(p_brand, 2) AS re, translate(p_brand, 'Bra', 'bRA') AS tr, starts_with(p_brand, 'Brand#1') AS st, ends_with(p_brand, '1') AS en, instr(p_name, 'a') AS po, ascii(p_name) AS a, chr(65 + p_size % 26) AS ch, contains(p_name, 'e') AS co FROM part",
)
sql_query(
    "fn_hash",
    "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha2(n_name, 256) AS s2, hex(n_name) AS h, base64(CAST(n_name AS BINARY)) AS b, CAST(unhex(hex(n_name)) AS STRING) AS u FROM nation",
    "SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s2, hex(n_name) AS h, base64(encode(n_name)) AS b, decode(unhex(hex(n_name))) AS u FROM nation",
)
sql_query(
    "fn_regex",
    "SELECT o_orderkey, regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2) AS e, regexp_replace(o_orderpriority, '[A-Z]', 'x') AS r, o_orderpriority RLIKE '^(?:[0-9]-[A-Z]+)$' AS f FROM orders",
    "SELECT o_orderkey, regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2) AS e, regexp_replace(o_orderpriority, '[A-Z]', 'x', 'g') AS r, regexp_full_match(o_orderpriority, '[0-9]-[A-Z]+') AS f FROM orders",
)
sql_query(
    "regexp_extract_all",
    "SELECT doc_id, array_join(regexp_extract_all(text, '[a-z]{3,}', 0), ' ') AS w FROM documents",
    "SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-z]{3,}'), ' ') AS w FROM documents",
)
sql_query("fn_split", "SELECT p_partkey, array_join(split(p_type, ' '), '|') AS w, CAST(size(split(p_type, ' ')) AS BIGINT) AS n FROM part", "SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|') AS w, len(string_split(p_type, ' ')) AS n FROM part")
sql_query("fn_url", "SELECT page_id, url_decode(url_encode(url)) AS u, parse_url(url, 'HOST') AS h FROM pages", "SELECT page_id, url AS u, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS h FROM pages")
# dates and times
sql_query("age_days", "SELECT o_orderkey, CAST(datediff(DATE '2020-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders", "SELECT o_orderkey, DATE '2020-01-01' - CAST(o_orderdate AS DATE) AS days FROM orders")
sql_query("reg_cast", "SELECT CAST('pg_class' AS STRING) AS r, CAST(n_name AS STRING) AS t FROM nation", "SELECT CAST('pg_class' AS VARCHAR) AS r, CAST(n_name AS VARCHAR) AS t FROM nation")
sql_query(
    "fn_date_trunc",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('week', o_orderdate) AS DATE) AS w, CAST(date_trunc('year', o_orderdate) AS DATE) AS y FROM orders",
)
sql_query(
    "fn_extract",
    "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(dayofweek(o_orderdate) - 1 AS BIGINT) AS dow, CAST(dayofyear(o_orderdate) AS BIGINT) AS doy, CAST(weekofyear(o_orderdate) AS BIGINT) AS wk, CAST(extract(HOUR FROM o_orderdate) AS BIGINT) AS h FROM orders",
    "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, extract(QUARTER FROM o_orderdate) AS q, extract(MONTH FROM o_orderdate) AS m, extract(DAY FROM o_orderdate) AS d, dayofweek(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS wk, extract(HOUR FROM o_orderdate) AS h FROM orders",
)
sql_query(
    "fn_date_arith",
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate - INTERVAL 10 DAYS AS DATE) AS b, last_day(o_orderdate) AS c, date_add(CAST(o_orderdate AS DATE), 7) AS d, make_date(2024, 2, CAST(day(o_orderdate) % 28 + 1 AS INT)) AS e FROM orders",
    "SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS a, CAST(o_orderdate - INTERVAL 10 DAYS AS DATE) AS b, last_day(o_orderdate) AS c, CAST(o_orderdate AS DATE) + 7 AS d, make_date(2024, 2, day(o_orderdate) % 28 + 1) AS e FROM orders",
)
sql_query(
    "fn_date_diff",
    "SELECT o_orderkey, CAST(datediff(DATE '1999-12-31', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, CAST((1999 - year(o_orderdate)) * 12 + 12 - month(o_orderdate) AS BIGINT) AS months, CAST(1999 - year(o_orderdate) AS BIGINT) AS years FROM orders",
    "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-12-31') AS days, date_diff('month', o_orderdate, TIMESTAMP '1999-12-31') AS months, date_diff('year', o_orderdate, TIMESTAMP '1999-12-31') AS years FROM orders",
)
sql_query(
    "fn_epoch",
    "SELECT event_id, CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS BIGINT) AS s, unix_millis(CAST(ts AS TIMESTAMP)) AS ms, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us FROM events",
)
sql_query(
    "fn_timezone",
    "SELECT event_id, CAST(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/New_York') AS TIMESTAMP_NTZ) AS ny FROM events",
    "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events",
)
sql_query(
    "fn_time_bucket",
    "SELECT event_id, CAST(timestamp_seconds(unix_seconds(CAST(ts AS TIMESTAMP)) div 900 * 900) AS TIMESTAMP_NTZ) AS b FROM events",
    "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS b FROM events",
)
# nested values
sql_query(
    "fn_array",
    "SELECT p_partkey, CAST(size(a) AS BIGINT) AS n, element_at(a, 1) AS f, array_contains(a, 'TIN') AS t, array_join(array_sort(a), ' ') AS s, array_join(slice(a, 2, 2), ' ') AS sl, CAST(array_position(a, try_element_at(a, -1)) AS INT) AS p, array_join(array_distinct(concat(a, a)), ' ') AS d, array_join(reverse(a), ' ') AS r FROM (SELECT p_partkey, split(p_type, ' ') AS a FROM part)",
    "SELECT p_partkey, len(a) AS n, a[1] AS f, list_contains(a, 'TIN') AS t, array_to_string(list_sort(a), ' ') AS s, array_to_string(a[2:3], ' ') AS sl, CAST(list_position(a, a[-1]) AS INT) AS p, array_to_string(list_filter(list_concat(a, a), lambda x, i: list_position(list_concat(a, a), x) = i), ' ') AS d, array_to_string(list_reverse(a), ' ') AS r FROM (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part)",
)
sql_query(
    "fn_lambda",
    "SELECT n_nationkey, array_join(transform(sequence(1, n_regionkey + 2), x -> x * n_nationkey), ',') AS t, array_join(filter(sequence(1, 9), x -> x % 3 = n_regionkey % 3), ',') AS f, CAST(aggregate(sequence(1, n_nationkey + 1), 0, (a, x) -> a + x) AS BIGINT) AS s, exists(sequence(1, 5), x -> x = n_regionkey) AS e FROM nation",
    "SELECT n_nationkey, array_to_string(list_transform(range(1, n_regionkey + 3), lambda x: x * n_nationkey), ',') AS t, array_to_string(list_filter(range(1, 10), lambda x: x % 3 = n_regionkey % 3), ',') AS f, CAST(list_sum(range(1, n_nationkey + 2)) AS BIGINT) AS s, list_contains(range(1, 6), n_regionkey) AS e FROM nation",
)
sql_query("unnest", "SELECT doc_id, w FROM (SELECT doc_id, explode(split(text, ' ')) AS w FROM documents)", "SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents")
sql_query(
    "unnest_ordinality",
    "SELECT p_partkey, CAST(i + 1 AS BIGINT) AS i, w FROM (SELECT p_partkey, posexplode(split(p_type, ' ')) AS (i, w) FROM part)",
    "SELECT p_partkey, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w FROM (SELECT p_partkey, string_split(p_type, ' ') AS a FROM part)",
)
sql_query(
    "fn_struct",
    "SELECT s.k AS k, s.v AS v, s.n.x AS x FROM (SELECT named_struct('k', n_nationkey, 'v', n_name, 'n', named_struct('x', n_regionkey + 1)) AS s FROM nation)",
    "SELECT s.k AS k, s.v AS v, s.n.x AS x FROM (SELECT {'k': n_nationkey, 'v': n_name, 'n': {'x': n_regionkey + 1}} AS s FROM nation)",
)
sql_query(
    "fn_map",
    "SELECT n_nationkey, try_element_at(m, 'b') AS b, try_element_at(m, 'z') AS z, CAST(cardinality(m) AS BIGINT) AS n, array_join(array_sort(map_keys(m)), ',') AS k FROM (SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation)",
    "SELECT n_nationkey, m['b'] AS b, m['z'] AS z, CAST(cardinality(m) AS BIGINT) AS n, array_to_string(list_sort(map_keys(m)), ',') AS k FROM (SELECT n_nationkey, MAP {'a': n_nationkey, 'b': n_regionkey} AS m FROM nation)",
)
sql_query(
    "fn_json",
    "SELECT event_id, get_json_object(props, '$.k') AS k, CAST(get_json_object(props, '$.k') AS BIGINT) AS n, from_json(props, 'k INT').k AS f, get_json_object(props, '$.none') AS z, array_join(json_object_keys(props), ',') AS ks FROM events",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS n, CAST(props->>'k' AS INT) AS f, json_extract_string(props, '$.none') AS z, array_to_string(json_keys(props), ',') AS ks FROM events",
)
sql_query(
    "fn_json_build",
    "SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'v', n_name)) AS j, variant_get(parse_json(concat('[', n_nationkey, ']')), '$[0]', 'int') AS v FROM nation",
    "SELECT n_nationkey, CAST(to_json({'k': n_nationkey, 'v': n_name}) AS VARCHAR) AS j, CAST(json_extract('[' || n_nationkey || ']', '$[0]') AS INT) AS v FROM nation",
)
sql_query(
    "geo_haversine",
    "SELECT event_id, round(2 * 6371 * asin(sqrt(power(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * power(sin(radians(d - c) / 2), 2))), 4) AS km FROM (SELECT event_id, user_id % 180 - 90 AS a, event_id % 180 - 90 AS b, user_id % 360 - 180 AS c, event_id % 360 - 180 AS d FROM events)",
)
sql_query(
    "vec_cosine",
    "SELECT vec_id, round(d / (n * m), 5) AS c FROM (SELECT a.vec_id, aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v) AS d, sqrt(aggregate(a.embedding, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)) AS n, sqrt(aggregate(b.embedding, 0D, (s, v) -> s + CAST(v AS DOUBLE) * v)) AS m FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)",
    "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS c FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b",
)
sql_query(
    "vec_distance",
    "SELECT a.vec_id, round(sqrt(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> power(CAST(x AS DOUBLE) - y, 2)), 0D, (s, v) -> s + v)), 5) AS d, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, v) -> s + v), 5) AS p FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b",
    "SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS p FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b",
)
