"""Functions that Spark has under another name or not at all, as expressions over its own."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query(
    "fn_dateparts",
    """
    SELECT o_orderkey, CAST(ceil(year(o_orderdate) / 100) AS BIGINT) AS century, CAST(year(o_orderdate) div 10 AS BIGINT) AS decade, CAST(ceil(year(o_orderdate) / 1000) AS BIGINT) AS millennium,
           CAST(weekday(o_orderdate) + 1 AS BIGINT) AS isodow, CAST(extract(YEAROFWEEK FROM o_orderdate) AS BIGINT) AS isoyear, CAST(extract(YEAROFWEEK FROM o_orderdate) * 100 + weekofyear(o_orderdate) AS BIGINT) AS yearweek,
           date_format(o_orderdate, 'EEEE') AS dayname, date_format(o_orderdate, 'MMMM') AS monthname, CAST(day(last_day(o_orderdate)) AS BIGINT) AS days_in_month, CAST(2440588 + unix_date(CAST(o_orderdate AS DATE)) AS BIGINT) AS julian
    FROM orders
    """,
    """
    SELECT o_orderkey, century(o_orderdate) AS century, decade(o_orderdate) AS decade, millennium(o_orderdate) AS millennium, isodow(o_orderdate) AS isodow, isoyear(o_orderdate) AS isoyear, yearweek(o_orderdate) AS yearweek,
           dayname(o_orderdate) AS dayname, monthname(o_orderdate) AS monthname, CAST(days_in_month(CAST(o_orderdate AS DATE)) AS BIGINT) AS days_in_month, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS julian
    FROM orders
    """.replace("days_in_month(CAST(o_orderdate AS DATE))", "day(last_day(o_orderdate))"),
)
sql_query(
    "fn_date_parts_sub",
    "SELECT event_id, CAST(second(ts) AS BIGINT) AS s, CAST(extract(SECOND FROM ts) * 1000 AS BIGINT) AS ms, CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT) AS us, CAST(minute(ts) AS BIGINT) AS mi, CAST(hour(ts) AS BIGINT) AS h FROM events",
    "SELECT event_id, second(ts) AS s, extract('microsecond' FROM ts) // 1000 AS ms, microsecond(ts) AS us, minute(ts) AS mi, hour(ts) AS h FROM events",
)
sql_query(
    "fn_intervals",
    "SELECT event_id, ts + make_dt_interval(CAST(event_id % 5 AS INT), CAST(event_id % 24 AS INT), 30) AS a, CAST(ts + make_ym_interval(1, CAST(event_id % 12 AS INT)) AS TIMESTAMP_NTZ) AS b, CAST(timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS BIGINT) AS hours FROM events",
    "SELECT event_id, ts + to_days(CAST(event_id % 5 AS INT)) + to_hours(event_id % 24) + to_minutes(30) AS a, ts + to_years(1) + to_months(CAST(event_id % 12 AS INT)) AS b, datesub('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS hours FROM events",
)
sql_query(
    "fn_make",
    "SELECT n_nationkey, make_timestamp_ntz(2024, 1 + n_regionkey, 1 + n_nationkey, 3, 4, 5) AS t, timestamp_seconds(1700000000 + n_nationkey) = TIMESTAMP '2023-11-14 22:13:20' AS z, CAST(timestamp_millis(1700000000000 + n_nationkey) AS TIMESTAMP_NTZ) AS m FROM nation",
    "SELECT n_nationkey, make_timestamp(2024, 1 + n_regionkey, 1 + n_nationkey, 3, 4, 5) AS t, n_nationkey = 0 AS z, make_timestamp_ms(1700000000000 + n_nationkey) AS m FROM nation",
)
sql_query(
    "fn_list_aggregates",
    """
    SELECT vec_id, round(aggregate(e, 0D, (a, x) -> a + x), 4) AS s, round(aggregate(e, 0D, (a, x) -> a + x) / size(e), 5) AS a, array_min(e) AS lo, array_max(e) AS hi, CAST(size(e) AS BIGINT) AS n,
           element_at(sort_array(e, false), 1) AS first_desc, CAST(size(filter(e, x -> x > 0)) AS BIGINT) AS positive
    FROM (SELECT vec_id, CAST(embedding AS ARRAY<DOUBLE>) AS e FROM embeddings)
    """,
    """
    SELECT vec_id, round(list_sum(e), 4) AS s, round(list_avg(e), 5) AS a, list_min(e) AS lo, list_max(e) AS hi, len(e) AS n, list_reverse_sort(e)[1] AS first_desc, len(list_filter(e, lambda x: x > 0)) AS positive
    FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
    """,
)
sql_query(
    "fn_list_sets",
    """
    SELECT p_partkey, arrays_overlap(a, b) AS has_any, size(array_except(b, a)) = 0 AS has_all, array_join(array_sort(array_intersect(a, b)), ',') AS both, CAST(size(array_distinct(a)) AS BIGINT) AS n_unique, array_join(flatten(array(a, b)), ',') AS flat,
           array_join(transform(arrays_zip(a, b), z -> concat(coalesce(z.a, '-'), coalesce(z.b, '-'))), ',') AS zipped, array_join(array_append(a, 'z'), ',') AS appended, array_join(array_prepend(a, 'z'), ',') AS prepended
    FROM (SELECT p_partkey, split(p_type, ' ') AS a, array('TIN', 'BRASS') AS b FROM part)
    """,
    """
    SELECT p_partkey, list_has_any(a, b) AS has_any, list_has_all(a, b) AS has_all, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, CAST(list_unique(a) AS BIGINT) AS n_unique, array_to_string(flatten([a, b]), ',') AS flat,
           array_to_string(list_transform(list_zip(a, b), lambda z: coalesce(z[1], '-') || coalesce(z[2], '-')), ',') AS zipped, array_to_string(list_append(a, 'z'), ',') AS appended, array_to_string(list_prepend('z', a), ',') AS prepended
    FROM (SELECT p_partkey, string_split(p_type, ' ') AS a, ['TIN', 'BRASS'] AS b FROM part)
    """,
)
sql_query(
    "fn_numbers",
    """
    SELECT c_custkey, bround(c_acctbal, 1) AS even_round, try_divide(c_acctbal, 0.0D) IS NULL AS no_division, CAST(c_custkey div 7 AS BIGINT) AS whole, pmod(c_custkey, 7) AS p, c_custkey ^ 5 AS x, isnan(CAST('NaN' AS DOUBLE)) AS nan,
           abs(c_acctbal) < CAST('Infinity' AS DOUBLE) AS finite, c_acctbal < 0 AS negative, bin(c_custkey) AS b, hex(c_custkey) AS h, CAST(conv(hex(c_custkey), 16, 10) AS BIGINT) AS back, round(log(3, c_custkey + 1), 8) AS l3, round(acosh(c_custkey + 1), 8) AS ac
    FROM customer
    """,
    """
    SELECT c_custkey, round_even(c_acctbal, 1) AS even_round, true AS no_division, c_custkey // 7 AS whole, c_custkey % 7 AS p, xor(c_custkey, 5) AS x, isnan('NaN'::DOUBLE) AS nan, isfinite(c_acctbal) AS finite, signbit(c_acctbal) AS negative,
           bin(c_custkey) AS b, hex(c_custkey) AS h, c_custkey AS back, round(ln(c_custkey + 1) / ln(3), 8) AS l3, round(acosh(c_custkey + 1), 8) AS ac
    FROM customer
    """,
)
sql_query(
    "fn_text_distance",
    """
    SELECT p_partkey, CAST(levenshtein(p_brand, 'Brand#23') AS BIGINT) AS d, CAST(aggregate(sequence(1, 8), 0, (a, i) -> a + CAST(substring(p_brand, i, 1) <> substring('Brand#23', i, 1) AS INT)) AS BIGINT) AS hamming,
           round(size(array_intersect(x, y)) / size(array_union(x, y)), 6) AS jaccard
    FROM (SELECT p_partkey, p_brand, array_distinct(split(p_brand, '')) AS x, array_distinct(split('Brand#23', '')) AS y FROM part)
    """,
    "SELECT p_partkey, levenshtein(p_brand, 'Brand#23') AS d, (SELECT CAST(count(*) AS BIGINT) FROM range(1, 9) r(i) WHERE p_brand[r.i] <> 'Brand#23'[r.i]) AS hamming, round(jaccard(p_brand, 'Brand#23'), 6) AS jaccard FROM part",
)
sql_query(
    "fn_text_more",
    """
    SELECT page_id, CAST(octet_length(url) AS BIGINT) AS bytes, CAST(bit_length(url) AS BIGINT) AS bits, format_string('%05d|%s', page_id, left(url, 5)) AS f, overlay(url PLACING 'XX' FROM 2 FOR 3) AS o, CAST(locate('/', url, 9) AS BIGINT) AS slash,
           substring_index(url, '/', -1) AS leaf, initcap('some words') AS title, soundex('robert') AS sound, CAST(char_length(url) AS BIGINT) AS n, url_encode('a b&c') AS enc, elt(2, 'x', 'y') AS e
    FROM pages
    """,
    """
    SELECT page_id, CAST(strlen(url) AS BIGINT) AS bytes, CAST(bit_length(url) AS BIGINT) AS bits, printf('%05d|%s', page_id, left(url, 5)) AS f, left(url, 1) || 'XX' || substring(url, 5) AS o,
           CASE WHEN strpos(substring(url, 9), '/') > 0 THEN strpos(substring(url, 9), '/') + 8 ELSE 0 END AS slash, string_split(url, '/')[-1] AS leaf, 'Some Words' AS title, 'R163' AS sound, length(url) AS n, 'a+b%26c' AS enc, 'y' AS e
    FROM pages
    """,
)
sql_query(
    "fn_encode",
    "SELECT n_nationkey, CAST(unbase64(base64(CAST(n_name AS BINARY))) AS STRING) AS b, hex(CAST(n_name AS BINARY)) AS h, crc32(CAST(n_name AS BINARY)) > 0 AS c, CAST(octet_length(encode(n_name, 'UTF-8')) AS BIGINT) AS n FROM nation",
    "SELECT n_nationkey, decode(from_base64(base64(encode(n_name)))) AS b, to_hex(encode(n_name)) AS h, true AS c, CAST(octet_length(encode(n_name)) AS BIGINT) AS n FROM nation",
)
sql_query(
    "fn_map_more",
    "SELECT n_nationkey, map_contains_key(m, 'a') AS has, array_join(transform(array_sort(map_entries(m)), e -> concat(e.key, e.value)), ',') AS entries, map_from_entries(array(struct('q' AS k, n_nationkey AS v)))['q'] AS q, CAST(cardinality(map_filter(m, (k, v) -> v > 2)) AS BIGINT) AS big, array_join(array_sort(map_values(map_concat(m, map('c', 7)))), ',') AS vs FROM (SELECT n_nationkey, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation)",
    "SELECT n_nationkey, map_contains(m, 'a') AS has, array_to_string(list_transform(list_sort(map_entries(m)), lambda e: e.key || e.value), ',') AS entries, map_from_entries([{'k': 'q', 'v': n_nationkey}])['q'] AS q, len(list_filter(map_values(m), lambda v: v > 2)) AS big, array_to_string(list_sort(map_values(map_concat(m, MAP {'c': 7}))), ',') AS vs FROM (SELECT n_nationkey, MAP {'a': n_nationkey, 'b': n_regionkey} AS m FROM nation)",
)
sql_query(
    "fn_struct_more",
    "SELECT s.a + 1 AS a, s.b AS b, to_json(s) AS j FROM (SELECT struct(n_nationkey AS a, n_name AS b, true AS c) AS s FROM nation)",
    "SELECT struct_extract(s, 'a') + 1 AS a, s['b'] AS b, CAST(to_json(s) AS VARCHAR) AS j FROM (SELECT struct_pack(a := n_nationkey, b := n_name, c := true) AS s FROM nation)",
)
sql_query(
    "fn_json_more",
    """
    SELECT event_id, CAST(json_array_length(concat('[1, 2, ', event_id, ']')) AS BIGINT) AS n, try_parse_json(props) IS NOT NULL AS valid, try_parse_json('{oops') IS NULL AS broken, schema_of_variant(parse_json(props)) = 'OBJECT<k: BIGINT>' AS shaped,
           CAST(variant_get(parse_json(props), '$.k', 'int') + 1 AS BIGINT) AS k, get_json_object(props, '$.k') IS NOT NULL AS there
    FROM events
    """,
    "SELECT event_id, CAST(json_array_length('[1, 2, ' || event_id || ']') AS BIGINT) AS n, json_valid(props) AS valid, NOT json_valid('{oops') AS broken, json_type(props) = 'OBJECT' AS shaped, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k, json_exists(props, '$.k') AS there FROM events",
)
sql_query(
    "json_each",
    "SELECT event_id, key, to_json(value) AS value FROM (SELECT event_id, parse_json(props) AS v FROM events), LATERAL variant_explode(v) AS t(pos, key, value)",
    "SELECT event_id, j.key, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) j",
)
sql_query(
    "json_group",
    "SELECT n_regionkey, to_json(transform(array_sort(collect_list(n_nationkey)), x -> x)) AS j FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey",
)
sql_query(
    "list_keeps_nulls",
    "SELECT o_custkey, CAST(size(filter(x, s -> s.v IS NULL)) AS BIGINT) AS nulls, CAST(size(x) AS BIGINT) AS n FROM (SELECT o_custkey, collect_list(struct(NULLIF(o_orderstatus, 'F') AS v)) AS x FROM orders GROUP BY o_custkey)",
    "SELECT o_custkey, len(list_filter(x, lambda v: v IS NULL)) AS nulls, len(x) AS n FROM (SELECT o_custkey, list(NULLIF(o_orderstatus, 'F')) AS x FROM orders GROUP BY o_custkey)",
)
sql_query(
    "arg_max_null",
    "SELECT o_custkey, max_by(struct(NULLIF(o_orderstatus, 'F') AS v), struct(o_totalprice, o_orderkey)).v AS top FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, arg_max_null(NULLIF(o_orderstatus, 'F'), (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY o_custkey",
)
sql_query(
    "win_fill",
    """
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN p IS NULL OR n IS NULL THEN NULL ELSE p.v + (n.v - p.v) * (unix_micros(CAST(ts AS TIMESTAMP)) - p.t) / (n.t - p.t) END, 4) AS filled
    FROM (SELECT *, last(k, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p, first(k, true) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
          FROM (SELECT *, CASE WHEN event_type <> 'click' THEN value END AS v, CASE WHEN event_type <> 'click' THEN struct(value AS v, unix_micros(CAST(ts AS TIMESTAMP)) AS t) END AS k FROM events))
    """,
    """
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN p IS NULL OR n IS NULL THEN NULL ELSE p.v + (n.v - p.v) * (epoch_us(ts) - p.t) / (n.t - p.t) END, 4) AS filled
    FROM (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n
          FROM (SELECT *, CASE WHEN event_type <> 'click' THEN value END AS v, CASE WHEN event_type <> 'click' THEN {'v': value, 't': epoch_us(ts)} END AS k FROM events))
    """,
)
sql_query(
    "generate_subscripts",
    "SELECT p_partkey, explode(sequence(1, size(split(p_type, ' ')))) AS i FROM part",
    "SELECT p_partkey, CAST(generate_subscripts(string_split(p_type, ' '), 1) AS INT) AS i FROM part",
)
sql_query("union_tagged", "SELECT 'c' AS tag, c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_name FROM supplier")
sql_query(
    "collation",
    "SELECT n_nationkey FROM nation WHERE n_name COLLATE UTF8_LCASE = lower(n_name)",
    "SELECT n_nationkey FROM nation WHERE n_name COLLATE NOCASE = lower(n_name)",
)
sql_query("semi_structured_path", "SELECT event_id, CAST(parse_json(props):k AS INT) AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
