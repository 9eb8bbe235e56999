"""Projection, predicates, subqueries and row sources."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query("project", "SELECT l_orderkey, l_quantity FROM lineitem")
sql_query("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
sql_query("star_except", "SELECT * EXCEPT (c_name, c_acctbal) FROM customer", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
sql_query("filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
sql_query("filter_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 49) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
sql_query("filter_between", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql_query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_name NOT LIKE 'x!_%' ESCAPE '!'")
sql_query("filter_ilike", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE '%BUILD%' OR c_name ILIKE 'customer%1'")
sql_query("filter_regex", "SELECT p_partkey, p_name FROM part WHERE p_name RLIKE '^[a-m].*[0-9]$'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*[0-9]$')")
sql_query("filter_null", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS status FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL OR NULLIF(o_orderpriority, '1-URGENT') IS NOT NULL")
sql_query("is_distinct_from", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS DISTINCT FROM 'O'")
sql_query(
    "case_when",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'large' END AS band, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS is_open FROM orders",
)
sql_query(
    "cast_types",
    "SELECT l_orderkey, l_linenumber, CAST(round(l_quantity) AS INT) AS qty, CAST(l_orderkey AS STRING) AS k, CAST(l_shipdate AS DATE) AS d, CAST(l_discount AS DECIMAL(10, 2)) AS disc, CAST('12' AS INT) + 1 AS n FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CAST(round(l_quantity) AS INT) AS qty, CAST(l_orderkey AS VARCHAR) AS k, CAST(l_shipdate AS DATE) AS d, CAST(l_discount AS DECIMAL(10, 2)) AS disc, CAST('12' AS INT) + 1 AS n FROM lineitem",
)
sql_query("try_cast", "SELECT DISTINCT try_cast(split_part(o_orderpriority, '-', 1) AS INT) AS n, try_cast(o_orderpriority AS INT) AS none FROM orders")
sql_query("pg_cast", "SELECT c_custkey, c_acctbal::int AS whole, c_custkey::string AS k FROM customer", "SELECT c_custkey, trunc(c_acctbal)::int AS whole, c_custkey::text AS k FROM customer")
sql_query("coalesce_nullif", "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'O'), 'open') AS status, ifnull(NULLIF(o_custkey, 1), -1) AS cust FROM orders", "SELECT o_orderkey, coalesce(NULLIF(o_orderstatus, 'O'), 'open') AS status, ifnull(NULLIF(o_custkey, 1), -1) AS cust FROM orders")
sql_query("greatest_least", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax, NULL) AS hi, least(l_discount, l_tax) AS lo FROM lineitem")
sql_query("subquery_scalar", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql_query("subquery_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
sql_query("subquery_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql_query("subquery_in", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query(
    "subquery_correlated",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l.l_partkey)",
)
sql_query("cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12), named AS (SELECT c_name, n FROM big JOIN customer ON c_custkey = o_custkey) SELECT c_name, n FROM named")
sql_query("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")
sql_query(
    "lateral_join",
    "SELECT c_custkey, top.o_orderkey FROM customer, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = c_custkey) top WHERE c_nationkey = 3",
)
sql_query("values_scan", "SELECT k, upper(v) AS v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)")
sql_query("generate_series", "SELECT id AS i, id * 2 AS d, id * 3 AS t FROM range(1, 500001)", "SELECT i, i * 2 AS d, i * 3 AS t FROM generate_series(1, 500000) s(i)")
sql_query("generate_series_step", "SELECT explode(sequence(10, 100, 7)) AS i", "SELECT CAST(i AS INT) AS i FROM generate_series(10, 100, 7) s(i)")
sql_query("sort_nulls", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey")
sql_query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
sql_query("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
