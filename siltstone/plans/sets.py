"""Set operations, distinct-on, pivots."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql_query("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql_query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT n_regionkey FROM nation")
sql_query("intersect_all", "SELECT l_linenumber AS k FROM lineitem INTERSECT ALL SELECT p_size FROM part")
sql_query("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT n_regionkey FROM nation")
sql_query("except_all", "SELECT p_size AS k FROM part EXCEPT ALL SELECT n_nationkey FROM nation")
sql_query(
    "topk_per_group",
    "SELECT o_custkey, o_orderkey, CAST(rn AS BIGINT) AS rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
)
sql_query(
    "distinct_on",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
)
sql_query(
    "pivot",
    "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(o_totalprice) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority",
)
sql_query(
    "unpivot",
    "SELECT l_orderkey, l_linenumber, name, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR name IN (l_discount, l_tax))",
    "SELECT l_orderkey, l_linenumber, name, v FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR name IN (l_discount, l_tax))",
)
