"""Joins that SQL has of its own; the others are in ``operators``."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000")
sql_query("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'")
sql_query("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 3")
sql_query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
sql_query("join_using", "SELECT k, n, o FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) JOIN (SELECT r_regionkey AS k, r_name AS o FROM region) USING (k)")
sql_query("join_natural", "SELECT k, n, o FROM (SELECT n_regionkey AS k, n_name AS n FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name AS o FROM region)")
sql_query("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
sql_query("join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
sql_query("join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
sql_query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey")
sql_query("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
sql_query(
    "join_star5",
    """
    SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n_name
    """,
)
sql_query(
    "shipping_priority",
    """
    SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 50
    """,
)
