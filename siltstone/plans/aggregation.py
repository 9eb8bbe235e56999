"""Aggregates, grouping sets and ordered aggregates; products and estimates are in ``operators``."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query(
    "pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
sql_query("agg_global", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
sql_query("agg_group", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey")
sql_query("agg_basic", "SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_size), 6) AS a, min(p_size) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand")
sql_query("distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql_query("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, count(*) AS n FROM lineitem GROUP BY l_returnflag")
sql_query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND avg(o_totalprice) > 1000")
sql_query(
    "string_agg",
    "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
sql_query(
    "array_agg",
    "SELECT n_regionkey, array_join(transform(array_sort(collect_list(struct(n_name, n_nationkey))), x -> CAST(x.n_nationkey AS STRING)), ' ') AS keys FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, array_to_string(array_agg(n_nationkey ORDER BY n_name), ' ') AS keys FROM nation GROUP BY n_regionkey",
)
sql_query("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS done FROM orders GROUP BY o_custkey")
sql_query(
    "grouping_sets",
    "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS BIGINT) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
)
sql_query("rollup", "SELECT l_returnflag, l_linenumber, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linenumber)")
sql_query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql_query("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
sql_query(
    "agg_stats",
    """
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_tax), 8) AS sp, round(var_samp(l_tax), 8) AS vs,
           round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs
    FROM lineitem GROUP BY l_returnflag
    """,
)
sql_query(
    "agg_moments",
    "SELECT l_linestatus, round(kurtosis(l_quantity), 5) AS k FROM lineitem GROUP BY l_linestatus",
    "SELECT l_linestatus, round(kurtosis_pop(l_quantity), 5) AS k FROM lineitem GROUP BY l_linestatus",
)
sql_query(
    "agg_regression",
    "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS cut, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_linestatus",
    "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS cut, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_linestatus",
)
sql_query("median", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS m, mode(o_orderpriority) AS mo FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY o_orderstatus")
sql_query(
    "quantile",
    "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, percentile_disc(0.9) WITHIN GROUP (ORDER BY o_totalprice) AS d9 FROM orders GROUP BY o_orderstatus",
)
sql_query("arg_minmax", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey",
          "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS low FROM orders GROUP BY o_custkey")
sql_query("any_value", "SELECT l_returnflag, any_value(CASE WHEN l_returnflag = 'A' THEN 'a' ELSE 'other' END) AS v FROM lineitem GROUP BY l_returnflag")
sql_query("agg_bool", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_big, bool_or(o_orderstatus = 'P') AS some_p FROM orders GROUP BY o_custkey")
sql_query("agg_bit", "SELECT l_returnflag, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo, bit_xor(l_orderkey) AS bx FROM lineitem GROUP BY l_returnflag")
sql_query("count_if", "SELECT l_returnflag, CAST(count_if(l_discount > 0.05) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
sql_query("geometric_mean", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 5) AS g, round(sum(p_retailprice * p_size) / sum(p_size), 5) AS w FROM part GROUP BY p_brand", "SELECT p_brand, round(geomean(p_retailprice), 5) AS g, round(sum(p_retailprice * p_size) / sum(p_size), 5) AS w FROM part GROUP BY p_brand")
sql_query("sem", "SELECT o_orderstatus, round(stddev_pop(o_totalprice) / sqrt(count(o_totalprice)), 5) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(sem(o_totalprice), 5) AS s FROM orders GROUP BY o_orderstatus")
sql_query(
    "histogram",
    "SELECT l_returnflag, array_join(transform(array_sort(collect_list(struct(l_linenumber, n))), x -> concat(x.l_linenumber, ':', x.n)), ' ') AS h FROM (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_returnflag",
    "SELECT l_returnflag, array_to_string(list_transform(map_entries(histogram(l_linenumber)), lambda e: e.key || ':' || e.value), ' ') AS h FROM lineitem GROUP BY l_returnflag",
)
sql_query(
    "entropy",
    "SELECT o_orderstatus, round(-sum(p * log2(p)), 6) AS e FROM (SELECT o_orderstatus, n / sum(n) OVER (PARTITION BY o_orderstatus) AS p FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) GROUP BY o_orderstatus",
    "SELECT o_orderstatus, round(entropy(o_orderpriority), 6) AS e FROM orders GROUP BY o_orderstatus",
)
sql_query("agg_distinct_sum", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
