"""Window functions and frames, and event-time windows over a static table."""

from __future__ import annotations

from siltstone.plans.catalog import sql_query

sql_query(
    "win_rank",
    """
    SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk,
           CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)
    """,
)
sql_query("win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer")
sql_query(
    "win_lag_lead",
    "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, lag(event_type, 1, 'none') OVER w AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
sql_query(
    "win_first_last",
    """
    SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS s, first_value(NULLIF(event_type, 'view')) IGNORE NULLS OVER w AS k
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
    """
    SELECT event_id, first_value(value) OVER w AS f, last_value(value) OVER w AS l, nth_value(value, 2) OVER w AS s, first_value(NULLIF(event_type, 'view') IGNORE NULLS) OVER w AS k
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
sql_query("win_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS s FROM events")
sql_query("win_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events")
sql_query(
    "win_groups",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS g FROM orders)",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
)
sql_query(
    "win_filter",
    "SELECT event_id, count(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clicks FROM events",
    "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clicks FROM events",
)
sql_query(
    "win_exclude",
    """
    SELECT event_id, CASE WHEN n > IF(v IS NULL, 0, 1) THEN round(s - coalesce(v, 0), 4) END AS others FROM (
      SELECT event_id, v, sum(v) OVER w AS s, count(v) OVER w AS n FROM (SELECT *, CASE WHEN event_type <> 'view' THEN value END AS v FROM events)
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    """,
    "SELECT event_id, round(sum(CASE WHEN event_type <> 'view' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), 4) AS others FROM events",
)
sql_query(
    "qualify",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
)
sql_query("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
sql_query("win_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 5) AS a FROM events")
sql_query("win_named", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER w, 4) AS off, max(c_custkey) OVER w AS top FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
sql_query("win_share", "SELECT s_suppkey, round(s_acctbal / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier")
sql_query(
    "win_tumbling",
    "SELECT w.start AS start, event_type, n, s FROM (SELECT window(ts, '1 hour') AS w, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2)",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1, 2",
)
sql_query(
    "win_sliding",
    "SELECT w.start AS start, n FROM (SELECT window(ts, '1 hour', '30 minutes') AS w, count(*) AS n FROM events GROUP BY 1)",
    "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY start",
)
sql_query(
    "win_session",
    "SELECT user_id, w.start AS start, n FROM (SELECT user_id, session_window(ts, '10 minutes') AS w, count(*) AS n FROM events GROUP BY 1, 2)",
    """
    SELECT user_id, min(ts) AS start, count(*) AS n FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events))
    GROUP BY user_id, s
    """,
)
