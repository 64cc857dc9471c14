"""Queries written as scripts of the SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.eventtime import MS, SESSIONS, TOTAL
from millrace.plans.registry import query
from millrace.session import Engine
from millrace.storage import new_path

# The columns of the tables that the scripts declare.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type TEXT, value DOUBLE, props TEXT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus TEXT, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority TEXT",
    "customer": "c_custkey BIGINT, c_name TEXT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment TEXT",
    "nation": "n_nationkey INT, n_name TEXT, n_regionkey INT",
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    for name, columns in TABLES.items():
        e.execute(f"CREATE TABLE {name} ({columns}) WITH (connector='parquet', path='{sf_dir}/{name}.parquet')")
    return e


def script(name: str, sql: str, oracle: str, before: str = ""):
    @query(f"sql_{name}", oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir)
        if before:
            e.run_script(before)
        return e.query(sql)

    return run


script("filter_project", "SELECT o_orderkey, upper(o_orderpriority) AS p FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'", "SELECT o_orderkey, upper(o_orderpriority) AS p FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'")
script("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey HAVING count(*) > 2", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey HAVING count(*) > 2")
script("derived_table", "SELECT s.k, max(s.n) AS m FROM (SELECT c_nationkey AS k, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) s GROUP BY s.k", "SELECT s.k, max(s.n) AS m FROM (SELECT c_nationkey AS k, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) s GROUP BY s.k")
script("view", "SELECT n_name, n FROM per_nation WHERE n > 5", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 5", "CREATE VIEW per_nation(n_name, n) AS SELECT n_name, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
script("function", "SELECT o_orderkey, with_tax(o_totalprice) AS t FROM orders", "SELECT o_orderkey, o_totalprice * 1.5 AS t FROM orders", "CREATE FUNCTION with_tax(x DOUBLE) RETURNS DOUBLE LANGUAGE SQL AS $$ x * CAST(1.5 AS DOUBLE) $$")
script("tumble", f"SELECT event_type, window_start, window_end, count(*) AS n, {TOTAL} FROM events GROUP BY TUMBLE(ts, INTERVAL '1' HOUR), event_type", f"SELECT event_type, {MS} // 3600000 * 3600000 AS window_start, {MS} // 3600000 * 3600000 + 3600000 AS window_end, count(*) AS n, {TOTAL} FROM events GROUP BY 1, 2, 3")
script("hop", "SELECT window_start, window_end, count(*) AS n FROM events GROUP BY HOP(ts, INTERVAL '1' HOUR, INTERVAL '30' MINUTE)", f"SELECT s AS window_start, s + 3600000 AS window_end, count(*) AS n FROM (SELECT *, unnest([{MS} // 1800000 * 1800000, {MS} // 1800000 * 1800000 - 1800000]) AS s FROM events) GROUP BY 1, 2")
script("session", "SELECT user_id, window_start, window_end, count(*) AS n FROM events GROUP BY SESSION(ts, INTERVAL '30' MINUTE), user_id", SESSIONS)
script("cumulate", "SELECT window_start, window_end, count(*) AS n FROM events GROUP BY CUMULATE(ts, INTERVAL '15' MINUTE, INTERVAL '1' HOUR)", f"SELECT b AS window_start, b + (i + 1) * 900000 AS window_end, count(*) AS n FROM (SELECT *, {MS} // 3600000 * 3600000 AS b, unnest(range(4)) AS i FROM events) WHERE b + (i + 1) * 900000 > {MS} GROUP BY ALL")
script("top_n", "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rn FROM customer) WHERE rn <= 2", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rn FROM customer) WHERE rn <= 2")
script("match", "SELECT * FROM events MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY event_id MEASURES FIRST(c.event_id) AS a, LAST(p.event_id) AS b PATTERN (c p) DEFINE c AS event_type = 'click', p AS event_type = 'purchase')", "SELECT user_id, event_id AS a, next_id AS b FROM (SELECT *, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click' AND next_type = 'purchase'")
script("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND o_orderstatus IN ('F')", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND o_orderstatus IN ('F')")
script("exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
script("materialized_view", "SELECT event_type, n FROM kinds", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", "CREATE MATERIALIZED VIEW kinds AS SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
script("arithmetic", "SELECT o_orderkey, o_orderkey * 9000000000000000 + 1 AS big, o_orderkey % (o_custkey % 3) AS r, o_orderkey DIV (o_custkey % 2) AS q, o_totalprice / (o_custkey % 2) AS f FROM orders", "SELECT o_orderkey, CASE WHEN o_orderkey::HUGEINT * 9000000000000000 + 1 <= 9223372036854775807 THEN (o_orderkey::HUGEINT * 9000000000000000 + 1)::BIGINT END AS big, o_orderkey % nullif(o_custkey % 3, 0) AS r, o_orderkey // nullif(o_custkey % 2, 0) AS q, o_totalprice / nullif(o_custkey % 2, 0) AS f FROM orders")


@query("sql_upsert", "SELECT CAST(n_nationkey AS BIGINT) AS k, coalesce(max(c_custkey), min(n_regionkey)) AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def sql_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table after two inserts: a nation's largest customer takes the place of its region."""
    e = engine(spark, sf_dir)
    e.run_script(
        f"""
        CREATE TABLE latest (k BIGINT PRIMARY KEY, v BIGINT) WITH (connector='parquet', mode='upsert', path='{new_path(spark, "latest")}');
        INSERT INTO latest SELECT CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation;
        INSERT INTO latest SELECT CAST(c_nationkey AS BIGINT), max(c_custkey) FROM customer GROUP BY c_nationkey;
        """
    )
    return e.query("SELECT k, v FROM latest")
