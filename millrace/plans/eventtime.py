"""Windows, running aggregates, ranking, patterns and table functions over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import aggregates as A
from millrace.operators import cep, keyed, ml, ranking, vector, windows
from millrace.operators.dataflow import Stream
from millrace.plans.registry import query
from millrace.plans.relational import t

MS = "(epoch_us(ts) // 1000)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events")


def amount():
    return F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total")


TOTAL = "CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total"


@query("win_tumble", f"SELECT event_type, {MS} // 3600000 * 3600000 AS window_start, {MS} // 3600000 * 3600000 + 3600000 AS window_end, count(*) AS n, {TOTAL} FROM events GROUP BY 1, 2, 3")
def win_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumble(events(spark, sf_dir), "ts", 3_600_000, ["event_type"], F.count("*").alias("n"), amount())


@query(
    "win_hop",
    f"""
    SELECT event_type, s AS window_start, s + 3600000 AS window_end, count(*) AS n, {TOTAL}
    FROM (SELECT *, unnest([{MS} // 1200000 * 1200000 - i * 1200000 FOR i IN range(3)]) AS s FROM events) GROUP BY 1, 2, 3
    """,
)
def win_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hop(events(spark, sf_dir), "ts", 3_600_000, 1_200_000, ["event_type"], F.count("*").alias("n"), amount())


SESSIONS = f"""
    WITH a AS (SELECT user_id, value, {MS} AS ms FROM events),
    b AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 1800000 THEN 0 ELSE 1 END AS new FROM a),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms RANGE UNBOUNDED PRECEDING) AS sid FROM b)
    SELECT user_id, min(ms) AS window_start, max(ms) + 1800000 AS window_end, count(*) AS n FROM c GROUP BY user_id, sid
"""


@query("win_session", SESSIONS)
def win_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session(events(spark, sf_dir), "ts", 1_800_000, ["user_id"], F.count("*").alias("n"))


@query("win_session_accumulated", f"SELECT user_id, window_start, window_end, n * 2 AS twice FROM ({SESSIONS})")
def win_session_accumulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Twice:
        """Accumulator of twice the count of rows."""

        n = 0

        def add(self, v):
            self.n += 2

        def merge(self, other):
            self.n += other.n

        def result(self):
            return self.n

    rows = windows.session_rows(events(spark, sf_dir).select("event_id", "user_id", "ts"), "ts", 1_800_000, ["user_id"])
    return A.accumulate(rows, ["user_id", windows.START, windows.END], Twice, ["event_id"], "twice", "bigint")


@query("win_session_merging", SESSIONS.replace("< 1800000", "<= 1800000"))
def win_session_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session_merging(events(spark, sf_dir), "ts", 1_800_000, ["user_id"], F.count("*").alias("n"))


CUMULATE = f"""
    SELECT event_type, b AS window_start, b + (i + 1) * 900000 AS window_end, count(*) AS n, {TOTAL}
    FROM (SELECT *, {MS} // 3600000 * 3600000 AS b, unnest(range(4)) AS i FROM events) WHERE b + (i + 1) * 900000 > {MS} GROUP BY ALL
"""


@query("win_cumulate", CUMULATE)
def win_cumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cumulate(events(spark, sf_dir), "ts", 900_000, 3_600_000, ["event_type"], F.count("*").alias("n"), amount())


@query("win_cumulate_sums", CUMULATE)
def win_cumulate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.cumulate_sums(events(spark, sf_dir), "ts", 900_000, 3_600_000, ["event_type"], "n", {"total": F.col("value").cast("decimal(12,2)")})
    return out.withColumn("total", F.col("total").cast("decimal(22,2)"))


@query("win_evict_count", f"SELECT user_id, window_start, window_start + 86400000 AS window_end, event_id FROM (SELECT *, {MS} // 86400000 * 86400000 AS window_start, row_number() OVER (PARTITION BY user_id, {MS} // 86400000 ORDER BY {MS} DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2")
def win_evict_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evict(events(spark, sf_dir).select("user_id", "ts", "event_id"), "ts", 86_400_000, ["user_id"], last=2).select("user_id", "window_start", "window_end", "event_id")


@query("win_evict_time", f"SELECT user_id, window_start, window_start + 86400000 AS window_end, event_id FROM (SELECT *, {MS} // 86400000 * 86400000 AS window_start, max({MS}) OVER (PARTITION BY user_id, {MS} // 86400000) AS newest FROM events) WHERE {MS} >= newest - 3600000")
def win_evict_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evict(events(spark, sf_dir).select("user_id", "ts", "event_id"), "ts", 86_400_000, ["user_id"], max_age_ms=3_600_000).select("user_id", "window_start", "window_end", "event_id")


@query("win_process", f"SELECT user_id, count(*) AS n, max(value) - min(value) AS spread FROM events GROUP BY user_id, {MS} // 86400000")
def win_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(rows):
        n, user, lo, hi = 0, None, None, None
        for r in rows:
            n, user, v = n + 1, r["user_id"], r["value"]
            if v is not None:  # NaN is the largest value, as in SQL
                lo = v if lo is None or lo != lo or v < lo else lo
                hi = v if hi is None or v != v or v > hi else hi
        yield {"user_id": user, "n": n, "spread": None if lo is None else hi - lo}

    return Stream(events(spark, sf_dir).select("user_id", "ts", "value")).key_by("user_id").window_process("ts", 86_400_000, spread, "user_id long, n long, spread double").df


def _cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "user_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint").alias("v"))


CENTS = f"(SELECT event_id, user_id, ts, {MS} AS ms, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS v FROM events)"


@query("over_running", f"SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, count(*) OVER w AS n, min(v) OVER w AS lo, max(v) OVER w AS hi FROM {CENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ms)")
def over_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.running(_cents(spark, sf_dir), ["user_id"], "ms", s=F.sum("v"), n=F.count("*"), lo=F.min("v"), hi=F.max("v")).select("event_id", "s", "n", "lo", "hi")


@query("over_rows", f"SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, round(avg(v) OVER w, 4) AS a FROM {CENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def over_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.running(_cents(spark, sf_dir), ["user_id"], "event_id", "rows", 4, s=F.sum("v"), a=F.avg("v"))
    return out.select("event_id", "s", F.round("a", 4).alias("a"))


@query("over_range", f"SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS s, count(*) OVER w AS n FROM {CENTS} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW)")
def over_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.running(_cents(spark, sf_dir), ["user_id"], "ms", "range", 7_200_000, s=F.sum("v"), n=F.count("*")).select("event_id", "s", "n")


@query("over_nav", f"SELECT event_id, lag(v) OVER w AS l1, lag(v, 3) OVER w AS l3, first_value(v) OVER w AS f, last_value(v) OVER w AS z FROM {CENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def over_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.running(_cents(spark, sf_dir), ["user_id"], "event_id", "none", l1=F.lag("v"), l3=F.lag("v", 3))
    return ranking.running(rows, ["user_id"], "event_id", f=F.first("v"), z=F.last("v")).select("event_id", "l1", "l3", "f", "z")


for _rank in ranking.RANKS:

    @query(f"topn_{_rank}", f"SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, {_rank}() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority{', o_orderkey' if _rank == 'row_number' else ''}) AS r FROM orders) WHERE r <= 2")
    def _topn(spark: SparkSession, sf_dir: str, rank: str = _rank) -> DataFrame:
        order = [F.col("o_orderpriority"), *([F.col("o_orderkey")] if rank == "row_number" else [])]
        return ranking.top_n_per_key(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], order, 2, rank)


@query("last_n_avg", f"SELECT user_id, round(avg(v), 4) AS a, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {CENTS}) WHERE rn <= 10 GROUP BY user_id")
def last_n_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_n(_cents(spark, sf_dir), "user_id", ["event_id"], 10, a=F.round(F.avg("v"), 4), s=F.sum("v"), n=F.count("*"))


# Rows as letters with their ids, D where the value falls and U where it rises, so that a regular expression finds what the pattern does.
V_SHAPES = f"""
    WITH c AS (SELECT * FROM {CENTS}), d AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM c),
    s AS (SELECT user_id, string_agg(CASE WHEN v < p THEN 'D' WHEN v > p THEN 'U' ELSE 'E' END || event_id || ';', '' ORDER BY event_id) AS rows FROM d GROUP BY user_id),
    m AS (SELECT user_id, string_split(unnest(regexp_extract_all(rows, '[DUE][0-9]+;(?:D[0-9]+;)+U[0-9]+;')), ';') AS e FROM s)
    SELECT m.user_id, a.v AS start_v, b.v AS bottom, CAST(e[-2][2:] AS BIGINT) AS last_id
    FROM m JOIN c a ON a.event_id = CAST(e[1][2:] AS BIGINT) JOIN c b ON b.event_id = CAST(e[-3][2:] AS BIGINT)
"""


@query("match_v_shape", V_SHAPES)
def match_v_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cents(spark, sf_dir)
    v = cep.prev("v", ["user_id"], "event_id")
    return cep.match_recognize(rows, ["user_id"], "event_id", "start down+ up", {"down": F.col("v") < v, "up": F.col("v") > v}, {"start_v": ("FIRST", "start", "v"), "bottom": ("LAST", "down", "v"), "last_id": ("LAST", "up", "event_id")}, "user_id long, start_v long, bottom long, last_id long")


@query(
    "match_pair",
    """
    WITH d AS (SELECT *, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id AS a, next_id AS b FROM d WHERE event_type = 'click' AND next_type = 'purchase'
    """,
)
def match_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    return cep.match_recognize(rows, ["user_id"], "event_id", "c p", {"c": F.col("event_type") == "click", "p": F.col("event_type") == "purchase"}, {"a": ("FIRST", "c", "event_id"), "b": ("LAST", "p", "event_id")}, "user_id long, a long, b long")


@query(
    "cep_followed_by",
    """
    WITH p AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase')
    SELECT e.user_id, e.event_id AS a, min(p.event_id) AS b FROM events e JOIN p ON p.user_id = e.user_id AND p.event_id > e.event_id WHERE e.event_type = 'click' GROUP BY ALL
    """,
)
def cep_followed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = cep.Pattern.begin("a").where(lambda r: r["event_type"] == "click").followed_by("b").where(lambda r: r["event_type"] == "purchase")
    select = lambda m: {"user_id": m["a"][0]["user_id"], "a": m["a"][0]["event_id"], "b": m["b"][0]["event_id"]}
    return Stream(events(spark, sf_dir).select("user_id", "event_id", "event_type")).key_by("user_id").pattern(pattern, [F.col("event_id")], select, "user_id long, a long, b long").df


@query("ptf_running", f"SELECT event_id, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM {CENTS}")
def ptf_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    def running(row: dict, state: dict):
        state["s"] = state.get("s", 0) + row["v"]
        yield {"event_id": row["event_id"], "s": state["s"]}

    return keyed.process_table(_cents(spark, sf_dir), ["user_id"], [F.col("event_id")], running, "event_id long, s long")


@query("reduce_by_key", f"SELECT user_id, max(v) AS v FROM {CENTS} GROUP BY user_id")
def reduce_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cents(spark, sf_dir).select("user_id", "v", "event_id")
    return Stream(rows).key_by("user_id").reduce(lambda a, b: a if a["v"] >= b["v"] else b, [F.col("event_id")]).df.select("user_id", "v")


@query("iterate_halving", "WITH RECURSIVE r AS (SELECT event_id, event_id AS x, 0 AS n FROM events UNION ALL SELECT event_id, x // 2, n + 1 FROM r WHERE x > 0 AND x % 2 = 0) SELECT event_id, x, n FROM r WHERE NOT (x > 0 AND x % 2 = 0)")
def iterate_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.col("event_id").alias("x"), F.lit(0).alias("n"))
    even = lambda: (F.col("x") > 0) & (F.col("x") % 2 == 0)
    step = lambda df: df.select("event_id", F.when(even(), F.expr("x div 2")).otherwise(F.col("x")).alias("x"), F.when(even(), F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return Stream(rows).iterate(step, even(), 40).df


@query("ml_predict_closure", "SELECT o_orderkey, o_totalprice, o_totalprice * 0.5 + 10 AS predicted FROM orders")
def ml_predict_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    ml.register_provider("linear", lambda o: lambda b: b.assign(predicted=b["x"] * float(o["slope"]) + float(o["offset"])))
    model = ml.Model("m", [("x", "DOUBLE")], [("predicted", "DOUBLE")], "linear", {"slope": "0.5", "offset": "10"})
    return ml.predict(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), model, ["o_totalprice"])


VECTORS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
# Queries are all vectors whose id is divisible by 100, against all vectors.
for _metric, _f, _dir in (("cosine", "list_cosine_similarity(q.v, c.v)", "DESC"), ("dot", "list_inner_product(q.v, c.v)", "DESC"), ("l2", "list_distance(q.v, c.v) ** 2", "ASC")):

    @query(
        f"vector_{_metric}",
        f"""
        SELECT query_id, vec_id, round(score, 6) AS score FROM (
          SELECT q.vec_id AS query_id, c.vec_id, {_f} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_f} {_dir}, c.vec_id) AS rn
          FROM {VECTORS} q, {VECTORS} c WHERE q.vec_id % 100 = 0) WHERE rn <= 5
        """,
    )
    def _vector(spark: SparkSession, sf_dir: str, metric: str = _metric) -> DataFrame:
        e = t(spark, sf_dir, "embeddings")
        q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
        return vector.search(q, "query_id", "qv", e.select("vec_id", "embedding"), "vec_id", "embedding", 5, metric, vectors=False).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    "vector_filter_eq",
    f"""
    SELECT query_id, vec_id, round(score, 6) AS score FROM (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS rn
      FROM {VECTORS} q, {VECTORS} c WHERE q.vec_id % 100 = 0 AND (q.vec_id % 200 = 0 OR q.label = c.label)) WHERE rn <= 3
    """,
)
def vector_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), F.when(F.col("vec_id") % 200 != 0, F.col("label")).alias("ql"))
    return vector.search(q, "query_id", "qv", e, "vec_id", "embedding", 3, "dot", [("ql", "label")], vectors=False).select("query_id", "vec_id", F.round("score", 6).alias("score"))
