"""Streaming queries run to the end of their input, against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cep, setops, windows
from millrace.plans.eventtime import CENTS, MS, SESSIONS
from millrace.plans.registry import query
from millrace.plans.relational import LEFT
from millrace.storage import new_path
from millrace.streaming import runtime, stateful


#: Slices that a table of events is cut into, in order of time; each is a batch of a stream. Rows of a file of a slice.
SLICES, FILE_ROWS = 4, 500_000


def stream(spark: SparkSession, sf_dir: str, lag_ms: int = 0) -> DataFrame:
    """All events as a stream of SLICES batches: state and watermark go from one to the next.

    A batch takes so many files, so all slices have to have as many. Where a slice has at least that many rows for
    each task that deals them out in turn, no file of it stays empty; otherwise each slice is one file.
    """
    path, events = new_path(spark, "events"), spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    least, most = events.agg(F.min(micros), F.max(micros)).first()
    step = ((most or 0) - (least or 0)) // SLICES + 1
    part = F.coalesce(F.floor((micros - F.lit(least or 0)) / step), F.lit(0))
    rows = dict(events.groupBy(part.alias("k")).count().collect())
    files = max(rows.values(), default=0) // FILE_ROWS + 1
    if min(rows.get(k, 0) for k in range(SLICES)) < files * events.rdd.getNumPartitions():
        files = 1
    for k in range(SLICES):  # files are read by their time of writing
        piece = events.filter(part == k)
        (piece.repartition(files) if files > 1 else piece.coalesce(1)).write.mode("append").parquet(path)
    return runtime.with_event_time(runtime.read_files(spark, path, events.schema, files), "ts", lag_ms)


def cents(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("bigint"))


@query("stream_tumble_final", f"SELECT event_type, {MS} // 3600000 * 3600000 AS window_start, {MS} // 3600000 * 3600000 + 3600000 AS window_end, count(*) AS n FROM events GROUP BY 1, 2, 3")
def stream_tumble_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.drain(windows.tumble(stream(spark, sf_dir), "ts", 3_600_000, ["event_type"], F.count("*").alias("n")), "complete")


@query("stream_hop_final", f"SELECT s AS window_start, s + 3600000 AS window_end, count(*) AS n FROM (SELECT *, unnest([{MS} // 1800000 * 1800000, {MS} // 1800000 * 1800000 - 1800000]) AS s FROM events) GROUP BY 1, 2")
def stream_hop_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.drain(windows.hop(stream(spark, sf_dir), "ts", 3_600_000, 1_800_000, [], F.count("*").alias("n")), "update", ["window_start"])


@query("stream_session_final", SESSIONS.replace("< 1800000", "<= 1800000"))
def stream_session_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.drain(windows.session_merging(stream(spark, sf_dir), "ts", 1_800_000, ["user_id"], F.count("*").alias("n")), "complete")


@query("stream_group_running", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def stream_group_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are kept by group; distinct ids by group and id, so that no group's ids are one state value."""
    n = runtime.drain(stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n")), "update", ["event_type"])
    ids = runtime.drain(stream(spark, sf_dir).groupBy("event_type", "event_id").agg(F.count("*").alias("times")), "update", ["event_type", "event_id"])
    return n.join(ids.groupBy("event_type").agg(F.count("event_id").alias("ids")), "event_type").select("event_type", "n", "ids")


@query("stream_dedupe_final", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.drain(stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates())


@query("stream_dedupe_within_watermark", "SELECT DISTINCT event_id FROM events")
def stream_dedupe_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.drain(stream(spark, sf_dir, 60_000).select("event_id", "ts").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"))


@query("stream_over_running", f"SELECT event_id, CAST(sum(v) OVER w AS BIGINT) AS sum, count(*) OVER w AS n FROM {CENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stream_over_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents(stream(spark, sf_dir)).select("event_id", "user_id", "v")
    return runtime.drain(stateful.process_stream(rows, ["user_id"], lambda: stateful.RunningAggregate("v"), "event_id long, sum long, n long", "event_id"))


@query("stream_topn_final", f"SELECT user_id, event_id, v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_id) AS rn FROM {CENTS}) WHERE rn <= 3")
def stream_topn_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents(stream(spark, sf_dir)).select("event_id", "user_id", "v")
    log = stateful.process_stream(rows, ["user_id"], lambda: stateful.TopN(3, lambda r: (-r["v"], r["event_id"])), "user_id long, event_id long, v long, __row_kind string", "event_id")
    return setops.net(runtime.drain(log))


@query("stream_count_trigger", f"SELECT user_id, 5 AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS g FROM {CENTS}) GROUP BY user_id, g HAVING count(*) = 5")
def stream_count_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents(stream(spark, sf_dir)).select("event_id", "user_id", "v")
    return runtime.drain(stateful.process_stream(rows, ["user_id"], lambda: stateful.CountTrigger("v", 5, "user_id"), "user_id long, n int, total long", "event_id"))


@query("stream_count_trigger_kept", f"SELECT user_id, n, total FROM (SELECT user_id, count(*) OVER w AS n, CAST(sum(v) OVER w AS BIGINT) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {CENTS} WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 11 PRECEDING)) WHERE rn % 5 = 0")
def stream_count_trigger_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents(stream(spark, sf_dir)).select("event_id", "user_id", "v")
    return runtime.drain(stateful.process_stream(rows, ["user_id"], lambda: stateful.CountTrigger("v", 5, "user_id", 12), "user_id long, n long, total long", "event_id"))


class LastClick(stateful.CoProcess):
    """Purchases, the right input, with the key's last click, the left input."""

    def __init__(self):
        self.click = None

    def left(self, row):
        self.click = row["event_id"]
        return ()

    def right(self, row):
        yield {"user_id": row["user_id"], "purchase": row["event_id"], "click": self.click}


@query("stream_connect", "SELECT user_id, event_id AS purchase, click FROM (SELECT *, max(event_id) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY event_id) AS click FROM events) WHERE event_type = 'purchase'")
def stream_connect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both inputs are cut at the same times, so their batches go in step."""
    clicks, purchases = (stream(spark, sf_dir).filter(F.col("event_type") == x).select("user_id", "event_id") for x in ("click", "purchase"))
    return runtime.drain(stateful.connect_streams(clicks, purchases, ["user_id"], LastClick, "user_id long, purchase long, click long", "event_id"))


@query("stream_retract", f"SELECT user_id, n, total FROM (SELECT user_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM {LEFT} GROUP BY user_id)")
def stream_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of purchases updated and clicks deleted; the result's own changelog, netted."""
    rows = cents(stream(spark, sf_dir))
    kinds = F.when(F.col("event_type") == "purchase", F.array(F.lit("insert"), F.lit("update_before"), F.lit("update_after"))).when(F.col("event_type") == "click", F.array(F.lit("insert"), F.lit("delete"))).otherwise(F.array(F.lit("insert")))
    log = rows.select("event_id", "user_id", "v", F.posexplode(kinds).alias("step", setops.ROW_KIND))
    log = log.select("user_id", F.when(F.col(setops.ROW_KIND) == "update_after", F.col("v") * 2).otherwise(F.col("v")).alias("v"), setops.ROW_KIND, (F.col("event_id") * 4 + F.col("step")).alias("at"))
    made = stateful.process_stream(log, ["user_id"], lambda: stateful.RetractingSum("v", "user_id"), f"user_id long, n long, total long, {setops.ROW_KIND} string", "at")
    return setops.net(runtime.drain(made))


@query("stream_pattern", "SELECT user_id, event_id AS a, next_id AS b FROM (SELECT *, lead(event_type) OVER w AS next_type, lead(event_id) OVER w AS next_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_type = 'click' AND next_type = 'purchase'")
def stream_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cep.Pattern.begin("a").where(lambda r: r["event_type"] == "click").next("b").where(lambda r: r["event_type"] == "purchase")
    rows = stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    select = lambda m: {"user_id": m["a"][0]["user_id"], "a": m["a"][0]["event_id"], "b": m["b"][0]["event_id"]}
    return runtime.drain(stateful.process_stream(rows, ["user_id"], lambda: stateful.PatternProcess(p, select), "user_id long, a long, b long", "event_id"))


@query("stream_interval_join", "SELECT a.event_id AS a_event_id, b.event_id AS b_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.ts BETWEEN b.ts - INTERVAL 30 MINUTE AND b.ts + INTERVAL 10 MINUTE")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (stream(spark, sf_dir).select("event_id", "user_id", "ts", "event_type").filter(F.col("event_type") == x).withColumnsRenamed({c: f"{p}_{c}" for c in ("event_id", "user_id", "ts", "event_type")}) for p, x in (("a", "click"), ("b", "purchase")))
    within = F.expr("a_ts BETWEEN b_ts - INTERVAL 30 MINUTES AND b_ts + INTERVAL 10 MINUTES")
    return runtime.drain(a.join(b, (F.col("a_user_id") == F.col("b_user_id")) & within).select("a_event_id", "b_event_id"))


@query("stream_upsert_final", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "upserted")
    rows = stream(spark, sf_dir).select("user_id", "event_type", "event_id")
    runtime.start(rows, runtime.upsert_into(path, ["user_id"], ["event_id"]), "append").awaitTermination()
    return runtime.current(spark, path).select("user_id", "event_type", "event_id")


@query("stream_exactly_once", "SELECT event_id, user_id, event_type FROM events")
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written by a stream that is started again from its checkpoint, as a restart after a failure does."""
    path, checkpoint = new_path(spark, "once"), new_path(spark, "once-checkpoint")
    rows = stream(spark, sf_dir).select("event_id", "user_id", "event_type")
    for _ in range(2):
        runtime.start_files(rows, path, "parquet", checkpoint).awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
