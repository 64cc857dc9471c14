"""Event-time windows over a timestamp column; bounds are epoch milliseconds, intervals half open.

Tumbling, hopping and cumulating windows run in batch and in streaming. The batch session window
splits where the gap is reached, the streaming one (Spark's own) merges sessions that touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import Refused

START, END = "window_start", "window_end"


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, with or without time zone (then UTC); microseconds are floored."""
    return F.unix_millis(ts.cast("timestamp"))


def _bounds(df: DataFrame) -> DataFrame:
    named = df.withColumn(START, F.unix_millis(F.col("_window.start").cast("timestamp"))).withColumn(END, F.unix_millis(F.col("_window.end").cast("timestamp")))
    return named.drop("_window")


def _free(df: DataFrame) -> None:
    if taken := {START, END} & set(df.columns):
        raise Refused(f"reserved names: {', '.join(sorted(taken))}")


def _grouped(df: DataFrame, window: Column, keys: list[str], aggregates: list[Column]) -> DataFrame:
    _free(df)
    out = df.groupBy(*keys, window.alias("_window")).agg(*aggregates)
    rest = [c for c in out.columns if c not in ("_window", *keys)]
    return _bounds(out).select(*keys, START, END, *rest)


def tumble(df: DataFrame, ts: str, size_ms: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """A row for each key and window of size_ms that has rows."""
    if size_ms <= 0:
        raise Refused("a window's size is positive")
    return _grouped(df, F.window(ts, f"{size_ms} milliseconds"), keys, list(aggregates))


def hop(df: DataFrame, ts: str, size_ms: int, slide_ms: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Windows of size_ms that begin every slide_ms; the slide is at most the size."""
    if not 0 < slide_ms <= size_ms:
        raise Refused("HOP takes a slide above 0 and at most the size")
    return _grouped(df, F.window(ts, f"{size_ms} milliseconds", f"{slide_ms} milliseconds"), keys, list(aggregates))


def cumulate(df: DataFrame, ts: str, step_ms: int, size_ms: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Windows that begin with each size_ms and grow by step_ms; a row counts in all that end after it.

    Aggregation runs in two parts: rows meet in their step first, so that only a row for each key
    and step is copied to the windows that hold it. That needs aggregates that can be combined,
    so it is done by `cumulate_sums`; here every row is copied to its windows.
    """
    if step_ms <= 0 or size_ms <= 0 or size_ms % step_ms:
        raise Refused("CUMULATE takes a size that is a multiple of its step")
    _free(df)
    at = epoch_ms(F.col(ts))
    base = F.floor(at / size_ms).cast("bigint") * size_ms
    first = F.floor((at - base) / step_ms).cast("bigint") + 1
    rows = df.withColumn(START, base).withColumn(END, F.explode(F.transform(F.sequence(first, F.lit(size_ms // step_ms).cast("bigint")), lambda i: base + i * step_ms)))
    out = rows.groupBy(*keys, START, END).agg(*aggregates)
    return out


def cumulate_sums(df: DataFrame, ts: str, step_ms: int, size_ms: int, keys: list[str], counts: str, sums: dict[str, Column]) -> DataFrame:
    """Row counts and sums in cumulating windows, from one partial row for each key and step.

    A running window over at most size/step partial rows of a base window replaces the copies.
    Windows without new rows still appear, up to the end of the base window, as they hold earlier rows.
    """
    if step_ms <= 0 or size_ms <= 0 or size_ms % step_ms:
        raise Refused("CUMULATE takes a size that is a multiple of its step")
    at = epoch_ms(F.col(ts))
    steps = size_ms // step_ms
    part = df.groupBy(*keys, (F.floor(at / step_ms).cast("bigint") * step_ms).alias("_step")).agg(F.count("*").alias(counts), *[F.sum(c).alias(n) for n, c in sums.items()])
    part = part.withColumn(START, F.floor(F.col("_step") / size_ms).cast("bigint") * size_ms)
    w = Window.partitionBy(*keys, START).orderBy("_step")
    running = part.select(*keys, START, "_step", *[F.sum(n).over(w).alias(n) for n in (counts, *sums)], F.lead("_step").over(w).alias("_next"))
    first = ((F.col("_step") - F.col(START)) / step_ms).cast("bigint") + 1
    last = F.coalesce(((F.col("_next") - F.col(START)) / step_ms).cast("bigint"), F.lit(steps).cast("bigint"))
    return running.withColumn(END, F.explode(F.transform(F.sequence(first, last), lambda i: F.col(START) + i * step_ms))).select(*keys, START, END, counts, *sums)


def session(df: DataFrame, ts: str, gap_ms: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Batch sessions: a new one begins where the gap to the row before is gap_ms or more; it ends gap_ms after its last row.

    Without keys all rows are one timeline, which takes a single partition.
    """
    out = _sessions(df, ts, gap_ms, keys).groupBy(*keys, "_session").agg(F.min("_ms").alias(START), (F.max("_ms") + gap_ms).alias(END), *aggregates)
    return out.drop("_session")


def _sessions(df: DataFrame, ts: str, gap_ms: int, keys: list[str]) -> DataFrame:
    if gap_ms <= 0:
        raise Refused("a session's gap is positive")
    _free(df)
    rows = df.withColumn("_ms", epoch_ms(F.col(ts)))
    w = Window.partitionBy(*keys).orderBy("_ms") if keys else Window.partitionBy(F.lit(1)).orderBy("_ms")
    new = F.when(F.col("_ms") - F.lag("_ms").over(w) < gap_ms, 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def session_rows(df: DataFrame, ts: str, gap_ms: int, keys: list[str]) -> DataFrame:
    """Rows with the bounds of their batch session, for aggregates of any kind, such as accumulators."""
    w = Window.partitionBy(*keys, "_session")
    bounds = _sessions(df, ts, gap_ms, keys).withColumn(START, F.min("_ms").over(w)).withColumn(END, F.max("_ms").over(w) + gap_ms)
    return bounds.drop("_ms", "_new", "_session")


def session_merging(df: DataFrame, ts: str, gap_ms: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Sessions of batch or stream by Spark's session window: those exactly gap_ms apart merge."""
    return _grouped(df, F.session_window(ts, f"{gap_ms} milliseconds"), keys, list(aggregates))


def evict(df: DataFrame, ts: str, size_ms: int, keys: list[str], last: int | None = None, max_age_ms: int | None = None) -> DataFrame:
    """Rows of tumbling windows after eviction: the last n of a window, or those at most max_age_ms older than its newest."""
    _free(df)
    rows = df.withColumn("_ms", epoch_ms(F.col(ts))).withColumn(START, F.floor(F.col("_ms") / size_ms).cast("bigint") * size_ms)
    own = Window.partitionBy(*keys, START)
    if last is not None:
        rows = rows.withColumn("_n", F.row_number().over(own.orderBy(F.desc("_ms"), *[F.desc(c) for c in df.columns if c != ts and df.schema[c].dataType.simpleString()[:3] not in ("map",)]))).filter(F.col("_n") <= last).drop("_n")
    if max_age_ms is not None:
        newest = rows.groupBy(*keys, START).agg(F.max("_ms").alias("_newest"))
        rows = rows.join(newest, [*keys, START]).filter(F.col("_ms") >= F.col("_newest") - max_age_ms).drop("_newest")
    return rows.withColumn(END, F.col(START) + size_ms).drop("_ms")
