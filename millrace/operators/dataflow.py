"""A fluent API over DataFrames in the shape of a typed stream: map, filter, key_by, windows, split, iterate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import Refused
from millrace.operators import cep, joins, keyed, setops, windows
from millrace.operators.keyed import Row
from millrace.storage import stored


class Stream:
    """Rows, bounded or not. Every method gives a new stream; nothing runs before a sink or an action."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def from_elements(spark: SparkSession, rows: Iterable, schema: str) -> Stream:
        return Stream(spark.createDataFrame(list(rows), schema))

    def map(self, **columns: Column) -> Stream:
        return Stream(self.df.select(*[c.alias(n) for n, c in columns.items()]))

    def map_rows(self, f: Callable[[Row], Row], schema: str) -> Stream:
        """A Python function of a row; prefer `map`, which stays in the JVM."""
        return self.flat_map_rows(lambda row: (f(row),), schema)

    def flat_map_rows(self, f: Callable[[Row], Iterable[Row]], schema: str) -> Stream:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([r for row in keyed.records(b) for r in f(row)], columns=[x.split()[0] for x in schema.split(",")])

        return Stream(self.df.mapInPandas(run, schema))

    def flat_map(self, name: str, items: Column) -> Stream:
        """A row for each item of an array."""
        return Stream(self.df.withColumn(name, F.explode(items)))

    def filter(self, test: Column) -> Stream:
        return Stream(self.df.filter(test))

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Stream:
        return Stream(self.df.transform(f))

    def key_by(self, *keys: str) -> KeyedStream:
        return KeyedStream(self.df, list(keys))

    def union(self, *others: Stream) -> Stream:
        return Stream(setops.union_all(self.df, *[o.df for o in others]))

    def fork(self, n: int) -> list[Stream]:
        """The same rows n times; each branch is planned with what follows it."""
        return [Stream(self.df) for _ in range(n)]

    def split(self, **branches: Column) -> dict[str, Stream]:
        """A stream for each condition; a row is in every branch whose condition holds."""
        return {n: Stream(self.df.filter(c)) for n, c in branches.items()}

    def split_by(self, tag: str, values: Iterable) -> dict[object, Stream]:
        return {v: Stream(self.df.filter(F.col(tag) == F.lit(v))) for v in values}

    def side_output(self, tag: Column) -> tuple[Stream, Stream]:
        """The main output, and the rows for which the tag is true."""
        marked = F.coalesce(tag, F.lit(False))
        return Stream(self.df.filter(~marked)), Stream(self.df.filter(marked))

    def broadcast_connect(self, state: DataFrame, on: list[tuple[str, str]], most_rows: int = 100_000) -> Stream:
        """The main rows with the state rows of equal keys; the state is broadcast only if it is small."""
        small = state.limit(most_rows + 1).count() <= most_rows
        s = joins.prefixed(state, "state")
        s = F.broadcast(s) if small else s
        return Stream(self.df.join(s, [F.col(x) == F.col(f"state_{y}") for x, y in on], "left"))

    def async_map(self, f: Callable[[Row], Row], schema: str, in_flight: int = 64, retries: int = 0) -> Stream:
        return Stream(joins.async_map(self.df, f, schema, in_flight, retries))

    def iterate(self, step: Callable[[DataFrame], DataFrame], again: Column, most_rounds: int) -> Stream:
        """Feed rows for which `again` holds back through the step, at most most_rounds times; others leave.

        Each round's rows are stored in the shared folder, so the plan doesn't grow and no round runs twice.
        """
        left, open_rows = [], self.df
        for _ in range(most_rounds):
            done = stored(step(open_rows), "iterate")
            left.append(done.filter(~F.coalesce(again, F.lit(False))))
            open_rows = done.filter(again)
            if not open_rows.limit(1).count():
                return Stream(setops.union_all(*left))
        return Stream(setops.union_all(*left, open_rows))

    def throttle(self, rows_per_second: float) -> Stream:
        """At most so many rows a second from each task. For sources prefer maxOffsetsPerTrigger and maxFilesPerTrigger."""
        if rows_per_second <= 0:
            raise Refused("a rate is positive")
        schema = self.df.schema

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import time

            for b in batches:
                time.sleep(len(b) / rows_per_second)
                yield b

        return Stream(self.df.mapInPandas(run, schema))

    def with_watermark(self, ts: str, lag_ms: int) -> Stream:
        return Stream(self.df.withWatermark(ts, f"{lag_ms} milliseconds"))

    def interval_join(self, other: Stream, on: list[tuple[str, str]], ts: tuple[str, str], lower_ms: int, upper_ms: int, kind: str = "inner") -> Stream:
        return Stream(joins.interval(self.df, other.df, "l", "r", on, *ts, lower_ms, upper_ms, kind))


class KeyedStream:
    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys = df, keys

    def aggregate(self, *aggregates: Column) -> Stream:
        return Stream(self.df.groupBy(*self.keys).agg(*aggregates))

    def reduce(self, step: Callable[[Row, Row], Row], order: list[Column], on_flush: bool = True) -> Stream:
        """Fold rows of a key in order with a Python function; `aggregate` is faster where a built-in says it."""
        return Stream(keyed.reduce_each(self.df, self.keys, order, step, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.df.schema), on_flush))

    def process(self, make: Callable[[], keyed.Program], order: list[Column], schema: str) -> Stream:
        """A keyed process over bounded rows; `millrace.streaming.stateful` runs the same programs on streams."""
        return Stream(keyed.run_keyed(self.df, self.keys, order, make, schema))

    def connect(self, other: KeyedStream, order: list[Column], make: Callable[[], keyed.Program], schema: str) -> Stream:
        """Two inputs in one keyed process: rows of both, marked by `_input` 1 or 2, in one order."""
        both = self.df.withColumn("_input", F.lit(1)).unionByName(other.df.withColumn("_input", F.lit(2)), allowMissingColumns=True)
        return Stream(keyed.run_keyed(both, self.keys, order, make, schema))

    def tumbling(self, ts: str, size_ms: int, *aggregates: Column) -> Stream:
        return Stream(windows.tumble(self.df, ts, size_ms, self.keys, *aggregates))

    def sliding(self, ts: str, size_ms: int, slide_ms: int, *aggregates: Column) -> Stream:
        if slide_ms <= 0 or size_ms % slide_ms:
            raise Refused("a sliding window's size is a multiple of its slide")
        return Stream(windows.hop(self.df, ts, size_ms, slide_ms, self.keys, *aggregates))

    def session(self, ts: str, gap_ms: int, *aggregates: Column) -> Stream:
        return Stream(windows.session_merging(self.df, ts, gap_ms, self.keys, *aggregates))

    def window_process(self, ts: str, size_ms: int, f: Callable[[Iterator[Row]], Iterable[Row]], schema: str) -> Stream:
        """A function of the rows of a key's tumbling window, in order of time: it gets an iterator of them and gives rows.

        Windows are walked one after the other in sorted partitions, so a window costs no call of its own
        between Spark and Python, and holds no more than its function keeps.
        """
        rows = self.df.withColumn("_window", F.window(ts, f"{size_ms} milliseconds").getField("start"))
        return Stream(keyed.run_groups(rows, [*self.keys, "_window"], [F.col(ts)], f, schema))

    def evicting(self, ts: str, size_ms: int, last: int | None = None, max_age_ms: int | None = None) -> Stream:
        return Stream(windows.evict(self.df, ts, size_ms, self.keys, last, max_age_ms))

    def pattern(self, p: cep.Pattern, order: list[Column], select: Callable, schema: str, ts: str | None = None, timed_out: Callable | None = None) -> Stream:
        return Stream(cep.match_pattern(self.df, self.keys, order, p, select, schema, ts, timed_out))
