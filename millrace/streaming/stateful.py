"""Keyed processes over streams: programs with state, timers, time to live and side outputs.

A program is a plain Python object; its state between batches lies in Spark's
RocksDB state store, one value of plain data for each key. The batch drivers in `millrace.operators.keyed` run
programs without timers unchanged.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.errors import Refused
from millrace.operators import cep, setops
from millrace.operators.keyed import Row, _fields

TAG, INPUT = "_output", "_input"


class Process:
    """Base of programs with timers. `context` has `watermark_ms`, `now_ms`, `timer(ms)` and `cancel(ms)`."""

    context: Context | None = None

    def row(self, row: Row) -> Iterable[Row]:
        return ()

    def timer(self, at_ms: int) -> Iterable[Row]:
        return ()

    def done(self) -> bool:
        """True if the key's state can go."""
        return False

    def save(self) -> Any:
        """Plain data that the state store keeps."""
        return {k: v for k, v in self.__dict__.items() if k != "context"}

    def load(self, data: Any) -> None:
        self.__dict__.update(data)


class Context:
    def __init__(self, handle: StatefulProcessorHandle, values: Any):
        self.handle = handle
        self.watermark_ms, self.now_ms = values.getCurrentWatermarkInMs(), values.getCurrentProcessingTimeInMs()

    def timer(self, at_ms: int) -> None:
        self.handle.registerTimer(at_ms)

    def cancel(self, at_ms: int) -> None:
        self.handle.deleteTimer(at_ms)


def process_stream(df: DataFrame, keys: list[str], make: Callable[[], Process], schema: str, order: str | None = None, time: str = "none", ttl_ms: int | None = None, mode: str = "append") -> DataFrame:
    """Run a program for each key of a stream. time: none, event or processing, for its timers.

    Rows of a micro-batch come in order of the given column; ttl_ms drops a key's state that long
    (in processing time) after its last change. Rows travel as rows: a pandas frame for each key and
    batch would cost more than the programs.
    """
    names, columns = [f.split()[0].strip("`") for f in _fields(schema)], df.columns
    made = SparkRow(*names)

    class Run(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("program", "b binary", ttl_ms) if ttl_ms else handle.getValueState("program", "b binary")

        def _load(self, values) -> Process:
            p = make()
            if self.state.exists():
                p.load(pickle.loads(bytes(self.state.get()[0])))
            p.context = Context(self.handle, values)
            return p

        def _save(self, p: Process) -> None:
            if p.done():
                self.state.clear()
            else:
                self.state.update((pickle.dumps(p.save()),))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[SparkRow]:
            p = self._load(timerValues)
            batch = [dict(zip(columns, r, strict=True)) for r in rows]
            if order:
                batch.sort(key=lambda r: (r[order] is not None, r[order], r.get(INPUT)))
            out = [made(*map(x.get, names)) for r in batch for x in p.row(r)]
            self._save(p)
            return iter(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[SparkRow]:
            p = self._load(timerValues)
            out = [made(*map(x.get, names)) for x in p.timer(expiredTimerInfo.getExpiryTimeInMs())]
            self._save(p)
            return iter(out)

        def close(self) -> None:
            pass

    kind = {"none": "None", "event": "EventTime", "processing": "ProcessingTime"}[time]
    return df.groupBy(*keys).transformWithState(statefulProcessor=Run(), outputStructType=schema, outputMode=mode, timeMode=kind)


class CoProcess(Process):
    """Base of programs with two inputs, which share the key's state and timers."""

    def row(self, row: Row) -> Iterable[Row]:
        return (self.left if row.pop(INPUT) == 1 else self.right)(row)

    def left(self, row: Row) -> Iterable[Row]:
        return ()

    def right(self, row: Row) -> Iterable[Row]:
        return ()


def connect_streams(left: DataFrame, right: DataFrame, keys: list[str], make: Callable[[], CoProcess], schema: str, order: str | None = None, time: str = "none", ttl_ms: int | None = None, mode: str = "append") -> DataFrame:
    """Two streams in one program for each key. Columns of one name are of one type; where both rows are equal in order, the left comes first.

    Rows meet in order within a micro-batch only: a program must not rely on order between batches of unlike streams.
    """
    if INPUT in left.columns + right.columns:
        raise Refused(f"reserved name: {INPUT}")
    both = left.withColumn(INPUT, F.lit(1)).unionByName(right.withColumn(INPUT, F.lit(2)), allowMissingColumns=True)
    return process_stream(both, keys, make, schema, order, time, ttl_ms, mode)


def side_output(df: DataFrame, tag: str | None = None) -> DataFrame:
    """Rows that a program gave under a tag in its `_output` column; without a tag its main output."""
    own = F.col(TAG).isNull() if tag is None else F.col(TAG) == tag
    return df.filter(own).drop(TAG)


class RunningAggregate(Process):
    """OVER on a stream: each row with sum, count, min, max, first and last of a column so far, or of the last n rows."""

    def __init__(self, column: str, last: int | None = None):
        self.column, self.rows = column, deque(maxlen=last) if last else None
        self.n, self.sum, self.lo, self.hi, self.first, self.last = 0, None, None, None, None, None

    def row(self, row: Row) -> Iterable[Row]:
        v = row[self.column]
        if self.rows is not None:
            self.rows.append(v)
            known = [x for x in self.rows if x is not None]
            yield {**row, "n": len(self.rows), "sum": sum(known) if known else None, "min": min(known, default=None), "max": max(known, default=None), "first": self.rows[0], "last": v}
            return
        self.n += 1
        self.first = v if self.n == 1 else self.first
        if v is not None:
            self.sum = v if self.sum is None else self.sum + v
            self.lo = v if self.lo is None else min(self.lo, v)
            self.hi = v if self.hi is None else max(self.hi, v)
        yield {**row, "n": self.n, "sum": self.sum, "min": self.lo, "max": self.hi, "first": self.first, "last": v}


class TopN(Process):
    """Top-N of a key as a changelog: a row that enters is inserted, the one that it pushes out deleted."""

    def __init__(self, n: int, by: Callable[[Row], Any]):
        self.n, self.by, self.rows = n, by, []

    def row(self, row: Row) -> Iterable[Row]:
        self.rows.append(row)
        self.rows.sort(key=self.by)
        if len(self.rows) <= self.n:
            yield {**row, "__row_kind": "insert"}
        elif (out := self.rows.pop()) is not row:
            yield {**out, "__row_kind": "delete"}
            yield {**row, "__row_kind": "insert"}

    def save(self) -> Any:
        return self.rows

    def load(self, data: Any) -> None:
        self.rows = data


class CountTrigger(Process):
    """Fires a global window every n rows with the count of its rows and their sum of a column, and purges it.

    With `keep`, firing does not purge: the window's evictor leaves its last `keep` rows, which are all that is stored.
    """

    def __init__(self, column: str, n: int, key: str, keep: int | None = None):
        self.column, self.n, self.key, self.keep, self.new, self.held = column, n, key, keep, 0, []

    def row(self, row: Row) -> Iterable[Row]:
        self.new += 1
        self.held.append(row[self.column])
        if self.keep is not None:
            del self.held[: -self.keep]
        if self.new == self.n:
            yield {self.key: row[self.key], "n": len(self.held), "total": sum(x for x in self.held if x is not None)}
            self.new = 0
            if self.keep is None:
                self.held = []


class RetractingSum(Process):
    """Count and sum of a changelog's column, itself as a changelog: each change takes the old result back and gives the new one."""

    def __init__(self, column: str, key: str):
        self.column, self.key, self.n, self.total = column, key, 0, 0

    def row(self, row: Row) -> Iterable[Row]:
        sign, old = -1 if row.get(setops.ROW_KIND) in setops.TAKES else 1, self.n
        if old:
            yield {self.key: row[self.key], "n": old, "total": self.total, setops.ROW_KIND: "delete" if old + sign == 0 else "update_before"}
        self.n, self.total = old + sign, self.total + sign * (row[self.column] or 0)
        if self.n:
            yield {self.key: row[self.key], "n": self.n, "total": self.total, setops.ROW_KIND: "update_after" if old else "insert"}

    def done(self) -> bool:
        return self.n == 0


class Deadline(Process):
    """Counts a key's rows until a deadline after the first, then gives the count and lets the key go."""

    def __init__(self, key: str, ts: str, wait_ms: int):
        self.key, self.ts, self.wait_ms, self.n, self.at, self.value = key, ts, wait_ms, 0, None, None

    def row(self, row: Row) -> Iterable[Row]:
        self.n, self.value = self.n + 1, row[self.key]
        if self.at is None:
            self.at = int(row[self.ts].timestamp() * 1000) + self.wait_ms
            self.context.timer(self.at)
        return ()

    def timer(self, at_ms: int) -> Iterable[Row]:
        yield {self.key: self.value, "n": self.n}
        self.n, self.at = 0, None

    def done(self) -> bool:
        return self.at is None


class PaneInfo(Process):
    """Tumbling windows with on-time and late panes: one when a window ends, and one for every row after that.

    The stream's watermark has to trail by lateness_ms (`with_event_time(..., allowed_lateness_ms)`):
    Spark drops rows below the watermark before a program sees them, so a window ends here when
    the watermark is that much short of its end, and goes when the watermark reaches it.
    """

    def __init__(self, key: str, ts: str, size_ms: int, lateness_ms: int = 0):
        self.key, self.ts, self.size_ms, self.lateness_ms = key, ts, size_ms, lateness_ms
        self.windows: dict[int, list] = {}  # start: [rows, panes, fired]
        self.value = None

    def _pane(self, start: int, timing: str) -> Row:
        w = self.windows[start]
        w[1] += 1
        return {self.key: self.value, "window_start": start, "n": w[0], "timing": timing, "pane": w[1] - 1}

    def row(self, row: Row) -> Iterable[Row]:
        self.value = row[self.key]
        start = int(row[self.ts].timestamp() * 1000) // self.size_ms * self.size_ms
        if start not in self.windows:
            self.windows[start] = [0, 0, False]
            self.context.timer(start + self.size_ms - self.lateness_ms)
        self.windows[start][0] += 1
        if self.windows[start][2]:
            yield self._pane(start, "Late")

    def timer(self, at_ms: int) -> Iterable[Row]:
        for start in sorted(self.windows):
            end = start + self.size_ms
            if at_ms == end - self.lateness_ms and not self.windows[start][2]:
                yield self._pane(start, "OnTime")
                self.windows[start][2] = True
                self.context.timer(end + 1)
            elif at_ms > end:
                del self.windows[start]

    def done(self) -> bool:
        return not self.windows


class PatternProcess(Process):
    """Pattern matching on a stream: the matcher's partial matches are the state."""

    def __init__(self, pattern: cep.Pattern, select: Callable, ts: str | None = None):
        self.select = select
        self.matcher = cep.Matcher(pattern, (lambda r: int(r[ts].timestamp() * 1000)) if ts else (lambda r: None))

    def row(self, row: Row) -> Iterable[Row]:
        for m in self.matcher.advance(row)[0]:
            yield self.select(m)

    def save(self) -> Any:
        return self.matcher.n, [(p.start, p.start_ts, p.step, p.count, p.taken) for p in self.matcher.partials]

    def load(self, data: Any) -> None:
        self.matcher.n, partials = data
        self.matcher.partials = [cep.Partial(*p) for p in partials]
