"""Per-key programs over ordered rows: the base of pattern matching, table functions and keyed processes.

Rows are shuffled by key and sorted within partitions; a task then walks its partition once. A
program sees one key's rows in order and holds only its own state, so a key of any length needs no
more memory than its program keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Row = dict[str, Any]


class Program(Protocol):
    """What is run for each key: a call for each row, and one after the last."""

    def row(self, row: Row) -> Iterable[Row]: ...

    def finish(self) -> Iterable[Row]: ...


def records(batch: pd.DataFrame) -> Iterator[Row]:
    """Rows as dicts of plain values, with None for NULL."""
    columns = [[None if v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else v for v in batch[c].tolist()] for c in batch.columns]
    for values in zip(*columns, strict=True):
        yield dict(zip(batch.columns, values, strict=True))


def key_of(row: Row, keys: list[str]) -> tuple:
    """A row's key; NaN equals itself there, as it does where Spark groups."""
    return tuple("NaN" if row[k] != row[k] else row[k] for k in keys)


def run_keyed(df: DataFrame, keys: list[str], order: list[Column], make: Callable[[], Program], schema: str, batch: int = 4096) -> DataFrame:
    """Rows that a fresh program gives for each key, whose rows it gets in order.

    Values come as Arrow has them: whole numbers stay whole next to NULLs, and NaN is no NULL.
    """
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    ordered = (df.repartition(*[F.col(k) for k in keys]) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, at, out = None, None, []
        for b in batches:
            for r in b.to_pylist():
                key = key_of(r, keys)
                if program is None or key != at:
                    if program is not None:
                        out.extend(program.finish())
                    program, at = make(), key
                out.extend(program.row(r))
                if len(out) >= batch:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out = []
        if program is not None:
            out.extend(program.finish())
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return ordered.mapInArrow(run, schema)


def run_groups(df: DataFrame, keys: list[str], order: list[Column], f: Callable[[Iterator[Row]], Iterable[Row]], schema: str, batch: int = 4096) -> DataFrame:
    """Rows that a function gives for each key from an iterator of the key's rows in order; rows that it leaves are skipped."""
    kind = to_arrow_schema(T.StructType.fromDDL(schema))
    ordered = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        made = (r for _, group in groupby(rows, lambda r: key_of(r, keys)) for r in f(group))
        while out := list(islice(made, batch)):
            yield pa.RecordBatch.from_pylist(out, kind)

    return ordered.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    from millrace.types import split_top

    return [x.strip() for x in split_top(schema)]


def process_table(df: DataFrame, keys: list[str], order: list[Column], function: Callable[[Row, dict], Iterable[Row]], schema: str) -> DataFrame:
    """A process table function: called for each row of a key in order with the key's own state, a dict that starts empty."""

    class Call:
        def __init__(self):
            self.state: dict = {}

        def row(self, row: Row) -> Iterable[Row]:
            return function(row, self.state)

        def finish(self) -> Iterable[Row]:
            return ()

    return run_keyed(df, keys, order, Call, schema)


def reduce_each(df: DataFrame, keys: list[str], order: list[Column], step: Callable[[Row, Row], Row], schema: str, on_flush: bool = False) -> DataFrame:
    """Reduce by key: the value so far after every row, or only the last one on flush."""

    class Reduce:
        value: Row | None = None

        def row(self, row: Row) -> Iterable[Row]:
            self.value = row if self.value is None else step(self.value, row)
            return () if on_flush else (self.value,)

        def finish(self) -> Iterable[Row]:
            return (self.value,) if on_flush and self.value is not None else ()

    return run_keyed(df, keys, order, Reduce, schema)
