"""Aggregates with the engine's result types, and a registry of user-defined ones."""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.errors import Refused
from millrace.operators.keyed import Row, key_of, run_keyed
from millrace.operators.setops import ROW_KIND, TAKES


def count_all() -> Column:
    return F.count("*")


def total(x: str, kind: T.DataType) -> Column:
    """SUM in the engine's type: small integers give BIGINT, FLOAT gives DOUBLE, others their own type; NULL on overflow."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return F.try_sum(F.col(x).cast("bigint"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.sum(F.col(x).cast("double"))
    if isinstance(kind, T.DecimalType):
        return F.try_sum(x).try_cast(kind)
    raise Refused(f"SUM of {kind.simpleString()}")


def average(x: str) -> Column:
    """AVG is DOUBLE for every type."""
    return F.avg(F.col(x).cast("double"))


def string_agg(x: str, separator: str = ",", distinct: bool = False, order: str | None = None) -> Column:
    """Texts in one, NULLs left out, in order of `order` or of the texts themselves: the result is the same on every run."""
    items = F.collect_set(x) if distinct else F.collect_list(x)
    if order is not None and not distinct:
        pairs = F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(F.col(order).alias("o"), F.col(x).alias("x")))))
        items = F.transform(pairs, lambda p: p["x"])
    else:
        items = F.array_sort(items)
    return F.when(F.size(items) > 0, F.array_join(items, separator))


def array_agg(x: str, distinct: bool = False, keep_nulls: bool = False) -> Column:
    """Items sorted; NULLs are left out unless asked for, and then come last."""
    if keep_nulls:
        wrapped = (F.collect_set if distinct else F.collect_list)(F.struct(F.col(x).isNull().alias("n"), F.col(x).alias("x")))
        return F.transform(F.array_sort(wrapped), lambda p: p["x"])
    return F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))


def percentile(x: str, fraction: float) -> Column:
    if not 0 <= fraction <= 1:
        raise Refused("a percentile's fraction lies in 0 to 1")
    return F.percentile(x, fraction)


def approx_percentile(x: str, fraction: float, accuracy: int = 10_000) -> Column:
    if not 0 <= fraction <= 1:
        raise Refused("a percentile's fraction lies in 0 to 1")
    return F.percentile_approx(x, fraction, accuracy).cast("double")


def discrete_percentile(df: DataFrame, keys: list[str], x: str, fraction: float, name: str) -> DataFrame:
    """A row for each key with the least value that this fraction of the key's values does not exceed, exactly; NULL without values.

    `approx_percentile`'s sketch may be off by a ten-thousandth of the ranks, which changes the answer where ranks lie
    close to a border of equal values. Here equal values are counted before they are shuffled, and ranks are sums of counts.
    """
    if not 0 <= fraction <= 1:
        raise Refused("a percentile's fraction lies in 0 to 1")
    counts = df.select(*keys, F.col(x).alias("_x")).groupBy(*keys, "_x").agg(F.count("_x").alias("_n"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_n").over(w.orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(w))
    rank = F.greatest(F.lit(1), F.col("_all") - F.floor(F.col("_all") - F.col("_all") * F.lit(float(fraction))))
    return ranked.groupBy(*keys).agg(F.min(F.when(F.col("_upto") >= rank, F.col("_x"))).alias(name))


#: name: (function of pandas series to a value, result type)
REGISTRY: dict[str, tuple[Callable[..., object], str]] = {}


def register_aggregate(name: str, kind: str, f: Callable[..., object]) -> None:
    """A user-defined aggregate: series of its arguments to one value. Rows with a NULL argument are left out."""
    REGISTRY[name.lower()] = (f, kind)


def aggregate_udf(name: str):
    """The named aggregate as a function over columns, called with Arrow batches."""
    if name.lower() not in REGISTRY:
        raise Refused(f"unknown aggregate {name}")
    f, kind = REGISTRY[name.lower()]

    def run(*series):
        known = pd.concat(series, axis=1).dropna()
        return f(*[known.iloc[:, k] for k in range(known.shape[1])]) if len(known) else None

    # The kind is given, as hints can't carry a variable number of arguments.
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)


def user_aggregate(name: str, *columns: str) -> Column:
    """The named aggregate of some columns, for groupBy().agg()."""
    return aggregate_udf(name)(*[F.col(c) for c in columns])


class Accumulator(Protocol):
    """A user-defined aggregate's state. Its attributes, plain data, go between tasks; `take` undoes an `add`, also one of another task."""

    def add(self, *values: Any) -> None: ...

    def take(self, *values: Any) -> None: ...

    def merge(self, other: Accumulator) -> None: ...

    def result(self) -> Any: ...


#: Keys whose states a task holds at once; beyond it they go on as partial states, which are merged.
HELD_KEYS = 10_000


def accumulate(df: DataFrame, keys: list[str], make: Callable[[], Accumulator], columns: list[str], name: str, kind: str) -> DataFrame:
    """A row for each key with the result of its accumulator, which gets the columns' values of each row.

    Tasks accumulate what they read and only states are shuffled, so a hot key costs its last task one state
    for each task before. Rows of a changelog that take back are taken; keys without rows stay with their result.
    """
    named = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    marked = ROW_KIND in df.columns
    rows = df.select(*keys, F.struct(*columns).alias("_values"), *([ROW_KIND] if marked else []))
    partial = ", ".join([*named, "_state binary"])
    arrow = to_arrow_schema(T.StructType.fromDDL(partial))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Row, Accumulator]] = {}

        def states() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**row, "_state": pickle.dumps(vars(state))} for row, state in held.values()], arrow)

        for b in batches:
            for r in b.to_pylist():
                key = key_of(r, keys)
                if key not in held:
                    if len(held) == HELD_KEYS:
                        yield states()
                        held = {}
                    held[key] = {k: r[k] for k in keys}, make()
                state, values = held[key][1], [r["_values"][c] for c in columns]
                (state.take if marked and r[ROW_KIND] in TAKES else state.add)(*values)
        if held:
            yield states()

    class Merge:
        def __init__(self):
            self.first, self.state = None, None

        def row(self, row: Row) -> Iterable[Row]:
            state = make()
            vars(state).update(pickle.loads(row["_state"]))
            if self.first is None:
                self.first, self.state = row, state
            else:
                self.state.merge(state)
            return ()

        def finish(self) -> Iterable[Row]:
            return ({**{k: self.first[k] for k in keys}, name: self.state.result()},)

    return run_keyed(rows.mapInArrow(part, partial), keys, [], Merge, ", ".join([*named, f"`{name}` {kind}"]))


def fold(df: DataFrame, keys: list[str], zero: Column, item: Column, step: Callable[[Column, Column], Column], name: str, order: str) -> DataFrame:
    """Fold each group's items, in order, from `zero`: for folds that no built-in aggregate expresses."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x")))), lambda p: p["x"])
    return df.groupBy(*keys).agg(F.aggregate(items, zero, step).alias(name))
