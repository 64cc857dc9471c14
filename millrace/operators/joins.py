"""Joins by declared keys: equality, time intervals, lookups, semi and anti."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import Refused

KINDS = ("inner", "left", "right", "full")


def prefixed(df: DataFrame, alias: str) -> DataFrame:
    """Columns named <alias>_<column>, as a join's output has them."""
    return df.select(*[F.col(f"`{c}`").alias(f"{alias}_{c}") for c in df.columns])


def equi(left: DataFrame, right: DataFrame, left_alias: str, right_alias: str, on: list[tuple[str, str]], kind: str = "inner") -> DataFrame:
    """Join on equal columns. Catalyst picks the strategy: a side is broadcast only below Spark's size threshold."""
    if kind not in KINDS or not on:
        raise Refused("an equality join needs keys and is inner, left, right or full")
    a, b = prefixed(left, left_alias), prefixed(right, right_alias)
    return a.join(b, [F.col(f"{left_alias}_{x}") == F.col(f"{right_alias}_{y}") for x, y in on], kind)


def interval(left: DataFrame, right: DataFrame, left_alias: str, right_alias: str, on: list[tuple[str, str]], left_ts: str, right_ts: str, lower_ms: int, upper_ms: int, kind: str = "inner") -> DataFrame:
    """left.ts between right.ts + lower and right.ts + upper, with equal keys; bounds belong to the interval.

    The time condition is also an equality: right rows are placed in the buckets that their interval
    touches, so a key with a long history is split by time and no task compares all its pairs.
    """
    if lower_ms > upper_ms:
        raise Refused("an interval's lower bound is at most its upper bound")
    if kind not in (*KINDS, "left_semi", "left_anti"):
        raise Refused(f"no interval join of kind {kind}")
    a, b = prefixed(left, left_alias), prefixed(right, right_alias)
    lt, rt = F.col(f"{left_alias}_{left_ts}"), F.col(f"{right_alias}_{right_ts}")
    keys = [F.col(f"{left_alias}_{x}") == F.col(f"{right_alias}_{y}") for x, y in on]
    ms = lambda c: F.unix_micros(c.cast("timestamp"))
    within = (ms(lt) >= ms(rt) + lower_ms * 1000) & (ms(lt) <= ms(rt) + upper_ms * 1000)
    if left.isStreaming or right.isStreaming or kind in ("right", "full"):
        return a.join(b, [*keys, within], kind)
    width = max(1, upper_ms - lower_ms) * 1000
    a = a.withColumn("_bucket", F.floor(ms(lt) / width))
    low, high = F.floor((ms(rt) + lower_ms * 1000) / width), F.floor((ms(rt) + upper_ms * 1000) / width)
    b = b.withColumn("_rbucket", F.explode(F.sequence(low, high)))
    return a.join(b, [*keys, F.col("_bucket") == F.col("_rbucket"), within], kind).drop("_bucket", "_rbucket")


def multiway(tables: list[tuple[DataFrame, str]], on: list[tuple[str, str]]) -> DataFrame:
    """Inner joins of several tables, left-deep as written; on pairs are `<alias>_<column>` names. Catalyst may reorder."""
    out = prefixed(*tables[0])
    for (df, alias), (x, y) in zip(tables[1:], on, strict=True):
        out = out.join(prefixed(df, alias), F.col(x) == F.col(y))
    return out


def semi(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """IN and EXISTS."""
    r = right.select(*[F.col(y).alias(f"_s{k}") for k, (_, y) in enumerate(on)])
    return left.join(r, [F.col(x) == F.col(f"_s{k}") for k, (x, _) in enumerate(on)], "left_semi")


def anti(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """NOT EXISTS: rows without a partner stay, those with NULL keys among them."""
    r = right.select(*[F.col(y).alias(f"_s{k}") for k, (_, y) in enumerate(on)])
    return left.join(r, [F.col(x) == F.col(f"_s{k}") for k, (x, _) in enumerate(on)], "left_anti")


def not_in(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """NOT IN: a row stays only if it surely differs from every right row; a NULL may equal anything.

    One column is Spark's own null-aware plan in the form of counts and an anti join, so that the
    right side needs no broadcast. Several columns: rows are told apart by which of their keys are
    NULL, and each such pattern of the left side meets each of the right side in an anti join on the
    keys that both have; only patterns that occur are planned, nearly always one.
    """
    names = [f"_s{k}" for k in range(len(on))]
    r = right.select(*[F.col(y).alias(n) for n, (_, y) in zip(names, on, strict=True)]).distinct()
    if len(on) > 1:
        return _not_in_several(left, r, [x for x, _ in on], names)
    x = on[0][0]
    facts = r.agg(F.count("*").alias("_all"), F.count("_s0").alias("_known"))
    out = left.join(r.filter("_s0 is not null"), F.col(x) == F.col("_s0"), "left_anti").crossJoin(F.broadcast(facts))  # one row
    return out.filter((F.col("_all") == 0) | ((F.col("_all") == F.col("_known")) & F.col(x).isNotNull())).select(*left.columns)


def _not_in_several(left: DataFrame, r: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    nulls = lambda columns: F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
    patterns = lambda df, columns: sorted(row[0] for row in df.select(nulls(columns)).distinct().collect())  # 2 ** columns at most
    theirs = patterns(r, names)
    out = None
    for mine in patterns(left, keys):
        rows = left.filter(nulls(keys) == mine)
        for other in theirs:
            both = [k for k in range(len(keys)) if mine[k] == other[k] == "1"]
            side = r.filter(nulls(names) == other).select(*[names[k] for k in both]).distinct()
            rows = rows.join(side, [F.col(keys[k]) == F.col(names[k]) for k in both], "left_anti") if both else rows.limit(0)
        out = rows if out is None else out.unionByName(rows)
    return left.limit(0) if out is None else out


def scalar_filter(df: DataFrame, column: str, op: str, scalar: DataFrame) -> DataFrame:
    """Rows whose column compares true with the one value of an aggregate; none if it is NULL."""
    if len(scalar.columns) != 1:
        raise Refused("a scalar subquery has one column")
    s = F.broadcast(scalar.select(F.col(scalar.columns[0]).alias("_scalar")))  # one row
    test: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    return df.crossJoin(s).filter(test[op](F.col(column), F.col("_scalar"))).drop("_scalar")


def scalar_select(df: DataFrame, name: str, scalar: DataFrame) -> DataFrame:
    """Every row with the one value of an aggregate added."""
    return df.crossJoin(F.broadcast(scalar.select(F.col(scalar.columns[0]).alias(name))))


def patient(function: Callable, retries: int, wait_s: float) -> Callable:
    """The function, called again after a failure: first after wait_s, then after twice as long each time. The last failure is raised."""

    def call(row: dict):
        for attempt in range(retries + 1):
            try:
                return function(row)
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(wait_s * 2**attempt)

    return call


def lookup(df: DataFrame, function: Callable[[dict], dict | None], schema: str, kind: str = "inner", in_flight: int = 64, retries: int = 0, wait_s: float = 0.1) -> DataFrame:
    """Each row with the columns that a function finds for it (None: nothing found).

    Calls of a batch run on a pool of threads; output keeps the input's order. An inner lookup
    drops rows for which nothing is found, a left one gives them NULLs.
    """
    if kind not in ("inner", "left"):
        raise Refused("a lookup join is inner or left")
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    spark_schema = StructType([*df.schema.fields, *added.fields])
    names, call = [f.name for f in added], patient(function, retries, wait_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                found = list(pool.map(call, b.to_dict("records")))
                keep = [k for k, f in enumerate(found) if f is not None or kind == "left"]
                out = b.iloc[keep].reset_index(drop=True)
                for n in names:
                    out[n] = pd.Series([(found[k] or {}).get(n) for k in keep], dtype=object)
                yield out

    return df.mapInPandas(run, spark_schema)


def async_map(df: DataFrame, function: Callable[[dict], dict], schema: str, in_flight: int = 64, retries: int = 0, wait_s: float = 0.1) -> DataFrame:
    """Rows mapped one to one by a function that waits on something; in order, with at most in_flight calls at once."""
    names, call = [x.strip().split(" ")[0] for x in schema.split(",")], patient(function, retries, wait_s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(call, b.to_dict("records"))), columns=names)

    return df.mapInPandas(run, schema)
