"""Rows by rank: Top-N, Top-N of each key, running and last-N aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import Refused

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def top_n(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT: each task keeps its own first rows, so nothing is sorted as a whole."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Some n rows, over all tasks."""
    return (df.offset(offset) if offset else df).limit(n)


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "row_number") -> DataFrame:
    """Rows of rank n or less in each key; the rank is not in the output.

    Spark keeps only n ranks of a key in each task before the shuffle, so a hot key costs no more than others.
    """
    if rank not in RANKS:
        raise Refused(f"Top-N ranks by {', '.join(RANKS)}")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", RANKS[rank]().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key in the order of `by`: an aggregate, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return out.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def running(df: DataFrame, keys: list[str], order: str, frame: str = "running", preceding: int = 0, **aggregates: Column) -> DataFrame:
    """Every row with aggregates over its key so far.

    frame is `running` (rows up to this one in event time; rows of equal time see each other),
    `rows` (this row and `preceding` before it) or `range` (rows whose order value, a number, is at
    most `preceding` below this row's). Functions without a frame, like lag, take frame `none`.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    if frame == "running":
        w = w.rangeBetween(Window.unboundedPreceding, 0)
    elif frame == "rows":
        w = w.rowsBetween(-preceding, 0)
    elif frame == "range":
        w = w.rangeBetween(-preceding, 0)
    elif frame != "none":
        raise Refused(f"no frame {frame}")
    return df.select("*", *[c.over(w).alias(n) for n, c in aggregates.items()])


def last_n(df: DataFrame, key: str, order: list[str], size: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the last `size` rows of each key, a row for each key. Only so many rows of a key leave each task."""
    kept = top_n_per_key(df, [key], [F.desc(c) for c in order], size)
    return kept.groupBy(key).agg(*[c.alias(a) for a, c in aggregates.items()])
