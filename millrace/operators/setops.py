"""Set operations with NULL equal to NULL, duplicates, and changelogs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.errors import Refused

ROW_KIND = "__row_kind"
#: Kinds of a changelog row: those that add a row and those that take one back. An unmarked row adds.
ADDS, TAKES = ("insert", "update_after"), ("delete", "update_before")


def _alike(a: DataFrame, b: DataFrame) -> None:
    if len(a.columns) != len(b.columns):
        raise Refused("set operations take inputs with as many columns")
    for x, y in zip(a.schema, b.schema, strict=True):
        if x.dataType != y.dataType:
            raise Refused(f"set operations take equal types: {x.name} {x.dataType.simpleString()} and {y.name} {y.dataType.simpleString()}")


def union_all(*inputs: DataFrame) -> DataFrame:
    """Rows of all inputs; names come from the first."""
    for x in inputs[1:]:
        _alike(inputs[0], x)
    return reduce(DataFrame.union, inputs)


def union(*inputs: DataFrame) -> DataFrame:
    return union_all(*inputs).distinct()


def intersect(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    _alike(a, b)
    return a.intersectAll(b) if keep_all else a.intersect(b)


def subtract(a: DataFrame, b: DataFrame, keep_all: bool = False) -> DataFrame:
    """EXCEPT."""
    _alike(a, b)
    return a.exceptAll(b) if keep_all else a.subtract(b)


def distinct(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def net(df: DataFrame) -> DataFrame:
    """The rows that a changelog leaves: additions less retractions of each full row, as often as that is positive."""
    if ROW_KIND not in df.columns:
        return df
    rest = [c for c in df.columns if c != ROW_KIND]
    sign = F.when(F.coalesce(ROW_KIND, F.lit("insert")).isin(*TAKES), -1).otherwise(1)
    count = df.groupBy(*rest).agg(F.sum(sign).alias("_n")).filter("_n > 0")
    return count.select(*rest, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_i")).drop("_i")


def retracted(df: DataFrame, keys: list[str], counts: str, sums: dict[str, str] | None = None, least: dict[str, str] | None = None, most: dict[str, str] | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """Aggregates of a changelog, as of the rows that it leaves: count, and sum, MIN, MAX and COUNT DISTINCT by name and column.

    Rows are netted by key and values first, in each task and then over all; a key whose rows are all taken back is gone.
    """
    sums, least, most, distinct = sums or {}, least or {}, most or {}, distinct or {}
    columns = list(dict.fromkeys([*sums.values(), *least.values(), *most.values(), *distinct.values()]))
    if taken := {"_n", counts, *sums, *least, *most, *distinct} & set(keys):
        raise Refused(f"names of keys: {', '.join(sorted(taken))}")
    sign = F.when(F.coalesce(ROW_KIND, F.lit("insert")).isin(*TAKES), -1).otherwise(1) if ROW_KIND in df.columns else F.lit(1)
    left = df.groupBy(*keys, *[c for c in columns if c not in keys]).agg(F.sum(sign).alias("_n")).filter("_n <> 0")
    here = lambda c: F.when(F.col("_n") > 0, F.col(c))
    made: list[Column] = [F.sum(F.col("_n") * F.col(c)).alias(n) for n, c in sums.items()]
    made += [F.min(here(c)).alias(n) for n, c in least.items()] + [F.max(here(c)).alias(n) for n, c in most.items()]
    made += [F.count_distinct(here(c)).alias(n) for n, c in distinct.items()]
    return left.groupBy(*keys).agg(F.sum("_n").alias(counts), *made).filter(F.col(counts) > 0)


def upserts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last state of each key in a changelog; keys whose last change takes the row back are gone."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    out = last.select(*keys, "_r.*").select(*df.columns)
    return out.filter(~F.coalesce(ROW_KIND, F.lit("insert")).isin(*TAKES)).drop(ROW_KIND)


def changelog(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The changelog that leads from one state to another: inserts, deletes, and both images of updates."""
    rest = [c for c in after.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_a"), F.lit(True).alias("_ina"))
    b = after.select(*keys, F.struct(*rest).alias("_b"), F.lit(True).alias("_inb"))
    both = a.join(b, keys, "full")
    changed = both.filter(F.col("_ina").isNull() | F.col("_inb").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    old = F.when(F.col("_ina").isNotNull(), F.struct(F.when(F.col("_inb").isNull(), "delete").otherwise("update_before").alias("k"), F.col("_a").alias("r")))
    new = F.when(F.col("_inb").isNotNull(), F.struct(F.when(F.col("_ina").isNull(), "insert").otherwise("update_after").alias("k"), F.col("_b").alias("r")))
    each = changed.select(*keys, F.explode(F.filter(F.array(old, new), lambda x: x.isNotNull())).alias("_x"))
    return each.select(*keys, "_x.r.*", F.col("_x.k").alias(ROW_KIND)).select(*after.columns, ROW_KIND)
