"""SQL type text to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from millrace.errors import Refused

# Spellings of the types that take no further arguments.
PLAIN = {
    "bigint": T.LongType(), "int8": T.LongType(),
    "int": T.IntegerType(), "integer": T.IntegerType(), "int4": T.IntegerType(),
    "smallint": T.ShortType(), "int2": T.ShortType(),
    "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "real": T.FloatType(), "float4": T.FloatType(),
    "double": T.DoubleType(), "double precision": T.DoubleType(), "float8": T.DoubleType(),
    "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(), "string": T.StringType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(),
    "date": T.DateType(), "bytea": T.BinaryType(),
}
DEFAULT_DECIMAL = (38, 9)


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts of a list at the given character, outside brackets and quotes."""
    parts, depth, start, quote = [], 0, 0, ""
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "(<[":
            depth += 1
        elif c in ")>]":
            depth -= 1
        elif c == by and not depth:
            parts.append(text[start:k])
            start = k + 1
    return [*parts, text[start:]]


def parse_type(text: str) -> T.DataType:
    """The Spark type of a SQL type. Every column is nullable; lengths of texts are ignored."""
    t = re.sub(r"\s+", " ", text.strip())
    low = t.lower()
    if low.endswith("[]"):
        return T.ArrayType(parse_type(t[:-2]))
    if m := re.fullmatch(r"(.+) array", low):
        return T.ArrayType(parse_type(t[: len(m[1])]))
    if m := re.fullmatch(r"(array|multiset)\s*<(.+)>", low):
        return T.ArrayType(parse_type(t[t.index("<") + 1 : -1]))
    if re.fullmatch(r"map\s*<.+>", low):
        parts = split_top(t[t.index("<") + 1 : -1])
        if len(parts) != 2:
            raise Refused(f"MAP takes a key and a value type: {text}")
        return T.MapType(*map(parse_type, parts))
    if re.fullmatch(r"row\s*<.+>", low):
        fields = [p.strip().split(" ", 1) for p in split_top(t[t.index("<") + 1 : -1])]
        if any(len(f) != 2 for f in fields):
            raise Refused(f"a ROW field is a name and a type: {text}")
        return T.StructType([T.StructField(n, parse_type(k)) for n, k in fields])
    if m := re.fullmatch(r"(varchar|char|character varying) ?\( ?\d+ ?\)", low):
        return T.StringType()
    if m := re.fullmatch(r"(timestamp|timestamptz) ?\( ?(\d) ?\)", low):
        return PLAIN[m[1]]
    if m := re.fullmatch(r"(?:numeric|decimal|dec)(?: ?\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", low):
        p, s = (int(m[1]), int(m[2] or 0)) if m[1] else DEFAULT_DECIMAL
        if not 1 <= p <= 38 or s > p:
            raise Refused(f"decimal precision is 1 to 38 and the scale at most the precision: {text}")
        return T.DecimalType(p, s)
    if low == "time":
        return T.TimeType(6)
    if low in PLAIN:
        return PLAIN[low]
    raise Refused(f"unknown type {text!r}")


def decimal_result(op: str, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(precision, scale) of decimal arithmetic; the precision is cut at 38."""
    (p1, s1), (p2, s2) = left, right
    if op in "+-":
        s = max(s1, s2)
        p = max(p1 - s1, p2 - s2) + s + 1
    elif op == "*":
        s, p = s1 + s2, p1 + p2 + 1
    elif op == "/":
        s = max(s1, s2, 6)
        p = p1 + s2 + s
    elif op == "%":
        s, p = max(s1, s2), min(p1, p2)
    else:
        raise Refused(f"unknown decimal operator {op!r}")
    return min(p, 38), min(s, 38)
