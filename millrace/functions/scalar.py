"""Scalar functions whose semantics differ from Spark's, as column expressions.

NULL in gives NULL out unless a function says otherwise. Nothing here is a Python UDF: all of it
stays inside whole-stage code generation. Positions and lengths count characters; only
`byte_length` counts bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.types import decimal_result

ColumnOrName = Column | str
#: What the trim functions remove unless told otherwise.
BLANKS = " \t\n\r"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def add(a, b) -> Column:
    """Sum; NULL on overflow."""
    return F.try_add(_c(a), _c(b))


def subtract(a, b) -> Column:
    return F.try_subtract(_c(a), _c(b))


def multiply(a, b) -> Column:
    return F.try_multiply(_c(a), _c(b))


def negate(a) -> Column:
    """Unary minus; NULL for the least integer."""
    return F.try_subtract(F.lit(0), _c(a))


def int_divide(a, b) -> Column:
    """Integer quotient, cut toward zero; NULL by zero and on overflow."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, None).when(b == -1, negate(a)).otherwise(F.call_function("div", a, F.when((b == 0) | (b == -1), F.lit(1)).otherwise(b)))


def modulo(a, b) -> Column:
    """Remainder with the dividend's sign; NULL by zero."""
    a, b = _c(a), _c(b)
    return F.when(b == -1, a - a).otherwise(F.try_mod(a, b))


def real_divide(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def decimal_divide(a, b, left: tuple[int, int], right: tuple[int, int]) -> Column:
    """Quotient of decimals of the given (precision, scale), in the result's own scale, rounded half up."""
    p, s = decimal_result("/", left, right)
    return F.try_divide(_c(a), _c(b)).try_cast(f"decimal({p},{s})")


def to_int(x, kind: str = "number") -> Column:
    """Cast to BIGINT: numbers are cut, texts give their leading integer, else NULL; booleans are 0 or 1."""
    x = _c(x)
    if kind == "text":
        return F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("bigint")
    return x.try_cast("bigint")


def to_float(x, kind: str = "number") -> Column:
    """Cast to DOUBLE: texts give their leading number, else NULL."""
    x = _c(x)
    return F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double") if kind == "text" else x.try_cast("double")


def to_text(x) -> Column:
    return _c(x).cast("string")


def to_bool(x, kind: str = "text") -> Column:
    x = _c(x)
    if kind != "text":
        return x != 0
    low = F.lower(x)
    return F.when(low.isin("t", "true", "y", "yes", "on", "1"), True).when(low.isin("f", "false", "n", "no", "off", "0"), False)


def to_decimal(x, p: int, s: int) -> Column:
    """Cast to DECIMAL(p, s), rounded half up; NULL if it doesn't fit."""
    return _c(x).try_cast(f"decimal({p},{s})")


def byte_length(x) -> Column:
    """`length`, `char_length` and `character_length`: bytes in UTF-8."""
    return F.octet_length(_c(x))


def substring(s, start, length=None) -> Column:
    """From a 1-based start; a start below 1 counts as 1 without shortening; a negative length gives NULL."""
    s, at = _c(s), F.greatest(_c(start), F.lit(1))
    if length is None:
        return F.substr(s, at)
    n = _c(length)
    return F.when(n < 0, None).otherwise(F.substr(s, at, F.greatest(n, F.lit(0))))


def position(needle, hay) -> Column:
    """1-based place of the needle; 0 if absent or empty."""
    needle, hay = _c(needle), _c(hay)
    return F.when(needle == "", 0).otherwise(F.call_function("instr", hay, needle))


def replace(s, old, new) -> Column:
    s, old = _c(s), _c(old)
    return F.when(old == "", s).otherwise(F.replace(s, old, _c(new)))


def btrim(s, chars: str = BLANKS) -> Column:
    return F.btrim(_c(s), F.lit(chars))


def ltrim(s, chars: str = BLANKS) -> Column:
    return F.ltrim(_c(s), F.lit(chars))


def rtrim(s, chars: str = BLANKS) -> Column:
    return F.rtrim(_c(s), F.lit(chars))


def regexp_extract(s, pattern: str, group: int = 0) -> Column:
    """A group of the first match, the whole match by default; NULL without a match."""
    s = _c(s)
    return F.when(F.regexp_like(s, F.lit(pattern)), F.regexp_extract(s, pattern, group))


def split_index(s, delimiter: str, index) -> Column:
    """0-based part; NULL out of range or for an empty delimiter."""
    s, i = _c(s), _c(index)
    if delimiter == "":
        return F.lit(None).cast("string")
    return F.when(i >= 0, F.get(F.split(s, re.escape(delimiter), -1), i.cast("int")))


def split_part(s, delimiter: str, index) -> Column:
    """1-based part; an empty text below 1, past the end or for an empty delimiter."""
    s, i = _c(s), _c(index)
    if delimiter == "":
        return F.when(s.isNotNull(), F.lit(""))
    return F.when(s.isNull() | i.isNull(), None).when(i < 1, "").otherwise(F.coalesce(F.get(F.split(s, re.escape(delimiter), -1), (i - 1).cast("int")), F.lit("")))


def starts_with(s, prefix) -> Column:
    return F.startswith(_c(s), _c(prefix))


def left(s, n) -> Column:
    return F.left(_c(s), _c(n))


def right(s, n) -> Column:
    return F.right(_c(s), _c(n))


def lpad(s, n, pad: str = " ") -> Column:
    return _padded(F.lpad, s, n, pad)


def rpad(s, n, pad: str = " ") -> Column:
    return _padded(F.rpad, s, n, pad)


def _padded(f, s, n, pad: str) -> Column:
    """Cuts a longer text; an empty pad adds nothing; a negative length gives an empty text."""
    s, n = _c(s), _c(n)
    fit = F.left(s, n) if pad == "" else f(s, n, F.lit(pad))
    return F.when(n <= 0, F.when(s.isNotNull(), "")).otherwise(fit)


def repeat(s, n) -> Column:
    return F.repeat(_c(s), F.greatest(_c(n), F.lit(0)))


def initcap(s) -> Column:
    """Capital after anything but a letter or digit, small letters elsewhere."""
    parts = F.regexp_extract_all(F.lower(_c(s)), F.lit(r"([A-Za-z0-9]+|[^A-Za-z0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


def ascii_code(s) -> Column:
    return F.ascii(_c(s))


def chr_of(n) -> Column:
    """The character of a code from 0 to 255, else NULL."""
    n = _c(n)
    return F.when((n >= 0) & (n <= 255), F.chr(n))


def floor(x) -> Column:
    return F.floor(_c(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(_c(x)).cast("double")


def round_half_away(x, digits: int = 0) -> Column:
    """Rounded half away from zero; DOUBLE."""
    return F.round(_c(x).cast("double"), digits)


def trunc(x, digits: int = 0) -> Column:
    """Cut toward zero; DOUBLE."""
    x, scale = _c(x).cast("double"), float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def extract(field: str, ms) -> Column:
    """A field of epoch milliseconds in UTC, BIGINT; dow counts from Sunday as 0, epoch is whole seconds, floored."""
    t = F.timestamp_millis(_c(ms))
    field = field.lower()
    if field == "epoch":
        return F.floor(_c(ms) / 1000).cast("bigint")
    if field == "dow":
        return (F.dayofweek(t) - 1).cast("bigint")
    part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "doy": F.dayofyear, "quarter": F.quarter}[field]
    return part(t).cast("bigint")


def date_trunc(unit: str, ms) -> Column:
    """Epoch milliseconds cut to a unit, in milliseconds; weeks begin on Monday."""
    return F.unix_millis(F.date_trunc(unit, F.timestamp_millis(_c(ms))))


def date_format(ms, pattern: str) -> Column:
    return F.date_format(F.timestamp_millis(_c(ms)), pattern)


def to_timestamp(s, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch milliseconds of a text; NULL if it doesn't parse."""
    return F.unix_millis(F.try_to_timestamp(_c(s), F.lit(pattern)))


def array_item(a, index) -> Column:
    """1-based item; NULL out of range; a fractional index is cut."""
    return F.get(_c(a), _c(index).cast("int") - 1)


def cardinality(x) -> Column:
    x = _c(x)
    return F.when(x.isNotNull(), F.size(x))


def element(a) -> Column:
    """The only item; NULL if empty, an error if there are more."""
    a = _c(a)
    return F.when(F.size(a) > 1, F.raise_error(F.lit("ELEMENT of more than one item"))).otherwise(F.get(a, 0))


def row(**fields) -> Column:
    return F.struct(*[_c(v).alias(k) for k, v in fields.items()])


def make_map(*pairs) -> Column:
    """A map of keys and values in turn; of equal keys the last holds; a NULL key gives a NULL map."""
    keys, values = [_c(k) for k in pairs[::2]], [_c(v) for v in pairs[1::2]]
    if not keys:
        return F.create_map()
    known = keys[0].isNotNull()
    for k in keys[1:]:
        known = known & k.isNotNull()
    entries = F.array(*[F.struct(k.alias("key"), v.alias("value")) for k, v in zip(keys, values, strict=True)])
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.lit(len(keys))), lambda later: later["key"] == e["key"]))
    return F.when(known, F.map_from_entries(F.when(known, last)))


def map_item(m, key) -> Column:
    return F.try_element_at(_c(m), _c(key))


def json_value(s, path: str) -> Column:
    """The text of a scalar at a path; NULL for objects, arrays and what isn't there."""
    got = F.get_json_object(_c(s), path)
    return F.when(~F.regexp_like(got, F.lit(r"^\s*[\[{]")), got)


def json_query(s, path: str) -> Column:
    """The text of an object or array at a path, else NULL."""
    got = F.get_json_object(_c(s), path)
    return F.when(F.regexp_like(got, F.lit(r"^\s*[\[{]")), got)


def json_exists(s, path: str) -> Column:
    """Whether a path leads to a value other than null."""
    s = _c(s)
    return F.when(s.isNotNull(), F.get_json_object(s, path).isNotNull())


def json_object(**fields) -> Column:
    """JSON text with keys in order; NULL values stay as null."""
    return F.to_json(F.struct(*[_c(fields[k]).alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def like(s, pattern: str) -> Column:
    """LIKE with % and _ and no escape character."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    return F.regexp_like(_c(s), F.lit(f"(?s)^{body}\\z"))


def compare_number(s, op: str, number) -> Column:
    """A text compared with a number: the text as a number, unknown if it isn't one."""
    x, y = to_float(s, "text"), F.lit(number).cast("double")
    return {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "<>": x != y}[op]
