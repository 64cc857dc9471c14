"""One query for each family of scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.plans.registry import query
from millrace.plans.relational import t


@query(
    "fn_string",
    r"""
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, CAST(strlen(p_name) AS BIGINT) AS bytes,
           substring(p_name, 3, 4) AS sub, substring(p_name, greatest(-2, 1), 5) AS sub0,
           CAST(instr(p_name, 'a') AS BIGINT) AS pos, CAST(0 AS BIGINT) AS pos0, replace(p_type, 'E', 'xy') AS rep,
           trim('  ' || p_brand || E'\t ', E' \t\n\r') AS bt, ltrim('xx' || p_brand, 'x') AS lt, rtrim(p_brand || '##', '#') AS rt,
           starts_with(p_brand, 'Brand#1') AS sw, left(p_name, 3) AS l, right(p_name, 3) AS r, left(p_name, 0) AS l0,
           lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 4, '*') AS rp, reverse(p_brand) AS rev, repeat(left(p_name, 2), 3) AS rpt,
           CAST(ascii(p_name) AS BIGINT) AS asc_, chr(65 + p_size % 20) AS ch, p_brand || '-' || p_size AS cat
    FROM part
    """,
)
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: c.cast("bigint")
    return t(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.lower("p_type").alias("low"),
        long(S.byte_length("p_name")).alias("bytes"),
        S.substring("p_name", F.lit(3), F.lit(4)).alias("sub"),
        S.substring("p_name", F.lit(-2), F.lit(5)).alias("sub0"),
        long(S.position(F.lit("a"), "p_name")).alias("pos"),
        long(S.position(F.lit(""), "p_name")).alias("pos0"),
        S.replace("p_type", F.lit("E"), F.lit("xy")).alias("rep"),
        S.btrim(F.concat(F.lit("  "), "p_brand", F.lit("\t "))).alias("bt"),
        S.ltrim(F.concat(F.lit("xx"), "p_brand"), "x").alias("lt"),
        S.rtrim(F.concat("p_brand", F.lit("##")), "#").alias("rt"),
        S.starts_with("p_brand", F.lit("Brand#1")).alias("sw"),
        S.left("p_name", F.lit(3)).alias("l"),
        S.right("p_name", F.lit(3)).alias("r"),
        S.left("p_name", F.lit(0)).alias("l0"),
        S.lpad("p_brand", F.lit(12), "*").alias("lp"),
        S.rpad("p_brand", F.lit(4), "*").alias("rp"),
        F.reverse("p_brand").alias("rev"),
        S.repeat(F.left("p_name", F.lit(2)), F.lit(3)).alias("rpt"),
        long(S.ascii_code("p_name")).alias("asc_"),
        S.chr_of(F.lit(65) + F.col("p_size") % 20).alias("ch"),
        F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("cat"),
    )


@query(
    "fn_string_parts",
    r"""
    SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#(\d)(\d)') THEN regexp_extract(p_brand, '#(\d)(\d)', 0) END AS m0,
           CASE WHEN regexp_matches(p_brand, '#(\d)(\d)') THEN regexp_extract(p_brand, '#(\d)(\d)', 2) END AS m2, CAST(NULL AS VARCHAR) AS none,
           string_split(p_type, ' ')[2] AS part1, CAST(NULL AS VARCHAR) AS part9, split_part(p_type, ' ', 1) AS sp1, '' AS sp9, '' AS sp0, initcap AS ini
    FROM (SELECT *, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS initcap FROM part)
    """,
)
def fn_string_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select(
        "p_partkey",
        S.regexp_extract("p_brand", r"#(\d)(\d)").alias("m0"),
        S.regexp_extract("p_brand", r"#(\d)(\d)", 2).alias("m2"),
        S.regexp_extract("p_brand", r"^zzz").alias("none"),
        S.split_index("p_type", " ", F.lit(1)).alias("part1"),
        S.split_index("p_type", " ", F.lit(9)).alias("part9"),
        S.split_part("p_type", " ", F.lit(1)).alias("sp1"),
        S.split_part("p_type", " ", F.lit(9)).alias("sp9"),
        S.split_part("p_type", " ", F.lit(0)).alias("sp0"),
        S.initcap("p_name").alias("ini"),
    )


@query("fn_text_unicode", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars, md5(reverse(text)) AS back FROM documents")
def fn_text_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", S.byte_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"), F.md5(F.reverse("text").cast("binary")).alias("back"))


@query(
    "fn_math",
    """
    SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS ab, CAST(floor(l_extendedprice / 7) AS DOUBLE) AS fl, CAST(ceil(l_extendedprice / 7) AS DOUBLE) AS ce,
           CAST(trunc(-l_extendedprice / 7) AS DOUBLE) AS tr, round(sqrt(l_quantity), 6) AS sq, round(exp(l_discount), 6) AS ex, round(ln(l_quantity), 6) AS ln_,
           round(log10(l_quantity), 6) AS lg, CAST(sign(l_tax - 0.04) AS DOUBLE) AS sg, round(power(l_quantity, 2), 4) AS pw,
           CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE CAST(l_orderkey // (l_linenumber - 3) AS BIGINT) END AS dv,
           CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE CAST(l_orderkey % (l_linenumber - 3) AS BIGINT) END AS md, greatest(l_linenumber, 3) AS gr, least(l_linenumber, NULL, 3) AS le
    FROM lineitem
    """,
)
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    less = c("l_linenumber") - 3
    return t(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.abs(c("l_discount") - 0.05).alias("ab"),
        S.floor(c("l_extendedprice") / 7).alias("fl"),
        S.ceil(c("l_extendedprice") / 7).alias("ce"),
        S.trunc(-c("l_extendedprice") / 7).alias("tr"),
        F.round(F.sqrt("l_quantity"), 6).alias("sq"),
        F.round(F.exp("l_discount"), 6).alias("ex"),
        F.round(F.ln("l_quantity"), 6).alias("ln_"),
        F.round(F.log10("l_quantity"), 6).alias("lg"),
        F.signum(c("l_tax") - 0.04).alias("sg"),
        F.round(F.pow("l_quantity", F.lit(2)), 4).alias("pw"),
        S.int_divide("l_orderkey", less.cast("bigint")).alias("dv"),
        S.modulo("l_orderkey", less.cast("bigint")).alias("md"),
        F.greatest("l_linenumber", F.lit(3)).alias("gr"),
        F.least("l_linenumber", F.lit(None).cast("int"), F.lit(3)).alias("le"),
    )


BIG = 9223372036854775807


@query("fn_overflow", f"SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN {BIG} END AS plus, CASE WHEN n_nationkey <= 1 THEN CAST({BIG} AS BIGINT) * n_nationkey END AS times, CAST(-n_nationkey AS BIGINT) AS neg, CASE WHEN n_nationkey > 0 THEN 100.0 / n_nationkey END::DOUBLE AS q FROM nation")
def fn_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return t(spark, sf_dir, "nation").select("n_nationkey", S.add(F.lit(BIG), k).alias("plus"), S.multiply(F.lit(BIG), k).alias("times"), S.negate(k).alias("neg"), S.real_divide(F.lit(100.0), k).alias("q"))


@query(
    "fn_decimal",
    """
    SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_tax AS DECIMAL(10,2)) AS DECIMAL(21,4)) AS prod,
           CAST(CAST(l_extendedprice AS DECIMAL(10,2)) + CAST(l_tax AS DECIMAL(10,2)) AS DECIMAL(11,2)) AS plus, CAST(CAST(l_quantity AS DECIMAL(10,2)) AS DECIMAL(3,1)) AS narrow
    FROM lineitem
    """,
)
def fn_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c: S.to_decimal(c, 10, 2)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.multiply(d("l_extendedprice"), d("l_tax")).try_cast("decimal(21,4)").alias("prod"), S.add(d("l_extendedprice"), d("l_tax")).alias("plus"), S.to_decimal(d("l_quantity"), 3, 1).alias("narrow"))


@query(
    "fn_date",
    """
    SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(floor(second(ts)) AS BIGINT) AS s, CAST(dayofweek(ts) AS BIGINT) AS dow,
           CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(quarter(ts) AS BIGINT) AS q, epoch_us(ts) // 1000000 AS ep, epoch_us(date_trunc('week', ts)) // 1000 AS wk, epoch_us(date_trunc('hour', ts)) // 1000 AS hr,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS txt, epoch_us(date_trunc('second', ts)) // 1000 AS back, CAST(NULL AS BIGINT) AS bad
    FROM events
    """,
)
def fn_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    part = [S.extract(f, ms).alias(n) for f, n in (("year", "y"), ("month", "mo"), ("day", "d"), ("hour", "h"), ("minute", "mi"), ("second", "s"), ("dow", "dow"), ("doy", "doy"), ("quarter", "q"), ("epoch", "ep"))]
    text = S.date_format(ms, "yyyy-MM-dd HH:mm:ss")
    return t(spark, sf_dir, "events").select("event_id", *part, S.date_trunc("week", ms).alias("wk"), S.date_trunc("hour", ms).alias("hr"), text.alias("txt"), S.to_timestamp(text).alias("back"), S.to_timestamp(F.lit("no time")).alias("bad"))


@query(
    "fn_json",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS v, CAST(NULL AS VARCHAR) AS q, json_exists(props, '$.k') AS e, false AS e2,
           '{"a":' || event_id || ',"b":"' || event_type || '"}' AS o, '[1,{"x":2}]' AS arr, '2' AS inner_
    FROM events WHERE props IS NOT NULL
    """,
)
def fn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.lit('{"a":[1,{"x":2}]}')
    rows = t(spark, sf_dir, "events").filter("props is not null")
    return rows.select("event_id", S.json_value("props", "$.k").alias("v"), S.json_query("props", "$.k").alias("q"), S.json_exists("props", "$.k").alias("e"), S.json_exists("props", "$.zz").alias("e2"), S.json_object(b="event_type", a="event_id").alias("o"), S.json_query(doc, "$.a").alias("arr"), S.json_value(doc, "$.a[1].x").alias("inner_"))


@query(
    "fn_collections",
    """
    SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS a9, CAST(2 AS BIGINT) AS card, n_name AS el, n_name AS fld, CAST(2 AS BIGINT) AS dup, CAST(NULL AS BIGINT) AS miss, CAST(CASE WHEN n_nationkey > 0 THEN 1 END AS BIGINT) AS nullkey
    FROM nation
    """,
)
def fn_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = F.col("n_nationkey").cast("bigint"), F.col("n_regionkey").cast("bigint")
    pair = F.array(r, n)
    twice = S.make_map(F.lit("k"), F.lit(1).cast("bigint"), F.lit("k"), F.lit(2).cast("bigint"))
    nullable = S.make_map(F.when(n > 0, F.lit("k")), F.lit(1).cast("bigint"))
    return t(spark, sf_dir, "nation").select("n_nationkey", S.array_item(pair, F.lit(1)).alias("a1"), S.array_item(pair, F.lit(9)).alias("a9"), S.cardinality(pair).cast("bigint").alias("card"), S.element(F.array("n_name")).alias("el"), S.row(x="n_name").getField("x").alias("fld"), S.map_item(twice, F.lit("k")).alias("dup"), S.map_item(twice, F.lit("z")).alias("miss"), S.map_item(nullable, F.lit("k")).alias("nullkey"))


@query(
    "fn_cast",
    r"""
    SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS pre, CAST(NULL AS BIGINT) AS bad, CAST(trunc(n_nationkey * 1.7) AS BIGINT) AS cut, n_nationkey + 0.5::DOUBLE AS fl, CAST(NULL AS DOUBLE) AS badf,
           CASE WHEN n_nationkey % 2 = 0 THEN true ELSE false END AS b, CAST(NULL AS BOOLEAN) AS badb, CAST(n_nationkey AS VARCHAR) AS txt, CAST(CASE WHEN n_nationkey > 0 THEN 1 ELSE 0 END AS BIGINT) AS frombool
    FROM nation
    """,
)
def fn_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return t(spark, sf_dir, "nation").select(
        "n_nationkey",
        S.to_int(F.concat(n.cast("string"), F.lit("abc")), "text").alias("pre"),
        S.to_int("n_name", "text").alias("bad"),
        S.to_int(n * 1.7).alias("cut"),
        S.to_float(F.concat(n.cast("string"), F.lit(".5kg")), "text").alias("fl"),
        S.to_float("n_name", "text").alias("badf"),
        S.to_bool(F.when(n % 2 == 0, "Yes").otherwise("off")).alias("b"),
        S.to_bool(F.lit("maybe")).alias("badb"),
        S.to_text(n).alias("txt"),
        S.to_int(n > 0).alias("frombool"),
    )


@query(
    "fn_conditional",
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, '?') AS co,
           nullif(o_orderstatus, 'F') AS nu, o_orderpriority LIKE '%-H_GH' AS lk, o_orderpriority LIKE '1\\%' ESCAPE '!' AS bs, o_totalprice BETWEEN 1000 AND 100000 AS bt, o_orderstatus IN ('F', 'O') AS isin
    FROM orders
    """.replace("1\\\\%", "1\\%"),
)
def fn_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low").alias("band"),
        F.coalesce(F.when(F.col("o_orderkey") % 2 == 0, s), F.lit("?")).alias("co"),
        F.nullif(s, F.lit("F")).alias("nu"),
        S.like("o_orderpriority", "%-H_GH").alias("lk"),
        S.like("o_orderpriority", "1\\%").alias("bs"),
        p.between(1000, 100000).alias("bt"),
        s.isin("F", "O").alias("isin"),
    )
