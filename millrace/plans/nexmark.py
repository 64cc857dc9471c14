"""The auction benchmark's queries over tables derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.operators import joins, ranking, setops, windows
from millrace.plans.registry import query
from millrace.sources.nexmark import DERIVED, derived

WITH = "WITH " + ", ".join(f"{n} AS ({s.format(ms='epoch_us(ts) // 1000')})" for n, s in DERIVED.items())
HOUR = 3_600_000


def _ts(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis("datetime"))


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir)["bid"]


def nexmark(name: str, sql: str):
    return query(f"nexmark_{name}", f"{WITH} {sql}")


@nexmark("q0", "SELECT auction, bidder, price, datetime FROM bid")
def q0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).select("auction", "bidder", "price", "datetime")


@nexmark("q1", "SELECT auction, bidder, CAST(0.908 * price AS DECIMAL(23,3)) AS price, datetime FROM bid")
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).select("auction", "bidder", (F.lit(0.908).cast("decimal(3,3)") * F.col("price")).cast("decimal(23,3)").alias("price"), "datetime")


@nexmark("q2", "SELECT auction, price FROM bid WHERE auction % 123 = 0")
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).filter(S.modulo("auction", F.lit(123)) == 0).select("auction", "price")


@nexmark("q3", "SELECT p.name, p.city, p.state, a.id FROM auction a JOIN person p ON a.seller = p.id WHERE a.category = 10 AND p.state IN ('OR', 'ID', 'CA')")
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    out = joins.equi(d["auction"].filter("category = 10"), d["person"].filter(F.col("state").isin("OR", "ID", "CA")), "a", "p", [("seller", "id")])
    return out.select(F.col("p_name").alias("name"), F.col("p_city").alias("city"), F.col("p_state").alias("state"), F.col("a_id").alias("id"))


WINNERS = "SELECT a.id, a.category, a.seller, max(b.price) AS final, max(b.datetime) AS closed FROM auction a JOIN bid b ON a.id = b.auction WHERE b.datetime BETWEEN a.datetime AND a.expires GROUP BY ALL"


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    both = joins.equi(d["auction"], d["bid"], "a", "b", [("id", "auction")]).filter("b_datetime BETWEEN a_datetime AND a_expires")
    return both.groupBy(F.col("a_id").alias("id"), F.col("a_category").alias("category"), F.col("a_seller").alias("seller")).agg(F.max("b_price").alias("final"), F.max("b_datetime").alias("closed"))


@nexmark("q4", f"SELECT category, round(avg(final), 4) AS mean FROM ({WINNERS}) GROUP BY category")
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _winners(spark, sf_dir).groupBy("category").agg(F.round(F.avg("final"), 4).alias("mean"))


HOPS = "SELECT auction, s AS window_start, s + 7200000 AS window_end, count(*) AS n FROM (SELECT *, unnest([datetime // 3600000 * 3600000, datetime // 3600000 * 3600000 - 3600000]) AS s FROM bid) GROUP BY ALL"


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.hop(_ts(bids(spark, sf_dir)), "ts", 2 * HOUR, HOUR, ["auction"], F.count("*").alias("n"))


@nexmark("q5", f"SELECT auction, window_start, window_end, n FROM (SELECT *, rank() OVER (PARTITION BY window_start ORDER BY n DESC) AS r FROM ({HOPS})) WHERE r <= 1")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_n_per_key(_hops(spark, sf_dir), ["window_start"], [F.desc("n")], 1, "rank").select("auction", "window_start", "window_end", "n")


@nexmark("q6", f"SELECT seller, round(avg(final), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY seller ORDER BY closed DESC, id DESC) AS rn FROM ({WINNERS})) WHERE rn <= 10 GROUP BY seller")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_n(_winners(spark, sf_dir), "seller", ["closed", "id"], 10, mean=F.round(F.avg("final"), 4))


@nexmark("q7", "SELECT datetime // 3600000 * 3600000 AS window_start, datetime // 3600000 * 3600000 + 3600000 AS window_end, max(price) AS hi, min(price) AS lo FROM bid GROUP BY 1, 2")
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumble(_ts(bids(spark, sf_dir)), "ts", HOUR, [], F.max("price").alias("hi"), F.min("price").alias("lo"))


@nexmark(
    "q8",
    """
    SELECT p.id, p.name, p.w AS window_start, a.n FROM (SELECT id, name, datetime // 86400000 * 86400000 AS w, count(*) AS n FROM person GROUP BY ALL) p
    JOIN (SELECT seller, datetime // 86400000 * 86400000 AS w, count(*) AS n FROM auction GROUP BY ALL) a ON p.id = a.seller AND p.w = a.w
    """,
)
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    p = windows.tumble(_ts(d["person"]), "ts", 24 * HOUR, ["id", "name"], F.count("*").alias("m"))
    a = windows.tumble(_ts(d["auction"]), "ts", 24 * HOUR, ["seller"], F.count("*").alias("n"))
    out = joins.equi(p, a, "p", "a", [("id", "seller"), ("window_start", "window_start")])
    return out.select(F.col("p_id").alias("id"), F.col("p_name").alias("name"), F.col("p_window_start").alias("window_start"), F.col("a_n").alias("n"))


@nexmark(
    "q11",
    """
    , g AS (SELECT *, CASE WHEN datetime - lag(datetime) OVER (PARTITION BY bidder ORDER BY datetime) < 3600000 THEN 0 ELSE 1 END AS new FROM bid),
    h AS (SELECT *, sum(new) OVER (PARTITION BY bidder ORDER BY datetime RANGE UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT bidder, min(datetime) AS window_start, max(datetime) + 3600000 AS window_end, count(*) AS n FROM h GROUP BY bidder, sid
    """,
)
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session(_ts(bids(spark, sf_dir)), "ts", HOUR, ["bidder"], F.count("*").alias("n"))


@nexmark("q12", "SELECT bidder, datetime // 3600000 * 3600000 AS window_start, datetime // 3600000 * 3600000 + 3600000 AS window_end, count(*) AS n FROM bid GROUP BY 1, 2, 3")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumble(_ts(bids(spark, sf_dir)), "ts", HOUR, ["bidder"], F.count("*").alias("n"))


@nexmark(
    "q14",
    """
    SELECT auction, bidder, CAST(0.908 * price AS DECIMAL(23,3)) AS price, CASE WHEN hour(make_timestamp(datetime * 1000)) BETWEEN 8 AND 18 THEN 'day' WHEN hour(make_timestamp(datetime * 1000)) <= 6 OR hour(make_timestamp(datetime * 1000)) >= 20 THEN 'night' ELSE 'other' END AS kind,
           CAST(length(url) - length(replace(url, 'c', '')) AS BIGINT) AS cs FROM bid WHERE 0.908 * price > 1000 AND 0.908 * price < 50000
    """,
)
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, price = S.extract("hour", F.col("datetime")), (F.lit(0.908).cast("decimal(3,3)") * F.col("price")).cast("decimal(23,3)")
    kind = F.when(hour.between(8, 18), "day").when((hour <= 6) | (hour >= 20), "night").otherwise("other")
    rows = bids(spark, sf_dir).filter((price > 1000) & (price < 50000))
    return rows.select("auction", "bidder", price.alias("price"), kind.alias("kind"), (F.length("url") - F.length(F.replace("url", F.lit("c"), F.lit("")))).cast("bigint").alias("cs"))


BANDS = "count(*) AS n, count(DISTINCT bidder) AS bidders, count(DISTINCT CASE WHEN price < 10000 THEN bidder END) AS low_bidders, count(DISTINCT auction) AS auctions"


def _bands():
    return [F.count("*").alias("n"), F.countDistinct("bidder").alias("bidders"), F.countDistinct(F.when(F.col("price") < 10000, F.col("bidder"))).alias("low_bidders"), F.countDistinct("auction").alias("auctions")]


@nexmark("q15", f"SELECT datetime // 86400000 * 86400000 AS window_start, datetime // 86400000 * 86400000 + 86400000 AS window_end, {BANDS} FROM bid GROUP BY 1, 2")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumble(_ts(bids(spark, sf_dir)), "ts", 24 * HOUR, [], *_bands())


@nexmark("q16", f"SELECT channel, datetime // 86400000 * 86400000 AS window_start, datetime // 86400000 * 86400000 + 86400000 AS window_end, {BANDS} FROM bid GROUP BY 1, 2, 3")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumble(_ts(bids(spark, sf_dir)), "ts", 24 * HOUR, ["channel"], *_bands())


@nexmark("q17", "SELECT auction, datetime // 86400000 * 86400000 AS window_start, datetime // 86400000 * 86400000 + 86400000 AS window_end, count(*) AS n, min(price) AS lo, max(price) AS hi, round(avg(price), 4) AS mean, CAST(sum(price) AS BIGINT) AS total FROM bid GROUP BY 1, 2, 3")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumble(_ts(bids(spark, sf_dir)), "ts", 24 * HOUR, ["auction"], F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"), F.round(F.avg("price"), 4).alias("mean"), F.sum("price").alias("total"))


@nexmark("q18", "SELECT auction, bidder, price, event_id FROM (SELECT *, row_number() OVER (PARTITION BY bidder, auction ORDER BY datetime DESC, event_id DESC) AS rn FROM bid) WHERE rn <= 1")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(bids(spark, sf_dir), ["bidder", "auction"], ["datetime", "event_id"]).select("auction", "bidder", "price", "event_id")


@nexmark("q19", "SELECT auction, bidder, price, event_id FROM (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY price DESC, event_id) AS rn FROM bid) WHERE rn <= 10")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_n_per_key(bids(spark, sf_dir), ["auction"], [F.desc("price"), F.asc("event_id")], 10).select("auction", "bidder", "price", "event_id")


@nexmark("q20", "SELECT b.auction, b.bidder, b.price, a.itemname, a.seller FROM bid b JOIN auction a ON b.auction = a.id WHERE a.category = 10")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived(spark, sf_dir)
    out = joins.equi(d["bid"], d["auction"].filter("category = 10"), "b", "a", [("auction", "id")])
    return out.select(*[F.col(c).alias(c[2:]) for c in ("b_auction", "b_bidder", "b_price", "a_itemname", "a_seller")])


@nexmark("q21", "SELECT auction, bidder, channel, CASE WHEN lower(channel) = 'click' THEN '0' WHEN lower(channel) = 'purchase' THEN '1' ELSE split_part(url, '/', 5) END AS channel_id FROM bid WHERE channel IS NOT NULL")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("channel")
    return bids(spark, sf_dir).filter("channel is not null").select("auction", "bidder", "channel", F.when(low == "click", "0").when(low == "purchase", "1").otherwise(S.split_index("url", "/", F.lit(4))).alias("channel_id"))


@nexmark("q22", "SELECT auction, bidder, split_part(url, '/', 4) AS d1, split_part(url, '/', 5) AS d2, split_part(url, '/', 6) AS d3 FROM bid")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bids(spark, sf_dir).select("auction", "bidder", *[S.split_index("url", "/", F.lit(k + 2)).alias(f"d{k}") for k in (1, 2, 3)])


@nexmark("qhop", HOPS)
def qhop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir)


@nexmark("qcum", "SELECT auction, b AS window_start, b + (i + 1) * 3600000 AS window_end, count(*) AS n FROM (SELECT *, datetime // 21600000 * 21600000 AS b, unnest(range(6)) AS i FROM bid) WHERE b + (i + 1) * 3600000 > datetime GROUP BY ALL")
def qcum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cumulate_sums(_ts(bids(spark, sf_dir)), "ts", HOUR, 6 * HOUR, ["auction"], "n", {})


@query(
    "nexmark_generator",
    """
    SELECT kind, count(*) AS n, min(ms) AS first_at, max(ms) AS last_at
    FROM (SELECT CASE WHEN i % 50 < 1 THEN 'person' WHEN i % 50 < 4 THEN 'auction' ELSE 'bid' END AS kind, 1436918400000 + i AS ms
          FROM (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS i))
    GROUP BY kind
    """,
)
def generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.nexmark import generate

    """As many events as there are line items, a millisecond apart."""
    made = generate(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
    rows = [made[kind].select(F.lit(kind).alias("kind"), "datetime") for kind in ("person", "auction", "bid")]
    return setops.union_all(*rows).groupBy("kind").agg(F.count("*").alias("n"), F.min("datetime").alias("first_at"), F.max("datetime").alias("last_at"))
