"""Auction benchmark data: a deterministic generator, and the same tables derived from the star schema.

Every 50 events are a person, three auctions and 46 bids. Values come from a hash of the seed and
the event's number, so any slice of the numbers can be made anywhere, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH, PERSONS, AUCTIONS = 50, 1, 3
FIRST_CATEGORY, CATEGORIES, PRICES = 10, 5, 100_000
CHANNELS = ("Google", "Facebook", "Baidu", "Apple")
STATES = ("AZ", "CA", "ID", "OR", "WA", "WY")


def _draw(seed: int, salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("n")), F.lit(n))


def _pick(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))


def generate(spark: SparkSession, events: int, tps: int = 1000, seed: int = 42, start_ms: int = 1_436_918_400_000, slices: int | None = None) -> dict[str, DataFrame]:
    """`person`, `auction` and `bid` of the first `events` events, made where they are read."""
    n = spark.range(0, events, 1, slices or max(1, events // 500_000)).select(F.col("id").alias("n"))
    place, epoch = F.col("n") % EPOCH, F.floor(F.col("n") / EPOCH).cast("bigint")
    at = (F.lit(start_ms) + F.floor(F.col("n") * 1000 / tps).cast("bigint")).alias("datetime")
    last_person, last_auction = epoch + 1, (epoch + 1) * AUCTIONS
    person = n.filter(place < PERSONS).select((epoch + 1000).alias("id"), F.concat(F.lit("person "), epoch.cast("string")).alias("name"), F.concat(F.lit("p"), epoch.cast("string"), F.lit("@example.com")).alias("emailaddress"), F.concat(F.lit("city "), _draw(seed, 1, 100).cast("string")).alias("city"), _pick(STATES, _draw(seed, 2, len(STATES))).alias("state"), at)
    number = epoch * AUCTIONS + (place - PERSONS)
    auction = n.filter((place >= PERSONS) & (place < PERSONS + AUCTIONS)).select((number + 1000).alias("id"), F.concat(F.lit("item "), number.cast("string")).alias("itemname"), _draw(seed, 3, 1000).alias("initialbid"), (_draw(seed, 3, 1000) + _draw(seed, 4, 1000)).alias("reserve"), (at + 20_000 + _draw(seed, 5, 100_000)).alias("expires"), (F.pmod(F.xxhash64(F.lit(seed), F.lit(6), F.col("n")), last_person) + 1000).alias("seller"), (FIRST_CATEGORY + _draw(seed, 7, CATEGORIES)).alias("category"), at)
    channel = _pick(CHANNELS, _draw(seed, 8, len(CHANNELS)))
    bid = n.filter(place >= PERSONS + AUCTIONS).select((F.pmod(F.xxhash64(F.lit(seed), F.lit(9), F.col("n")), last_auction) + 1000).alias("auction"), (F.pmod(F.xxhash64(F.lit(seed), F.lit(10), F.col("n")), last_person) + 1000).alias("bidder"), _draw(seed, 11, PRICES).alias("price"), channel.alias("channel"), F.concat(F.lit("https://www.example.com/"), F.lower(channel), F.lit("/item.htm?query=1&channel_id="), _draw(seed, 12, 10_000).cast("string")).alias("url"), at)
    return {"person": person, "auction": auction, "bid": bid}


#: The three tables over the driver's star schema, for Spark and DuckDB alike.
DERIVED = {
    "bid": """SELECT event_id, event_id % 199 + 1 AS auction, user_id AS bidder, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS price, event_type AS channel,
              concat('https://www.example.com/', event_type, '/', CAST(event_id % 7 AS VARCHAR(9)), '/item.htm') AS url, {ms} AS datetime FROM events""",
    "auction": """SELECT p_partkey AS id, p_name AS itemname, p_partkey % 50 + 1 AS seller, CAST(10 + p_size % 5 AS BIGINT) AS category, p_partkey * 3600000 % 864000000 + 1704067200000 AS datetime,
                  p_partkey * 3600000 % 864000000 + 1704067200000 + 864000000 AS expires FROM part""",
    "person": """SELECT c_custkey AS id, c_name AS name, concat('city ', CAST(c_nationkey AS VARCHAR(9))) AS city, CASE c_nationkey % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'ID' WHEN 2 THEN 'CA' ELSE 'WA' END AS state,
                 c_custkey * 1800000 % 864000000 + 1704067200000 AS datetime FROM customer""",
}


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {}
    for name, source in (("bid", "events"), ("auction", "part"), ("person", "customer")):
        sql = DERIVED[name].format(ms="unix_millis(CAST(ts AS TIMESTAMP))").replace(f"FROM {source}", f"FROM parquet.`{sf_dir}/{source}.parquet`")
        out[name] = spark.sql(sql)
    return out
