"""SQL scripts, the catalog, refusals and connectors."""

import json

import pytest

from millrace import dialect
from millrace.catalog import Catalog, Table
from millrace.errors import Refused
from millrace.operators import ml
from millrace.session import Engine, TableApi
from millrace.sources import connectors
from millrace.types import decimal_result, parse_type


@pytest.fixture
def engine(spark, sf_dir):
    e = Engine(spark)
    e.run_script(
        f"""
        CREATE TABLE ev (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type TEXT, value DOUBLE, props TEXT) WITH (connector='parquet', path='{sf_dir}/events.parquet');
        CREATE TABLE bid (auction BIGINT, bidder BIGINT, price BIGINT, channel VARCHAR(20), url VARCHAR, datetime BIGINT) WITH (connector='nexmark', events='2000');
        """
    )
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.query(sql).collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("BIGINT", "bigint"), ("INT4", "int"), ("SMALLINT", "smallint"), ("REAL", "float"), ("DOUBLE PRECISION", "double"), ("VARCHAR(10)", "string"), ("TIMESTAMP(3)", "timestamp_ntz"),
        ("TIMESTAMPTZ", "timestamp"), ("NUMERIC", "decimal(38,9)"), ("DECIMAL(10,2)", "decimal(10,2)"), ("BYTEA", "binary"), ("INT[][]", "array<array<int>>"), ("MULTISET<TEXT>", "array<string>"),
        ("MAP<TEXT, BIGINT[]>", "map<string,array<bigint>>"), ("ROW<city TEXT, zip INT>", "struct<city:string,zip:int>"), ("TIME", "time(6)"),
    ],
)
def test_types(text, want):
    assert parse_type(text).simpleString() == want


@pytest.mark.parametrize("text", ["INTERVAL", "JSONB", "DECIMAL(39,2)", "MAP<TEXT>"])
def test_types_refused(text):
    with pytest.raises(Refused):
        parse_type(text)


def test_decimal_results():
    assert decimal_result("/", (10, 2), (10, 2)) == (18, 6)
    assert decimal_result("*", (10, 2), (10, 2)) == (21, 4)
    assert decimal_result("+", (38, 9), (38, 9)) == (38, 9)


BATTERY = [
    "SELECT k FROM t GROUP BY ROLLUP (k)", "SELECT sum(v) FILTER (WHERE v > 0) FROM t", "SELECT DISTINCT ON (k) k FROM t", "SELECT * FROM t TABLESAMPLE (10 PERCENT)",
    "WITH RECURSIVE r AS (SELECT 1) SELECT * FROM r", "SELECT k FROM t ORDER BY k FETCH FIRST 1 ROWS WITH TIES", "SELECT sum(v) OVER w FROM t WINDOW w AS (ORDER BY k)", "SELECT k FROM t FOR UPDATE",
    "SELECT k FROM t HAVING k > 1", "SELECT k FROM t ORDER BY k", "SELECT k INTO x FROM t", "SELECT * FROM t CROSS JOIN u", "SELECT * FROM t NATURAL JOIN u", "SELECT * FROM t JOIN u USING (k)",
    "SELECT lead(v) OVER (ORDER BY k) FROM t", "SELECT sum(v) OVER (ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) FROM t", "SELECT k FROM t WHERE s ILIKE 'a'", "SELECT now() FROM t", "SELECT k FROM t OFFSET 2",
]


@pytest.mark.parametrize("sql", BATTERY)
def test_refusals(sql):
    with pytest.raises(Refused):
        dialect.refuse(sql)


def test_quoted_text_is_not_refused():
    dialect.refuse("SELECT 'CROSS JOIN now()' AS a FROM t -- ILIKE")


def test_statements():
    assert dialect.statements("SELECT ';' AS a; -- x;\n SELECT 2;") == ["SELECT ';' AS a", "SELECT 2"]


@pytest.mark.parametrize("window, sql", [("TUMBLE(datetime, INTERVAL '1' SECOND)", "datetime // 1000 * 1000"), ("TUMBLE(datetime, 500)", "datetime // 500 * 500")])
def test_tumble(engine, window, sql):
    got = rows(engine, f"SELECT window_start, window_end, count(*) AS n FROM bid GROUP BY {window}")
    want = rows(engine, f"SELECT {sql.replace('//', 'DIV')} AS s, count(*) AS n FROM bid GROUP BY 1")
    assert sorted((a, n) for a, _, n in got) == sorted(want)


def test_hop_and_cumulate(engine):
    total = rows(engine, "SELECT count(*) FROM bid")[0][0]
    assert sum(r[1] for r in rows(engine, "SELECT window_start, count(*) AS n FROM bid GROUP BY HOP(datetime, 1000, 500)")) == 2 * total
    got = rows(engine, "SELECT window_start, window_end, count(*) AS n FROM bid GROUP BY CUMULATE(datetime, 500, 1000)")
    assert sum(n for a, b, n in got if b - a == 1000) == total
    with pytest.raises(Refused):
        engine.query("SELECT count(*) AS n FROM bid GROUP BY HOP(datetime, 500, 1000)")


def test_session_splits_at_the_gap(engine, tmp_path):
    (tmp_path / "s.json").write_text("".join(json.dumps({"k": 1, "ts": t}) + "\n" for t in (0, 10_000, 15_000)))
    engine.execute(f"CREATE TABLE s (k BIGINT, ts BIGINT) WITH (connector='file', format='json', path='{tmp_path}/s.json')")
    assert sorted(rows(engine, "SELECT window_start, window_end, count(*) AS n FROM s GROUP BY SESSION(ts, INTERVAL '10' SECOND), k")) == [(0, 10_000, 1), (10_000, 25_000, 2)]


def test_top_n_drops_the_rank(engine):
    df = engine.query("SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM ev) WHERE rn <= 1")
    assert "rn" not in df.columns and df.count() == engine.query("SELECT DISTINCT user_id FROM ev").count()


def test_functions(engine):
    assert rows(engine, "SELECT length('é'), split_index('a,b', ',', 1), split_part('a,b', ',', 9), round(-2.5), floor(1.5), regexp_extract('ab12', '[0-9]+'), substring('abc', -1, 2), json_value('{\"a\":[1]}', '$.a'), CAST('x' AS INT) FROM ev LIMIT 1") == [(2, "b", "", -3.0, 1.0, "12", "ab", None, None)]
    assert rows(engine, r"SELECT 'a\b' LIKE 'a\b', 'ab' LIKE 'a_' FROM ev LIMIT 1") == [(True, True)]


def test_match_recognize(engine):
    sql = "SELECT * FROM ev MATCH_RECOGNIZE (PARTITION BY user_id ORDER BY event_id MEASURES FIRST(a.event_id) AS a, LAST(b.event_id) AS b, CLASSIFIER() AS c {} PATTERN (a b) DEFINE a AS event_type = 'click', b AS event_type = 'purchase')"
    one, every = engine.query(sql.format("")), engine.query(sql.format("ALL ROWS PER MATCH"))
    assert one.count() and every.count() == 2 * one.count() and {r["c"] for r in every.collect()} == {"a", "b"}


def test_models_vectors_and_table_functions(engine, sf_dir):
    ml.register_provider("double", lambda o: lambda b: b.assign(y=b["x"] * 2))
    engine.run_script("CREATE MODEL m INPUT (x DOUBLE) OUTPUT (y DOUBLE) WITH (provider='double')")
    assert all(r["y"] == 2 * r["value"] for r in engine.query("SELECT value, y FROM ML_PREDICT(TABLE ev, MODEL m, DESCRIPTOR(value))").collect() if r["value"] is not None)
    engine.run_script(f"CREATE TABLE c (vec_id BIGINT, embedding FLOAT4[], label INT) WITH (connector='parquet', path='{sf_dir}/embeddings.parquet'); CREATE VIEW q AS SELECT vec_id AS qid, embedding AS qv FROM c WHERE vec_id < 3")
    near = rows(engine, "SELECT qid, vec_id, score FROM VECTOR_SEARCH(TABLE q, qv, c, DESCRIPTOR(embedding), 2, metric=cosine)")
    assert len(near) == 6 and all(any(a == b and s > 0.999 for a, b, s in near) for _ in [0])

    def count(row, state):
        state["n"] = state.get("n", 0) + 1
        yield {"user_id": row["user_id"], "n": state["n"]}

    engine.register_table_function("numbered", count, "user_id long, n long")
    assert max(rows(engine, "SELECT max(n) FROM numbered(TABLE ev PARTITION BY user_id)"))[0] == max(rows(engine, "SELECT max(n) FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)"))[0]


def test_insert_alter_drop(engine, tmp_path):
    engine.run_script(f"CREATE TABLE o (event_type TEXT, n BIGINT) WITH (connector='file', format='json', path='{tmp_path}/o'); INSERT INTO o SELECT event_type, count(*) FROM ev GROUP BY event_type")
    assert sorted(rows(engine, "SELECT * FROM o")) == sorted(rows(engine, "SELECT event_type, count(*) FROM ev GROUP BY event_type"))
    with pytest.raises(Refused):
        engine.execute("INSERT INTO o SELECT event_id, event_id FROM ev")
    engine.run_script("ALTER TABLE o ADD COLUMN z INT; ALTER TABLE o RENAME COLUMN z TO y; ALTER TABLE o ALTER COLUMN y TYPE BIGINT; ALTER TABLE o SET (a='b'); ALTER TABLE o RESET (a); ALTER TABLE o DROP COLUMN y; ALTER TABLE o RENAME TO p")
    assert engine.catalog.get("table", "p").columns == [("event_type", "TEXT"), ("n", "BIGINT")]
    assert dict(engine.execute("ANALYZE TABLE p").data.collect())["row_count"] == 5
    with pytest.raises(Refused):
        engine.execute("DROP VIEW p")
    engine.run_script("DROP TABLE p; DROP TABLE IF EXISTS p")


def test_upsert_table(engine, tmp_path, spark):
    engine.run_script(f"CREATE TABLE u (k BIGINT PRIMARY KEY, v BIGINT) WITH (connector='file', format='json', mode='upsert', path='{tmp_path}/u')")
    engine.run_script("INSERT INTO u SELECT event_id % 3, CAST(1 AS BIGINT) FROM ev WHERE event_id < 3; INSERT INTO u SELECT event_id + 1, CAST(9 AS BIGINT) FROM ev WHERE event_id = 0")
    from millrace.streaming.runtime import current

    assert sorted(map(tuple, current(engine.spark, f"{tmp_path}/u").collect())) == [(0, 1), (1, 9), (2, 1)]


def test_views_and_functions(engine):
    engine.run_script("CREATE VIEW clicks(id) AS SELECT event_id FROM ev WHERE event_type = 'click'; CREATE FUNCTION plus1(a BIGINT) RETURNS BIGINT LANGUAGE SQL AS 'a + 1'")
    assert rows(engine, "SELECT min(plus1(id)) FROM clicks")[0][0] == rows(engine, "SELECT min(event_id) + 1 FROM ev WHERE event_type = 'click'")[0][0]
    engine.run_script("CREATE MATERIALIZED VIEW mv AS SELECT event_type, count(*) AS n FROM ev GROUP BY event_type; REFRESH MATERIALIZED VIEW mv")
    assert engine.query("SELECT * FROM mv").count() == 5
    with pytest.raises(Refused):
        engine.execute("DROP VIEW mv")
    engine.run_script("DROP MATERIALIZED VIEW mv; DROP FUNCTION plus1; DROP VIEW clicks")
    assert "Relation" in "\n".join(r[0] for r in engine.execute("EXPLAIN SELECT * FROM ev").data.collect())


def test_table_api_and_arrow(engine, tmp_path):
    from pyspark.sql import functions as F

    engine.execute("CREATE TABLE out (event_type TEXT, n BIGINT) WITH (connector='collect')")
    got = TableApi.from_table(engine, "ev").filter("value > 0").group_by("event_type").aggregate(F.count("*").alias("n")).insert_into("out")
    assert got.arrow().num_rows == 5


def test_catalog_is_kept(tmp_path):
    c = Catalog(str(tmp_path / "c.json"))
    c.add("table", Table("T", [("a", "INT")], {"connector": "print"}))
    assert Catalog(str(tmp_path / "c.json")).get("table", "t").columns == [("a", "INT")]
    with pytest.raises(Refused):
        c.add("table", Table("t", [("a", "INT")]))


def test_connector_options():
    assert connectors.kafka_options({"brokers": "b:1", "topic": "t"}) == {"kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "earliest"}
    assert connectors.jdbc_options({"connector": "postgres", "host": "h", "port": "1", "database": "d", "table": "t"}) == {"url": "jdbc:postgresql://h:1/d", "dbtable": "t"}
    with pytest.raises(Refused):
        connectors.check_sink(Table("t", [("a", "INT")], {"connector": "redis"}), "append", "exactly_once")
    with pytest.raises(Refused):
        connectors.check_sink(Table("t", [("a", "INT")], {"connector": "redis"}), "upsert", None)
    with pytest.raises(Refused):
        connectors._client("nats", {}, "read")


def test_bulk_bodies():
    r = [{"a": 1, "b": "x"}]
    assert connectors.bulk_body("elasticsearch", r, {"index": "i"}) == b'{"index":{"_index":"i"}}\n{"a":1,"b":"x"}\n'
    assert connectors.bulk_body("influxdb", r, {"measurement": "m", "tags": "b"}) == b"m,b=x a=1"
    assert connectors.bulk_body("prometheus", r, {"metric": "m", "value": "a"}) == b'm{b="x"} 1\n'
    assert connectors.bulk_body("splunk_hec", r, {}) == b'{"event":{"a":1,"b":"x"}}'


def test_dead_letters(spark):
    from pyspark.sql.types import StructType

    good, bad = connectors.from_lines(spark.createDataFrame([('{"a": 1}',), ("no json",)], "value string"), StructType.fromDDL("a long"))
    assert [tuple(r) for r in good.collect()] == [(1,)] and [r[0] for r in bad.collect()] == ["no json"]


def test_registered_client(spark):
    connectors.register_client("redis", "read", lambda o: [('{"a": 5}',)])
    t = Table("t", [("a", "BIGINT")], {"connector": "redis"})
    assert connectors.read(spark, t).first()[0] == 5


def test_python_functions(engine):
    engine.register_function("twice", lambda s: s * 2, "BIGINT")
    engine.register_aggregate("spread", lambda v: float(v.max() - v.min()), "DOUBLE")
    assert rows(engine, "SELECT max(twice(event_id)) FROM ev")[0][0] == 2 * rows(engine, "SELECT max(event_id) FROM ev")[0][0]
    assert rows(engine, "SELECT spread(value) FROM ev")[0][0] == pytest.approx(rows(engine, "SELECT max(value) - min(value) FROM ev")[0][0])


def test_lineage(engine):
    got = engine.lineage("SELECT event_type, sum(value) AS s, count(*) AS n FROM (SELECT event_type, value * event_id AS value FROM ev) x GROUP BY event_type")
    assert got == {"event_type": {"ev.event_type"}, "s": {"ev.value", "ev.event_id"}, "n": set()}


@pytest.mark.parametrize("sql", ["SELECT user_id, count(*) FROM live GROUP BY user_id", "SELECT DISTINCT user_id, user_id FROM live", "SELECT a.user_id, a.user_id FROM live a JOIN live b ON a.user_id = b.user_id"])
def test_unbounded_state_is_refused(engine, tmp_path, sf_dir, sql):
    engine.run_script(f"CREATE TABLE live (user_id BIGINT) WITH (connector='parquet', path='{sf_dir}/events.parquet', unbounded='true'); CREATE TABLE sink (a BIGINT, n BIGINT) WITH (connector='parquet', path='{tmp_path}/o')")
    with pytest.raises(Refused):
        engine.stream(f"INSERT INTO sink {sql}")


def test_streams_and_their_state(engine, tmp_path, sf_dir):
    from millrace.streaming.state import export_state, read_state, state_diff

    engine.run_script(f"CREATE TABLE live (user_id BIGINT, ts TIMESTAMP) WITH (connector='parquet', path='{sf_dir}/events.parquet', unbounded='true', event_time_column='ts'); CREATE TABLE sink (user_id BIGINT PRIMARY KEY, n BIGINT) WITH (connector='parquet', mode='upsert', path='{tmp_path}/o')")
    q = engine.stream("INSERT INTO sink SELECT user_id, count(*) FROM live GROUP BY user_id ALLOW UNBOUNDED STATE", f"{tmp_path}/c")
    q.awaitTermination()
    assert q.exception() is None
    from millrace.streaming.runtime import current

    got = sorted(map(tuple, current(engine.spark, f"{tmp_path}/o").collect()))
    assert got == sorted(rows(engine, "SELECT user_id, count(*) FROM ev GROUP BY user_id"))
    state = read_state(engine.spark, f"{tmp_path}/c")
    assert state.count() == len(got) and state_diff(state.limit(0), state).count() == len(got)
    export_state(engine.spark, f"{tmp_path}/c", f"{tmp_path}/p")
    assert engine.spark.read.parquet(f"{tmp_path}/p").count() == len(got)


def test_joins_name_columns_by_alias(engine):
    df = engine.query("SELECT * FROM ev a JOIN ev b ON a.event_id = b.event_id")
    assert df.columns[:2] == ["a_event_id", "a_ts"] and "b_event_type" in df.columns


@pytest.mark.parametrize("sql", ["SELECT uuid, following, random, now FROM t", "SELECT t.uuid FROM t WHERE following > 1", "SELECT * FROM t JOIN u ON t.k = u.k AND t.v <= u.v", "SELECT k, v FROM t WHERE k IN (1, 2)", "SELECT a.k, b.v FROM t a LEFT JOIN u b ON a.k = b.k WHERE a.v < 2"])
def test_words_and_joins_that_are_not_refused(sql):
    dialect.refuse(sql)


@pytest.mark.parametrize("sql", ["SELECT * FROM t JOIN u ON t.k < u.k", "SELECT * FROM t LEFT JOIN u ON t.k <> u.k WHERE t.k = 1", "SELECT * FROM t a, u b", "SELECT * FROM t, u WHERE t.k = u.k", "SELECT sum(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) FROM t", "SELECT uuid() FROM t", "SELECT current_date FROM t"])
def test_joins_and_calls_that_are_refused(sql):
    with pytest.raises(Refused):
        dialect.refuse(sql)


def test_create_table_if_not_exists_watermark_and_keys(engine):
    engine.run_script("CREATE TABLE IF NOT EXISTS ev (x BIGINT) WITH (connector='blackhole')")
    assert [n for n, _ in engine.catalog.get("table", "ev").columns][0] == "event_id"
    with pytest.raises(Refused):
        engine.run_script("CREATE TABLE ev (x BIGINT) WITH (connector='blackhole')")
    engine.run_script("CREATE TABLE marked (k BIGINT, ts TIMESTAMP, WATERMARK FOR ts AS ts - INTERVAL '5' SECOND, CONSTRAINT pk PRIMARY KEY (k)) WITH (connector='blackhole')")
    made = engine.catalog.get("table", "marked")
    assert (made.options["event_time_column"], made.options["watermark_lag_ms"], made.primary_key) == ("ts", "5000", ["k"])
    engine.run_script("CREATE TABLE keyed (k BIGINT, v BIGINT) WITH (connector='blackhole', primary_key='k')")
    assert engine.catalog.get("table", "keyed").primary_key == ["k"]
    for bad in ("WATERMARK FOR none AS none", "CONSTRAINT c CHECK (k > 0)", "WATERMARK FOR ts AS f(ts)"):
        with pytest.raises(Refused):
            engine.run_script(f"CREATE TABLE bad (k BIGINT, ts TIMESTAMP, {bad}) WITH (connector='blackhole')")


def test_an_upserted_table_gives_its_newest_rows(engine, tmp_path):
    engine.run_script(f"CREATE TABLE up (k BIGINT, v BIGINT, PRIMARY KEY (k)) WITH (connector='file', format='json', path='file://{tmp_path}/up', mode='upsert')")
    assert rows(engine, "SELECT * FROM up") == []
    engine.run_script("INSERT INTO up SELECT k, v FROM VALUES (1L, 10L), (2L, 20L) AS x(k, v)")
    engine.run_script("INSERT INTO up SELECT k, v FROM VALUES (2L, 21L), (3L, 30L) AS x(k, v)")
    assert sorted(rows(engine, "SELECT * FROM up")) == [(1, 10), (2, 21), (3, 30)]


def test_arithmetic_gives_null_where_it_does_not_fit(engine):
    engine.execute("CREATE VIEW n AS SELECT a, b, d, ts FROM VALUES (9223372036854775807L, 0L, 1.5D, TIMESTAMP '2024-01-01 00:00:10'), (7L, 2L, NULL, NULL) AS x(a, b, d, ts)")
    got = rows(engine, "SELECT a + 1 AS p, a * 2 AS m, a - -1 AS s, a % b AS r, a DIV b AS q, a / b AS f, d * 2 - 1 AS d, CASE WHEN b = 2 THEN a * b + 1 END AS c FROM n")
    assert sorted(got, key=str) == sorted([(None, None, None, None, None, None, 2.0, None), (8, 14, 8, 1, 3, 3.5, None, 15)], key=str)
    assert rows(engine, "SELECT 20 - 2 * 3 - 4 + 10 % 4 * 2 AS x, -(2 + 3) * 2 AS y, 'a' || 'b' AS z FROM n WHERE a - 7 = 0") == [(14, -10, "ab")]
    assert str(rows(engine, "SELECT ts - INTERVAL '5' SECOND AS t FROM n WHERE b = 0")[0][0]) == "2024-01-01 00:00:05"
    assert rows(engine, "SELECT b + 1 AS k, count(*) * 2 AS n FROM n WHERE a > b * 1 GROUP BY b + 1 HAVING count(*) + 1 > 1 ORDER BY k LIMIT 5") == [(1, 2), (3, 2)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT t.*, count(*) FROM t", "SELECT t.*, count(*) FROM t"),
        ("a - b * c + d", "try_add(try_subtract(a, try_multiply(b, c)), d)"),
        ("transform(a, x -> x + 1)", "transform(a , x -> try_add(x, 1))"),
        ("a::int - 3", "try_subtract(a::int, 3)"),
        ("date - 1", "try_subtract(date, 1)"),
        ("v BETWEEN -1 AND left(s, n - 1)", "v BETWEEN -1 AND left(s , try_subtract(n, 1))"),
        ("sum(v) OVER (ORDER BY k) / 2", "try_divide(sum(v) OVER (ORDER BY k), 2)"),
        ("'1 + 1'", "'1 + 1'"),
    ],
)
def test_arithmetic_rewriting(text, want):
    tight = lambda s: s.replace(" ,", ",")
    assert tight(dialect.arithmetic(text)) == tight(want)


@pytest.mark.parametrize("kind", ["DATE", "TIMESTAMP", "timestamp(3)", "BYTEA"])
def test_casts_that_are_refused(kind):
    with pytest.raises(Refused):
        dialect.refuse(f"SELECT CAST(upper(s) AS {kind}) AS x FROM t")
    dialect.refuse("SELECT CAST(s AS INT) AS date FROM (SELECT CAST(v AS TEXT) AS timestamp FROM t)")


def test_streams_append_exactly_once(engine, tmp_path, sf_dir):
    from millrace.streaming.runtime import STATE_PROVIDER

    (tmp_path / "in").mkdir()
    engine.run_script(f"CREATE TABLE live (k BIGINT, v BIGINT) WITH (connector='parquet', path='file://{tmp_path}/in/*', unbounded='true'); CREATE TABLE sink (k BIGINT, v BIGINT) WITH (connector='parquet', path='file://{tmp_path}/o', delivery='exactly_once')")
    before = engine.spark.conf.get(STATE_PROVIDER)
    for n in (10, 5):
        engine.spark.range(n).selectExpr("id AS k", "id AS v").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        for _ in range(2):  # a restart from the checkpoint writes nothing twice
            q = engine.stream("INSERT INTO sink SELECT k, v * 2 FROM live", f"{tmp_path}/c")
            q.awaitTermination()
            assert q.exception() is None
    assert sorted(rows(engine, "SELECT * FROM sink")) == sorted([(k, 2 * k) for k in range(10)] + [(k, 2 * k) for k in range(5)])
    assert engine.spark.conf.get(STATE_PROVIDER) == before
    with pytest.raises(Refused):
        engine.execute("INSERT INTO sink SELECT user_id, event_id FROM ev")
    with pytest.raises(Refused):
        engine.stream("INSERT INTO sink SELECT k, v FROM live")


def test_a_standing_stream_takes_what_arrives(engine, tmp_path):
    (tmp_path / "in").mkdir()
    engine.run_script(f"CREATE TABLE live (k BIGINT) WITH (connector='parquet', path='file://{tmp_path}/in/*', unbounded='true'); CREATE TABLE sink (k BIGINT) WITH (connector='parquet', path='file://{tmp_path}/o')")
    engine.spark.range(3).selectExpr("id AS k").coalesce(1).write.parquet(f"file://{tmp_path}/in/a")
    q = engine.stream("INSERT INTO sink SELECT k FROM live", f"{tmp_path}/c", every="200 milliseconds")
    try:
        q.processAllAvailable()
        engine.spark.range(3, 5).selectExpr("id AS k").coalesce(1).write.parquet(f"file://{tmp_path}/in/b")
        q.processAllAvailable()
        assert q.isActive and sorted(rows(engine, "SELECT k FROM sink")) == [(k,) for k in range(5)]
    finally:
        q.stop()


def test_database_upserts_need_a_client(spark):
    t = Table("t", [("a", "BIGINT")], {"connector": "postgres", "mode": "upsert"}, ["a"])
    with pytest.raises(Refused):
        connectors.write(spark.range(1).toDF("a"), t, "upsert")


def widest(values):
    """Named by CREATE AGGREGATE below."""
    return float(values.max() - values.min())


def test_aggregates_by_name_of_their_function(engine):
    engine.execute(f"CREATE OR REPLACE AGGREGATE widest(x DOUBLE) RETURNS DOUBLE LANGUAGE python AS '{__name__}:widest'")
    assert rows(engine, "SELECT widest(value) FROM ev")[0][0] == pytest.approx(rows(engine, "SELECT max(value) - min(value) FROM ev")[0][0])
    for sql in ("CREATE AGGREGATE widest(x DOUBLE) RETURNS DOUBLE LANGUAGE python AS 'a:b'", "CREATE AGGREGATE w2(x DOUBLE) RETURNS DOUBLE LANGUAGE wasm AS 'a:b'", "CREATE AGGREGATE w2(x DOUBLE) RETURNS DOUBLE LANGUAGE python AS 'nothing.there:b'"):
        with pytest.raises(Refused):
            engine.execute(sql)
