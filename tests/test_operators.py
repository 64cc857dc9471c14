"""Operators that have no SQL twin: patterns, keyed programs, lookups, iteration, changelogs, stateful streams."""

import datetime
import json
import time
from itertools import islice

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.errors import Refused
from millrace.functions import aggregates
from millrace.operators import joins, keyed, setops, vector, windows
from millrace.operators.cep import Matcher, Pattern, sequence_pattern
from millrace.operators.dataflow import Stream
from millrace.plans import catalogue, streams
from millrace.streaming import runtime, stateful


def run(pattern, text, step=1):
    """Matches of a pattern over letters: the places that each step took."""
    m = Matcher(pattern, lambda r: r["t"])
    out = []
    for k, c in enumerate(text):
        out += m.advance({"c": c, "t": k * step, "k": k})[0]
    return [{n: [r["k"] for r in rows] for n, rows in x.items()} for x in out + m.finish()[0]]


def is_(c):
    return lambda r: r["c"] == c


def test_next_is_strict_and_followed_by_is_not():
    strict = Pattern.begin("a").where(is_("a")).next("b").where(is_("b"))
    loose = Pattern.begin("a").where(is_("a")).followed_by("b").where(is_("b"))
    assert run(strict, "axbab") == [{"a": [3], "b": [4]}]
    assert run(loose, "axb") == [{"a": [0], "b": [2]}]


def test_negative_steps():
    p = Pattern.begin("a").where(is_("a")).not_next("n").where(is_("x")).followed_by("b").where(is_("b"))
    assert run(p, "axb") == [] and run(p, "ayb") == [{"a": [0], "b": [2]}]
    q = Pattern.begin("a").where(is_("a")).not_followed_by("n").where(is_("x")).followed_by("b").where(is_("b"))
    assert run(q, "ayxb") == [] and run(q, "ayyb") == [{"a": [0], "b": [3]}]


def test_trailing_not_followed_by_needs_within():
    p = Pattern.begin("a").where(is_("a")).not_followed_by("n").where(is_("x"))
    with pytest.raises(Refused):
        Matcher(p)
    assert run(p.within(2), "ayyyy") == [{"a": [0]}] and run(p.within(2), "ayxyy") == []


def test_quantifiers():
    more = Pattern.begin("a").where(is_("a")).one_or_more().next("b").where(is_("b"))
    assert run(more.after_match_skip("past_last"), "aaab") == [{"a": [0, 1, 2], "b": [3]}]
    assert run(Pattern.begin("a").where(is_("a")).times(2).next("b").where(is_("b")), "aaab") == [{"a": [1, 2], "b": [3]}]
    maybe = Pattern.begin("a").where(is_("a")).next("m").where(is_("m")).optional().next("b").where(is_("b"))
    assert run(maybe, "ab") == [{"a": [0], "b": [1]}] and run(maybe, "amb") == [{"a": [0], "m": [1], "b": [2]}]


def test_within_bounds_the_span():
    p = Pattern.begin("a").where(is_("a")).followed_by("b").where(is_("b")).within(2)
    assert run(p, "axb") == [{"a": [0], "b": [2]}] and run(p, "axxb") == []


def test_iterative_condition():
    p = Pattern.begin("a").where(is_("a")).followed_by("b").where(lambda r, m: r["k"] - m["a"][0]["k"] == 2)
    assert run(p, "axyz") == [{"a": [0], "b": [2]}]


def test_patterns_refused():
    for bad in (lambda: Pattern.begin("a").next("a").validate(), lambda: Pattern.begin("a").not_next("n").one_or_more(), lambda: sequence_pattern("(a b)+", {}), lambda: sequence_pattern("a+? b", {}), lambda: Pattern.begin("a").after_match_skip("to_first")):
        with pytest.raises(Refused):
            bad()


def test_sequence_is_greedy_and_skips_past_the_last_row():
    p = sequence_pattern("s d+ u", {"d": lambda r, m: r["c"] == "d", "u": lambda r, m: r["c"] == "u"})
    assert run(p, "xddudu") == [{"s": [0], "d": [1, 2], "u": [3]}]


def test_keyed_program_sees_keys_in_order(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(30)], "k long, v long")

    class Sum:
        def __init__(self):
            self.n = []

        def row(self, r):
            self.n.append(r["v"])
            self.k = r["k"]
            return ()

        def finish(self):
            yield {"k": self.k, "text": ",".join(map(str, self.n))}

    got = {r["k"]: r["text"] for r in keyed.run_keyed(df, ["k"], [F.col("v")], Sum, "k long, text string").collect()}
    assert got == {k: ",".join(str(v) for v in range(30) if v % 3 == k) for k in range(3)}


def test_lookup_retries_and_order(spark):
    df = spark.createDataFrame([(k,) for k in range(20)], "k long").coalesce(1)
    assert [r["w"] for r in joins.lookup(df, lambda r: {"w": r["k"] * 2} if r["k"] % 2 else None, "w long", "left").collect()] == [k * 2 if k % 2 else None for k in range(20)]
    with pytest.raises(Refused):
        joins.lookup(df, lambda r: None, "w long", "full")


def test_changelog_round_trip(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    b = spark.createDataFrame([(2, "b"), (3, "d"), (4, "e")], "k long, v string")
    log = setops.changelog(a, b, ["k"])
    assert sorted(tuple(r) for r in log.collect()) == [(1, "a", "delete"), (3, "c", "update_before"), (3, "d", "update_after"), (4, "e", "insert")]
    both = a.withColumn(setops.ROW_KIND, F.lit("insert")).unionByName(log)
    assert sorted(tuple(r) for r in setops.net(both).collect()) == sorted(tuple(r) for r in b.collect())


def test_set_operations_refuse_other_types(spark):
    with pytest.raises(Refused):
        setops.union_all(spark.range(1), spark.createDataFrame([("a",)], "id string"))


def test_split_side_output_and_broadcast(spark):
    s = Stream(spark.range(10))
    parts = s.split(even=F.col("id") % 2 == 0, small=F.col("id") < 3)
    assert parts["even"].df.count() == 5 and parts["small"].df.count() == 3
    main, side = s.side_output(F.col("id") > 7)
    assert main.df.count() == 8 and side.df.count() == 2
    state = spark.createDataFrame([(1, "x")], "id long, name string")
    assert s.broadcast_connect(state, [("id", "id")]).df.filter("state_name = 'x'").count() == 1


def test_connect_two_inputs(spark):
    a, b = Stream(spark.range(3)).key_by("id"), Stream(spark.range(2)).key_by("id")

    class Both:
        def __init__(self):
            self.seen = []

        def row(self, r):
            self.seen.append(r["_input"])
            self.id = r["id"]
            return ()

        def finish(self):
            yield {"id": self.id, "n": len(self.seen)}

    got = a.connect(b, [F.col("_input")], Both, "id long, n int").df.collect()
    assert sorted(tuple(r) for r in got) == [(0, 2), (1, 2), (2, 1)]


def test_iterate_stops_and_caps(spark):
    s = Stream(spark.createDataFrame([(5,), (40,)], "x long"))
    out = s.iterate(lambda df: df.select((F.col("x") - 10).alias("x")), F.col("x") > 0, 2)
    assert sorted(r[0] for r in out.df.collect()) == [-5, 20]


def test_vector_filters_and_ragged_rows(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, [1.0], "a"), (4, None, "a")], "id long, v array<double>, t string")
    q = spark.createDataFrame([(9, [1.0, 0.1], "b"), (8, [1.0, 0.1], None)], "q long, w array<double>, u string")
    got = {(r["q"], r["id"]) for r in vector.search(q, "q", "w", c, "id", "v", 1, "cosine", [("u", "t")]).collect()}
    assert got == {(9, 2), (8, 1)}
    with pytest.raises(Refused):
        vector.search(q, "q", "w", c, "id", "v", 1, "hamming")


def test_windows_before_the_epoch(spark):
    df = spark.createDataFrame([(datetime.datetime(1969, 12, 31, 23, 59, 59, 500000),)], "ts timestamp_ntz")
    assert windows.tumble(df, "ts", 1000, [], F.count("*").alias("n")).select("window_start").first()[0] == -1000
    with pytest.raises(Refused):
        windows.hop(df, "ts", 1000, 2000, [], F.count("*").alias("n"))
    with pytest.raises(Refused):
        windows.cumulate(df, "ts", 300, 1000, [], F.count("*").alias("n"))


def events(spark, tmp_path, *batches, lateness_ms=0):
    """A stream with a file for each micro-batch; rows are (k, second)."""
    for n, rows in enumerate(batches):
        (tmp_path / f"{n}.json").write_text("".join(json.dumps({"k": k, "ts": f"2024-01-01T00:00:{s:02d}"}) + "\n" for k, s in rows))
        import os

        os.utime(tmp_path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    from pyspark.sql.types import StructType

    return runtime.with_event_time(runtime.read_files(spark, f"{tmp_path}/*.json", StructType.fromDDL("k long, ts timestamp"), 1, "json"), "ts", 0, lateness_ms)


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    df = events(spark, tmp_path, [(1, 1), (1, 2)], [(1, 25)], [(1, 26)], [(1, 3)], [(1, 58)])
    out = runtime.drain(windows.tumble(df, "ts", 10_000, [], F.count("*").alias("n")))
    assert sorted(r["n"] for r in out.collect()) == [2, 2]  # Spark judges lateness by the watermark of the batch before


def test_panes(spark, tmp_path):
    df = events(spark, tmp_path, [(1, 1)], [(2, 12)], [(2, 13)], [(1, 2)], [(2, 40)], [(2, 41)], [(2, 42)], [(1, 3)], [(2, 59)], lateness_ms=15_000)
    out = stateful.process_stream(df, ["k"], lambda: stateful.PaneInfo("k", "ts", 10_000, 15_000), "k long, window_start long, n long, timing string, pane int", "ts", "event")
    assert sorted((r["timing"], r["n"], r["pane"]) for r in runtime.drain(out).collect() if r["k"] == 1) == [("Late", 2, 1), ("OnTime", 1, 0)]


def test_dead_letters_by_watermark(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1), 1), (datetime.datetime(2024, 1, 2), 2)], "ts timestamp, n long")
    good, late = runtime.dead_letters(df, "ts", lambda: 1_704_110_000_000)
    assert [r["n"] for r in good.collect()] == [2] and [r["n"] for r in late.collect()] == [1]


def test_deadline(spark, tmp_path):
    df = events(spark, tmp_path, [(1, 1), (1, 2), (2, 30)], [(2, 31)], [(2, 59)])
    out = runtime.drain(stateful.process_stream(df, ["k"], lambda: stateful.Deadline("k", "ts", 5_000), "k long, n long", "ts", "event"))
    assert (1, 2) in {tuple(r) for r in out.collect()}


def test_upserts_survive_a_repeated_batch(spark, tmp_path):
    sink = runtime.upsert_into(f"file://{tmp_path}/u", ["k"], ["n"])
    one = spark.createDataFrame([(1, 1), (2, 1)], "k long, n long")
    sink(one, 0), sink(one, 0), sink(spark.createDataFrame([(2, 5)], "k long, n long"), 1)
    assert sorted(tuple(r) for r in runtime.current(spark, f"file://{tmp_path}/u").collect()) == [(1, 1), (2, 5)]


@pytest.mark.parametrize("name", ["cosine", "dot", "l2", "filter_eq"])
def test_registered_searches_take_every_hundredth_vector(spark, name):
    sf = "/root/testdata/sf0.1"
    got = catalogue.queries()[f"vector_{name}"](spark, sf).select("query_id").distinct().collect()
    assert {r[0] for r in got} == {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 100 = 0").select("vec_id").collect()}


def test_registered_joins_keep_all_rows_of_both_tables(spark, sf_dir):
    rows = catalogue.queries()["join_full"](spark, sf_dir).select("c_c_custkey", "o_o_orderkey").collect()
    for k, table, key in ((0, "customer", "c_custkey"), (1, "orders", "o_orderkey")):
        assert {r[k] for r in rows} - {None} == {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    assert any(r[0] is None for r in rows) and any(r[1] is None for r in rows)


def test_not_in_of_several_columns_against_brute_force(spark):
    from itertools import product

    values = [None, 1, 2]
    left = list(product(values, values))
    for right in ([], [(1, 2)], [(None, 2), (1, 1)], [(1, None)], [(None, None)], [(2, 2), (None, 1), (2, None)]):
        may = lambda a, b: a is None or b is None or a == b
        want = [x for x in left if not any(all(may(a, b) for a, b in zip(x, y, strict=True)) for y in right)]
        got = joins.not_in(spark.createDataFrame(left, "a int, b int"), spark.createDataFrame(right, "c int, d int"), [("a", "c"), ("b", "d")]).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str), right


def test_failed_calls_wait_longer_each_time():
    times = []

    def fails_twice(row):
        times.append(time.monotonic())
        if len(times) < 3:
            raise OSError
        return row

    assert joins.patient(fails_twice, 2, 0.05)({"k": 1}) == {"k": 1}
    assert times[1] - times[0] >= 0.05 and times[2] - times[1] >= 0.1
    with pytest.raises(OSError):
        joins.patient(lambda row: (_ for _ in ()).throw(OSError()), 1, 0.01)({})


class Range:
    """Accumulator of the least and largest value."""

    def __init__(self):
        self.values = []

    def add(self, v):
        self.values = [min([v, *self.values]), max([v, *self.values])] if v is not None else self.values

    def merge(self, other):
        for v in other.values:
            self.add(v)

    def result(self):
        return self.values[1] - self.values[0] if self.values else None


def test_keyed_programs_get_whole_numbers_next_to_nulls_and_one_group_of_nan(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(float("nan"), 1, big), (float("nan"), 2, None), (1.0, 1, big)], "k double, o long, v long")
    got = keyed.reduce_each(df, ["k"], [F.col("o")], lambda a, b: {**b, "v": a["v"]}, "k double, o long, v long", on_flush=True).collect()
    assert sorted(r["v"] for r in got) == [big, big]


def test_accumulators_merge_over_tasks(spark, monkeypatch):
    rows = [(k if k < 3 else None, 2**60 + v) for v in range(50) for k in range(4)] + [(7, None)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    want = [(7, None), *((k, 49) for k in (0, 1, 2, None))]
    for most in (10_000, 2):  # with few keys held, a key has several states in a task
        monkeypatch.setattr(aggregates, "HELD_KEYS", most)
        got = [tuple(r) for r in aggregates.accumulate(df, ["k"], Range, ["v"], "spread", "bigint").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert aggregates.accumulate(df.limit(0), ["k"], Range, ["v"], "spread", "bigint").count() == 0


def test_retracted_aggregates_forget_what_is_taken_back(spark):
    log = [("a", 5, "insert"), ("a", 9, "insert"), ("a", 9, "delete"), ("b", 1, "insert"), ("b", 1, "delete"), (None, None, None), ("c", 2, "insert"), ("c", 2, "update_before"), ("c", 3, "update_after")]
    df = spark.createDataFrame(log, f"k string, v long, {setops.ROW_KIND} string")
    got = setops.retracted(df, ["k"], "n", {"s": "v"}, {"lo": "v"}, {"hi": "v"}, {"d": "v"}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, 5, 5, 5, 1), ("c", 1, 3, 3, 3, 1), (None, 1, None, None, None, 0)], key=str)
    with pytest.raises(Refused):
        setops.retracted(df, ["k"], "k")


def test_connected_streams_refuse_the_reserved_name(spark):
    df = spark.createDataFrame([(1, 1)], "k long, _input long")
    with pytest.raises(Refused):
        stateful.connect_streams(df, df, ["k"], stateful.CoProcess, "k long")


def test_window_process_streams_each_window_once(spark):
    """Fifty thousand windows; a pandas group for each took minutes. Rows come in order, nulls stay null and NaN stays NaN."""
    many = spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.timestamp_millis(F.col("id") % 2 * 60_000 + F.col("id") % 7).alias("ts"), F.col("id").cast("double").alias("v"))
    seen = lambda rows: ({"k": r["k"], "n": n} for n, r in enumerate(rows))
    began = time.monotonic()
    got = Stream(many).key_by("k").window_process("ts", 60_000, seen, "k long, n int").df
    assert got.count() == 200_000 and got.filter("n = 0").count() == 50_000
    assert time.monotonic() - began < 60
    odd = spark.createDataFrame([(1, 5, None), (1, 3, float("nan")), (1, 9, 2.0), (None, 1, None)], "k long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    first = lambda rows: ({"k": r["k"], "s": r["s"], "v": None if r["v"] is None else str(r["v"])} for r in islice(rows, 2))
    got = {tuple(r) for r in Stream(odd).key_by("k").window_process("ts", 60_000, first, "k long, s long, v string").df.collect()}
    assert got == {(1, 3, "nan"), (1, 5, None), (None, 1, None)}


def test_discrete_percentiles_are_exact_at_a_border_of_equal_values(spark, tmp_path):
    """Of 300,001 values over 8 files one fewer than half are 25: the sketch's ranks can't tell, the query has to."""
    rows = spark.range(0, 300_001, 1, 8).select(F.lit("R").alias("l_returnflag"), F.when(F.col("id") < 150_000, 25.0).otherwise(26.0).alias("l_quantity"))
    border = rows.union(spark.createDataFrame([("A", 25.0)] * 2 + [("A", 26.0)] * 2 + [("N", None), (None, 7.0), (None, float("nan"))], "f string, q double"))
    border.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r[0]: r[1] for r in catalogue.queries()["agg_approx_percentile"](spark, str(tmp_path)).collect()}
    assert got == {"R": 26.0, "A": 25.0, "N": None, None: 7.0}
    assert aggregates.discrete_percentile(border, [], "l_quantity", 0.0, "p").collect()[0][0] == 7.0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_searches_go_by_blocks_and_agree_with_every_pair(spark, monkeypatch, metric):
    """Ties, copies, zero, huge, infinite and NaN vectors, several lengths and blocks, filters that are NULL or NaN; no row for each pair in the plan."""
    nan, inf = float("nan"), float("inf")
    some = [[float((n * 7 + k * k * 3) % 5 - 2) for k in range(4)] for n in range(40)]
    odd = [[0.0] * 4, [nan, 1.0, 0.0, 0.0], [inf, 0.0, 0.0, 1.0], [-inf, 1.0, 0.0, 0.0], [1e200, 1e200, 0.0, 1.0], [1e-200, 0.0, 0.0, 0.0], [1.0, 2.0], [], [1.0, None], None]
    vectors = [*some, *odd, *some[:9], [1e-9, 3.0, -7e5, 0.1]]
    tags = [1.0, nan, None, 2.0]
    c = spark.createDataFrame([(n, v, tags[n % 4]) for n, v in enumerate(vectors)], "id long, v array<double>, t double")
    q = spark.createDataFrame([(n, v, tags[n // 3 % 4]) for n, v in enumerate(vectors)], "q long, w array<double>, u double")
    monkeypatch.setattr(vector, "BLOCK_ROWS", 13)
    found = vector.search(q, "q", "w", c, "id", "v", 3, metric, [("u", "t")])
    assert found.columns == ["q", "w", "u", "id", "v", "t", "score"]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i * j), F.lit(0.0), lambda s, i: s + i)
    minus = F.zip_with("w", "v", lambda i, j: i - j)
    value = {"dot": dot(F.col("w"), F.col("v")), "l2": dot(minus, minus), "cosine": F.try_divide(dot(F.col("w"), F.col("v")), F.sqrt(dot(F.col("w"), F.col("w"))) * F.sqrt(dot(F.col("v"), F.col("v"))))}[metric]
    every = q.crossJoin(c).filter((F.size("w") == F.size("v")) & (F.col("u").isNull() | (F.col("u") == F.col("t")))).withColumn("score", value).filter("score IS NOT NULL")
    best = F.asc("score") if metric == "l2" else F.desc("score")
    want = every.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(best, "id"))).filter("r <= 3").select("q", "id", "score")
    plain = lambda df: sorted((r[0], r[1], repr(r[2])) for r in df.collect())
    assert plain(found.select("q", "id", "score")) == plain(want)


def test_programs_on_streams_get_whole_numbers_and_nan_as_they_are(spark, tmp_path):
    """Through pandas a nullable whole number above 2^53 lost digits and NaN became NULL; rows don't. State goes on over batches."""

    class Seen(stateful.Process):
        n = 0

        def row(self, row):
            self.n += 1
            yield {**row, "n": self.n, "text": str(row["d"])}

    big = 2**53 + 1
    for k, rows in enumerate([[(1, big, None, 0), (1, None, float("nan"), 1)], [(1, big + 2, 1.5, 2)]]):
        spark.createDataFrame(rows, "k long, v long, d double, _at int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    df = runtime.read_files(spark, f"{tmp_path}/s", spark.read.parquet(f"{tmp_path}/s").schema, 1)
    out = runtime.drain(stateful.process_stream(df, ["k"], Seen, "k long, v long, n int, text string", "_at"))
    assert {tuple(r) for r in out.collect()} == {(1, big, 1, "None"), (1, None, 2, "nan"), (1, big + 2, 3, "1.5")}


def test_slices_of_a_stream_are_whole_batches_of_several_files(spark, tmp_path, monkeypatch):
    """Each batch has a slice's rows, all of them, whether a slice is one file or several."""
    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for most, files in ((500_000, 1), (300, 4)):
        monkeypatch.setattr(streams, "FILE_ROWS", most)
        seen, df = {}, streams.stream(spark, str(tmp_path))
        take = lambda b, n, seen=seen: seen.update({n: b.select("event_id", F.input_file_name()).collect()})
        runtime.start(df, take, "append").awaitTermination()
        assert {n: sorted(r[0] for r in got) for n, got in seen.items()} == {n: list(range(n * 1000, n * 1000 + 1000)) for n in range(4)}
        assert {len({r[1] for r in got}) for got in seen.values()} == {files}
