"""Token counts, byte-level BPE, language ID, toxicity and quality rules on small tables."""

import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import bpe, lang_id, quality, token_count, toxicity
from millrace.llm.common import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n\n  x", "a" * 3000, "don't 've it's", "é" * 200, "<|endoftext|> a<|endoftext|><|endoftext|>", "\x1c\x85   x", "𝔘𝔫𝔦 \U0001fac8 ꟍ", "1234567890 12", "!?!? ## --", "ab " * 2000, "ThTh" * 90, "<|endoftext"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(HARD)] + [(3, HARD[3], None, None, None), (None, "no id", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


def test_token_counts_equal_the_library(docs, hard):
    file = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(file)
    for df in (docs, hard):
        texts = [r["text"] for r in df.collect()]
        want = sorted((len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for t in texts)
        got = token_count.count_tokens(df, "doc_id", "text", file, P.PATTERN).collect()
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_token_counts_over_all_common_code_points():
    file = P.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(file), token_count.PieceCounter(file, P.PATTERN)
    for c in map(chr, [*range(0x530), *range(0x2010, 0x205F), *range(0x3001, 0x3100), *range(0xFFF0, 0x10020), 0x558, 0x209D, 0xA7CE]):
        t = f"a{c}1{c}!{c} {c}{c}b"
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), hex(ord(c))


def test_bpe_equals_tiktoken_and_decodes(docs, hard):
    file = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    for df in (docs, hard):
        want = sorted((np.array(lib.encode_ordinary(r["text"] or ""), "<u4").tobytes(), (r["text"] or "").encode()) for r in df.collect())
        got = bpe.round_trip(df, "doc_id", "text", file, P.PATTERN)
        assert sorted((bytes(r["ids"]), bytes(r["decoded"])) for r in got.collect()) == want
        again = bpe.decode(got.select("doc_id", "ids"), "doc_id", "ids", file, P.PATTERN)
        assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted(b for _, b in want)


def test_bpe_generations_and_slices_change_nothing(monkeypatch):
    file = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    monkeypatch.setattr(bpe, "TABLE_SIZE", 5), monkeypatch.setattr(bpe, "SLICE", 2)
    codec = bpe.Codec(file, P.PATTERN)
    for t in ("one two threeish fourish fiveish sixish", "threeish sevenish one eightish", "one two"):
        assert np.frombuffer(codec.encode([t])[0], "<u4").tolist() == lib.encode_ordinary(t)


LONG = {
    "letters": lambda r: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)),
    "words": lambda r: "".join(r.choice(["the", "and", "tion", "house", "xylophone", "in"]) for _ in range(5000)),
    "one letter": lambda r: "x" + "a" * 50_000,
    "two letters": lambda r: "zq" + "ab" * 20_000,
    "seven letters": lambda r: "abcdefg" * 9_000,
    "signs": lambda r: "=" * 10_001 + " " + "-" * 777,
    "ideographs": lambda r: "。".join("".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(40)) for _ in range(85)),
    "common ideographs": lambda r: "".join(r.choice("的一是不了人我在有他") for _ in range(9000)),
    "white space": lambda r: "a" + " " * 5000 + "b" + "\n" * 3000 + " c \t\t d  e ",
    "digits": lambda r: "1234567890" * 3000,
}


@pytest.mark.parametrize("name", LONG)
def test_bpe_of_long_words_equals_tiktoken(name):
    file = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    text = LONG[name](random.Random(name))
    codec = bpe.Codec(file, P.PATTERN)
    ids = codec.encode([text])
    assert np.frombuffer(ids[0], "<u4").tolist() == lib.encode_ordinary(text)
    assert codec.decode(ids) == [text.encode()] and codec.decode([b"", *ids, b""])[1] == text.encode()


def test_bpe_blocks_change_nothing(monkeypatch):
    """Seams in every place of random words, over a few letters so that merges compete."""
    file = P.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(file), special_tokens={})
    r = random.Random(8)
    texts = ["".join(r.choice(s) for _ in range(r.randrange(1, 60))) for s in ("ab", "aeinst", "th e", "=-", "the \n\t", "\u4e00\u4e8c\u00e9") for _ in range(80)]
    for block in (1, 2, 3, 7, 32):
        monkeypatch.setattr(bpe, "BLOCK", block)
        got = bpe.Codec(file, P.PATTERN).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [lib.encode_ordinary(t) for t in texts]
    assert bpe.Codec(file, P.PATTERN, cut=None).encode(texts) == got


def test_bpe_refuses_unknown_ids():
    with pytest.raises(ValueError):
        bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).decode([np.array([60_000], "<u4").tobytes()])


def test_texts_are_cut_only_where_the_pattern_cuts():
    """What the standard library takes for other than white space is no white space to the pattern's engine either."""
    import regex

    assert not [c for c in map(chr, range(0x110000)) if regex.match(r"\s", c) and not re.match(r"\s", c)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert token_count.count_tokens(none, "doc_id", "text", P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert bpe.round_trip(none, "doc_id", "text", P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert lang_id.identify(none, "doc_id", "text", lang_id.learn_dictionaries(none, "doc_id", "text", "lang")).count() == 0
    assert quality.judge_quality(none, quality.learn_rules(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    assert toxicity.score(none, "doc_id", "text", toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_held_out_rule(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_languages(spark, hard):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = lang_id.learn_dictionaries(docs, "doc_id", "text", "lang")
    assert set(known) == {"de", "en", "es", "fr"} and max(map(len, known.values())) <= lang_id.DICTIONARY_BYTES
    got = {r["doc_id"]: r for r in lang_id.identify(docs, "doc_id", "text", known).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    own = [got[k]["lang_pred"] == v for k, v in truth.items() if got[k]["held_out"]]
    assert np.mean(own) > 0.97 and all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in lang_id.identify(hard, "doc_id", "text", known).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[10] == odd[11] == "und" and odd[6] != "und"
    assert {r["lang_pred"] for r in lang_id.identify(hard, "doc_id", "text", {}).collect()} == {"und"}


def test_toxicity(spark, hard):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, "doc_id", "text", model).collect()}
    rows = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    bad, good = ([s for s, y in rows if y == v] for v in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    assert toxicity.score(hard, "doc_id", "text", model).count() == hard.count()


def test_toxicity_scores_agree_when_the_sample_is_bounded(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = docs.join(labels, "doc_id").filter(held_out(F.col("doc_id")))

    def scores():
        model = toxicity.learn(docs, labels)
        return model.bias, {r["doc_id"]: r["score"] for r in toxicity.score(held, "doc_id", "text", model).collect()}

    bias, whole = scores()
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 330)
    again, part = scores()
    truth = {r["doc_id"]: r["toxic"] for r in held.select("doc_id", "toxic").collect()}
    assert abs(again - bias) < 1
    assert np.mean([abs(part[k] - s) for k, s in whole.items()]) < 0.05
    assert sum(part[k] >= 0.3 and y == 0 for k, y in truth.items()) < 20


def test_toxicity_with_one_class_or_none():
    one = toxicity.fit(["a", "b"], np.zeros(2))
    assert len(one.slots) == 0 and one.bias < 0
    s = toxicity.score_texts(pd.Series(["", None, "x" * 60_000]), np.zeros(1 << toxicity.HASH_BITS, np.float32), one.bias)
    assert len(set(s)) == 1


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {j for p in places.values() if len(p) > 1 for k in p for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, hard):
    more = spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "x x x x x x"), (3, "x x x x x"), (4, "a b c d e f\n\n \na b c d e f\na b c d e f"), (5, "𝔘 é b #|#"), (6, "a b c d e f g a b c d e f g b c d e f")], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for df in (docs, hard, more):
        got = quality.judge_quality(df, []).select("text", *names, "base_failed", "kept").collect()
        for r in got:
            want = statistics(r["text"])
            assert tuple(r[n] for n in names) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) == (not r["kept"])


def test_quality_rules_learn_thresholds():
    rng = np.random.default_rng(3)
    columns = {f: rng.random(600) for f in quality.FEATURES}
    bad = (columns["symbol_share"] > 0.8) | ((columns["bang_share"] > 0.7) & (columns["n_words"] <= 0.5))
    rules = quality.cover(columns, bad, np.arange(600) % 3 == 0)
    hit = np.zeros(600, bool)
    for r in rules:
        hit |= quality._covers(r, columns, 600)
    assert np.mean(hit == bad) > 0.97 and "symbol_share" in {c.feature for c in rules[0]}


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge_quality(docs, quality.learn_rules(docs, labels)).join(labels, "doc_id").filter("not base_failed").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in rows]) > 0.95


def test_quality_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 7, "r", "k")], "doc_id long, text string, n_words int, rule string, kept string")
    r = quality.judge_quality(df, []).first()
    assert r["n_words"] == 2 and r["rule"] is None and r["kept"] is False
