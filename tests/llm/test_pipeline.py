"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from millrace.llm.common import store


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, docs, sf_dir), name)
        assert out.dtypes == docs.dtypes
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = last.collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"] for r in rows)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_columns_of_any_name_pass_the_stages(spark, sf_dir):
    extra = {c: f"'{c}!'" for c in ("rule", "_kept", "_gone", "_bad", "_row", "_n_removed", "kept", "a.b")}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "-1 as n_words", *[f"{v} as `{c}`" for c, v in extra.items()])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    assert docs.count() > 0
    assert docs.select("n_words", *[f"`{c}`" for c in extra]).distinct().collect() == [(-1, *[f"{c}!" for c in extra])]
