"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct grams of 4, 6 and 8 bytes of the lower-cased text, hashed to 2**HASH_BITS
slots. A slot is scaled by the log ratio of its smoothed document counts in toxic and clean
texts; slots whose two rates don't differ clearly get no weight, so that the many grams of a
long text don't drown the telling ones. Logistic regression on the scaled presence bits gives
the weights. Training runs in one task on a bounded sample of labelled rows; scoring is one pass
over all rows and whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import held_out, small_batches, store

HASH_BITS, ORDERS = 22, (4, 6, 8)
#: Labelled rows of each class that the fit draws, at most in expectation.
SAMPLE_ROWS = 4_000
#: Standard errors by which the rates of a slot in the two classes have to differ; slots with a weight, at most.
CLEAR, MOST_SLOTS = 4.5, 50_000
ROUNDS, RATE, DECAY = 600, 1.0, 1e-5


class Model(NamedTuple):
    slots: np.ndarray
    weights: np.ndarray
    bias: float


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode(), np.uint8)


def grams(raw: np.ndarray) -> np.ndarray:
    """The hashed n-grams at every position of a text, orders one after the other."""
    code, found = raw.astype(np.uint64), []
    rolled = code.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(raw) < n:
            break
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            found.append(((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """With no rows or one class only: no weights, and the bias of the smoothed base rate."""
    size, n1 = 1 << HASH_BITS, toxic.sum()
    n0 = len(toxic) - n1
    bias = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), bias)
    counts = np.zeros((2, size), np.int32)
    for t, y in zip(texts, toxic, strict=True):
        counts[int(y)][np.unique(grams(_raw(t)))] += 1
    rate = (counts[0] + counts[1]) / len(toxic)
    apart = np.abs(counts[1] / n1 - counts[0] / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12)
    slots = np.flatnonzero(apart > CLEAR)
    if len(slots) > MOST_SLOTS:
        slots = np.sort(np.argsort(-apart, kind="stable")[:MOST_SLOTS])
    ratio = np.log((counts[1][slots] + 1) / (n1 + 2)) - np.log((counts[0][slots] + 1) / (n0 + 2))
    place = np.full(size, -1, np.int32)
    place[slots] = np.arange(len(slots))
    rows = [(p := place[np.unique(grams(_raw(t)))])[p >= 0] for t in texts]
    column, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / (np.sqrt(np.bincount(row, weights=ratio[column] ** 2).mean()) + 1e-9) if len(column) else 1.0
    scaled = ratio[column] * scale
    weight, memory = np.zeros(len(slots)), np.full(len(slots), 1e-8)
    for _ in range(ROUNDS):
        z = np.bincount(row, weights=scaled * weight[column], minlength=len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - toxic
        gradient = np.bincount(column, weights=scaled * error[row], minlength=len(slots)) / len(rows) + DECAY * weight
        memory += gradient**2
        weight -= RATE * gradient / np.sqrt(memory)
        bias -= 2 * RATE * error.mean()
    return Model(slots.astype(np.int32), (weight * ratio * scale).astype(np.float32), float(bias))


def learn(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on rows whose id is not held out.

    Null ids, labels and texts are not learned from; equal label rows count once, a repeated id as often as
    its rows. At most about SAMPLE_ROWS ids of each class are drawn, by a hash of the id; where the classes are
    drawn at different rates, the bias is set back to the odds before the draw. Where ids repeat so often that
    the sample holds over four times SAMPLE_ROWS, it is thinned, both classes alike.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_k").isNotNull() & ~held_out(F.col("_k"))).distinct()
    count = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if not count:
        return fit([], np.zeros(0))
    draw = F.pmod(F.xxhash64(F.col("_k"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    clean, toxic = (min(1.0, SAMPLE_ROWS / max(1, count.get(y, 0))) for y in (0, 1))
    share, prior = F.when(F.col("_y") == 1, toxic).otherwise(clean), float(np.log(toxic / clean))
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t is not null").join(F.broadcast(known.filter(draw < share)), "_k").select("_k", "_t", "_y")
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((k, t, y) for b in batches for k, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True))
        m = fit([t for _, t, _ in seen], np.array([y for _, _, y in seen], float))
        yield pa.record_batch([pa.array([m.slots.tobytes()], pa.binary()), pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias - prior])], names=["s", "w", "b"])

    sample = store(rows, "toxicity-sample")
    if (m := sample.count()) > 4 * SAMPLE_ROWS:
        sample = sample.filter(F.rand(5) < 2 * SAMPLE_ROWS / m)
    got = sample.coalesce(1).mapInArrow(run, "s binary, w binary, b double").collect()
    return Model(np.frombuffer(bytes(got[0]["s"]), np.int32), np.frombuffer(bytes(got[0]["w"]), np.float32), got[0]["b"]) if got else fit([], np.zeros(0))


def score_texts(texts: pd.Series, table: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for k, t in enumerate(texts):
        slots = grams(_raw(t or ""))
        slots = np.unique(slots[table[slots] != 0])
        out[k] += table[slots].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def score(df: DataFrame, key: str, text: str, model: Model, threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted) for each input row. Null and empty texts get the score of no features."""
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.slots, model.weights, model.bias))  # arrays, so that workers need no class; MOST_SLOTS * 8 bytes at most, whatever the input

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << HASH_BITS, np.float32)
        slots, weights, bias = shared.value
        table[slots] = weights
        for p in parts:
            yield pd.Series(score_texts(p, table, bias))

    got = df.select(F.col(key), held_out(F.col(key)).alias("held_out"), scored(F.col(text)).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
