"""Substring dedup: words covered by a window of WINDOW words that also starts earlier are removed.

Equal windows choose the same anchor (the least k-gram hash in them), so a window can only repeat
within passages around equal anchors. Anchors that occur once are done after a count. Passages of
the others are collapsed where they are equal; distinct passages go to shards by anchor. In each
shard a compressed FM-index over the shard's passages gives their matching statistics by backward
search; windows that match several rows are reported, with the place where they first stand. Equal
passages after the first repeat it whole.

An anchor's passages are dealt to blocks of BLOCK_PASSAGES, so that no anchor fills a task. Windows of
an anchor with several blocks that are the first ones in theirs meet once more, by their own hash, in
shards of the same kind: a window has at most as many copies there as the anchor has blocks.

Joins are left to Spark: a side is broadcast only below its size threshold, so plans are alike at
every size. Nothing is compared pair by pair.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.llm.common import small_batches, store, word_hashes
from millrace.llm.fm_index import FMIndex

WINDOW, GRAM = 20, 6
#: Windows that look for one anchor.
REACH = WINDOW - GRAM + 1
#: Distinct passages of one anchor in a block, in expectation.
BLOCK_PASSAGES = 1_000
#: Passages in a shard, in expectation (about 30 words each).
SHARD_PASSAGES = 10_000
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
FIRST_ID = -(1 << 63)

DOC, DOC_NAMES = "_id long, _th long", ("_id", "_th")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchor_runs(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor, in texts that lie one after the other.

    (text, first start, last start, anchor hash, passage hash), starts counted in the text.
    """
    n = len(h)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    good = np.arange(n) + WINDOW <= ends
    empty = np.zeros(0, np.int64)
    if not good.any():
        return empty, empty, empty, empty, empty
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram[: n - k] = gram[: n - k] * MULTIPLY + h[k:]
    gram = _mixed(gram)
    best, at, span = gram, np.arange(n), 1
    while span < REACH:
        step = min(span, REACH - span)
        left, right = slice(0, n - step), slice(step, n)
        later = best[right] < best[left]
        best, at = np.concatenate([np.where(later, best[right], best[left]), best[n - step :]]), np.concatenate([np.where(later, at[right], at[left]), at[n - step :]])
        span += step
    starts = np.flatnonzero(good)
    new = np.ones(len(starts), bool)
    new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    s0 = starts[new]
    s1 = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    # The hash of a passage, from those of its prefix sums: sum of h[i] * m**i, shifted to its start by the inverse power.
    power = np.full(n + 1, MULTIPLY, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(h) * power[:n], dtype=np.uint64)])
    inverse = np.full(n + 1, np.uint64(pow(int(MULTIPLY), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    passage = _mixed((sums[s1 + WINDOW] - sums[s0]) * inverse[s0] + (s1 - s0).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    text = np.searchsorted(offsets, s0, side="right") - 1
    return text, s0 - offsets[text], s1 - offsets[text], gram[at[s0]].view(np.int64), passage.view(np.int64)


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST_ID).cast("long")).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def _anchors(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(anchor_runs(*word_hashes(b.column(0)))[3], pa.int64())], names=["anchor"])

    return rows.select("_text").mapInArrow(run, "anchor long")


def _runs(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, s0, s1, anchor, passage = anchor_runs(*word_hashes(b.column(2)))
            ids, th = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.record_batch([pa.array(x, t) for x, t in ((ids[text], pa.int64()), (th[text], pa.int64()), (s0, pa.int32()), (s1, pa.int32()), (anchor, pa.int64()), (passage, pa.int64()))], names=["_id", "_th", "s0", "s1", "anchor", "passage"])

    return rows.select("_id", "_th", "_text").mapInArrow(run, f"{DOC}, s0 int, s1 int, anchor long, passage long")


def _freed(df: DataFrame, name: str) -> DataFrame:
    """Store a table and let the shuffle files behind it go."""
    out = store(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _passages(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The word hashes of the wanted passages (bytes), with the columns of wanted."""
    lists = _freed(wanted.groupBy("_id", "_th").agg(F.collect_list(F.struct("s0", "s1", "anchor", "passage", "blocks")).alias("_a")), "substring-wanted")
    found = rows.join(lists, ["_id", "_th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, offsets = word_hashes(b.column(2))
            asked = b.column(3)
            ends = asked.offsets.to_numpy()
            text = np.repeat(np.arange(len(asked)), np.diff(ends))
            values = asked.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
            cols = {n: values.field(n).to_numpy(zero_copy_only=False) for n in ("s0", "s1", "anchor", "passage", "blocks")}
            a = offsets[text] + cols["s0"]
            z = offsets[text] + cols["s1"] + WINDOW
            raw = h.tobytes()
            ids, th = (b.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            kinds = (("_id", ids, pa.int64()), ("_th", th, pa.int64()), ("s0", cols["s0"], pa.int32()), ("anchor", cols["anchor"], pa.int64()), ("passage", cols["passage"], pa.int64()), ("blocks", cols["blocks"], pa.int32()))
            yield pa.record_batch([*[pa.array(x, t) for _, x, t in kinds], pa.array([raw[8 * i : 8 * j] for i, j in zip(a.tolist(), z.tolist(), strict=True)], pa.binary())], names=[*[n for n, _, _ in kinds], "w"])

    return found.select("_id", "_th", "_text", "_a").mapInArrow(run, f"{DOC}, s0 int, anchor long, passage long, blocks int, w binary")


MASKS = f"{DOC}, s0 int, anchor long, passage long, mask int, w binary"


def _masks(passages: DataFrame, shards: int, *by) -> DataFrame:
    """The passages with a mask: bit j says that the passage's window j also starts earlier in its shard. A partition is a shard; w stays where blocks is over 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        rows = pa.Table.from_batches(got).combine_chunks() if got else None
        if rows is None or not rows.num_rows:
            return
        # Rows of documents that are equal in id and text give a passage several times.
        names = list(zip(*(rows.column(n).to_pylist() for n in ("anchor", "passage", "s0")), strict=True))
        rows = rows.take(list({n: k for k, n in enumerate(names)}.values()))
        rows = rows.sort_by([("_id", "ascending"), ("_th", "ascending"), ("s0", "ascending")])
        texts = [np.frombuffer(x, np.int64) for x in rows.column("w").to_pylist()]
        index = FMIndex(texts, WINDOW)
        low, high, offset = index.matching_statistics(texts)
        n = np.diff(offset)
        lengths = np.array([len(x) + 1 for x in texts])
        j = np.arange(len(low)) - np.repeat(offset[:-1], n)
        own = np.repeat(np.cumsum(lengths) - lengths, n) + j
        several = np.flatnonzero(high - low > 1)  # the threshold: windows that stand in the shard twice or more
        earlier = np.zeros(len(low), np.int32)
        earlier[several] = index.first_places(low[several], high[several]) < own[several]
        masks = np.add.reduceat(earlier << j.astype(np.int32), offset[:-1])  # every passage has a window
        w = pa.array([x if k > 1 else None for x, k in zip(rows.column("w").to_pylist(), rows.column("blocks").to_pylist(), strict=True)], pa.binary())
        yield pa.record_batch([*[rows.column(c).combine_chunks() for c in ("_id", "_th", "s0", "anchor", "passage")], pa.array(masks, pa.int32()), w], names=["_id", "_th", "s0", "anchor", "passage", "mask", "w"])

    return passages.repartition(shards, *by).mapInArrow(run, MASKS)


def _between_blocks(masks: DataFrame, parallel: int) -> DataFrame:
    """(anchor, passage, mask) of windows that stand first in their block and earlier in another one."""
    each = masks.filter("w is not null").select(*DOC_NAMES, "s0", "anchor", "passage", "mask", "w", F.explode(F.sequence(F.lit(0), (F.octet_length("w") / 8 - WINDOW).cast("int"))).alias("j")).filter("(shiftright(mask, j) & 1) = 0")
    own = F.substring(F.col("w"), 8 * F.col("j") + 1, F.lit(8 * WINDOW))
    windows = each.select(*DOC_NAMES, (F.col("s0") + F.col("j")).alias("s0"), "anchor", "passage", "j", own.alias("w")).withColumn("v", F.xxhash64("w"))
    twice = _freed(windows.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v"), "substring-first")
    windows = _freed(windows.join(twice, "v"), "substring-again")
    # A window is a passage of its own here; it is told by its anchor, passage and start.
    shards = max(parallel, -(-windows.count() // SHARD_PASSAGES))
    late = _masks(windows.select(*DOC_NAMES, "s0", "anchor", "passage", F.lit(1).alias("blocks"), "w", "v"), shards, "v").filter("mask != 0")
    j = windows.select("anchor", "passage", "s0", *DOC_NAMES, "j")
    return late.join(j, ["anchor", "passage", "s0", *DOC_NAMES]).groupBy("anchor", "passage").agg(F.bit_or(F.expr("shiftleft(1, j)")).alias("mask"))


def repeated(rows: DataFrame) -> DataFrame:
    """(_id, _th, intervals): for each text with repeats its (s0, mask) runs of repeated windows."""
    small_batches(rows.sparkSession)
    twice = _freed(_anchors(rows).groupBy("anchor").count().filter("count > 1").select("anchor"), "substring-anchors")
    runs = _freed(_runs(rows).join(twice, "anchor"), "substring-runs")
    # Rows that are equal in id and text are one document here; what repeats is judged once for them.
    each = runs.groupBy("anchor", "passage").agg(F.min(F.struct("_id", "_th", "s0", "s1")).alias("f"))
    each = _freed(each, "substring-passages")
    crowded = store(each.groupBy("anchor").count().filter(F.col("count") > BLOCK_PASSAGES).select("anchor", F.ceil(F.col("count") / BLOCK_PASSAGES).cast("int").alias("blocks")), "substring-crowded")
    wanted = each.join(crowded, "anchor", "left").select("f._id", "f._th", "f.s0", "f.s1", "anchor", "passage", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    masks = _masks(_passages(rows, wanted), max(parallel, -(-each.count() // SHARD_PASSAGES)), "anchor", F.pmod("passage", "blocks"))
    if crowded.limit(1).count():
        masks = _freed(masks, "substring-blocks")
        masks = masks.select("anchor", "passage", "mask").unionByName(_between_blocks(masks, parallel)).groupBy("anchor", "passage").agg(F.bit_or("mask").alias("mask"))
    masks = masks.select("anchor", "passage", "mask").filter("mask != 0")
    whole = F.expr("shiftleft(1, s1 - s0 + 1) - 1")
    first = each.select("anchor", "passage", F.col("f._id").alias("i"), F.col("f._th").alias("t"), F.col("f.s0").alias("z")).join(masks, ["anchor", "passage"], "left")
    first = _freed(first, "substring-masks")
    own = (F.col("_id") == F.col("i")) & (F.col("_th") == F.col("t")) & (F.col("s0") == F.col("z"))
    judged = runs.join(first, ["anchor", "passage"]).select("_id", "_th", "s0", F.when(own, F.coalesce("mask", F.lit(0))).otherwise(whole).alias("mask")).filter("mask != 0")
    return judged.groupBy("_id", "_th").agg(F.collect_set(F.struct("s0", "mask")).alias("_a"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with _n_words, _n_removed and _kept (the words that stay, joined by one space) added.

    Null ids come first in order. Rows that share an id are ordered by their text's hash; rows that
    share id and text are one document, judged alike. A null text has no words and keeps an empty text.
    Input columns with those names are replaced.
    """
    docs = docs.drop("_n_words", "_n_removed", "_kept")
    rows = _hashed(docs, key, text)
    found = _freed(repeated(rows), "substring-repeats")
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.coalesce(F.col(key).cast("long"), F.lit(FIRST_ID).cast("long")).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th"))
    joined = base.join(found, ["_id", "_th"], "left").select("_row", "_t", "_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        split = re.compile(r"[^\x20\x09-\x0D]+").findall
        for b in batches:
            kept, counts, removed = [], [], []
            for t, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = split(t)
                counts.append(len(w))
                if runs:
                    cover = np.zeros(len(w) + 1, np.int32)
                    for r in runs:
                        for j in range(r["mask"].bit_length()):
                            if r["mask"] >> j & 1:
                                cover[r["s0"] + j] += 1
                                cover[r["s0"] + j + WINDOW] -= 1
                    stays = np.cumsum(cover)[:-1] == 0
                    w = [x for x, s in zip(w, stays.tolist(), strict=True) if s]
                removed.append(counts[-1] - len(w))
                kept.append(" ".join(w))
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["_row", "_n_words", "_n_removed", "_kept"])

    kind = StructType([joined.schema["_row"], StructField("_n_words", LongType()), StructField("_n_removed", LongType()), StructField("_kept", StringType())])
    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, kind).select("_row.*", "_n_words", "_n_removed", "_kept")
