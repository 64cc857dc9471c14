"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

Shingles of SHINGLE words are weighted by their frequency in the text times a smoothed inverse
document frequency. Document frequencies come from a count-min sketch over all documents, so the
table that executors share has a fixed size. Samples of each text are banded; texts that share a
band are candidates, and a candidate pair is a link if its exact weighted Jaccard similarity is
SIMILARITY or more. Classes are the connected components of the links.

Equal texts are one node from the start. In a band's bucket each node is first compared with the
bucket's leader, the node that shares most buckets; nodes that this leaves in different classes
are then compared with each other, block by block. A bucket of any size whose members belong
together costs as many comparisons as it has members, and no link between candidates of
different classes is left out.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small_batches, store, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the least similarity shares a band with probability 1 - (1 - 0.8**3)**10 = 0.9992.
BANDS, ROWS = 10, 3
#: Rows and columns of the count-min sketch of document frequencies, and counters in a block that is shuffled.
SKETCH_ROWS, SKETCH_BITS, SKETCH_BLOCK = 2, 20, 1 << 14
#: Share that the inverse document frequency adds to a weight, at most: weights lie in 1 to 1.25, so that
#: common passages count less while similarity stays close to the share of common shingles.
IDF_SHARE = 0.25
#: Candidate documents whose ids may be broadcast.
BROADCAST_ROWS = 200_000
#: Nodes in a block when a family that its leader leaves in several classes is compared.
BLOCK = 1_500
#: Members of a leader's family that meet one copy of its text.
MEMBERS = 500
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of a text's runs of SHINGLE words; a shorter text has one shingle, all its words; an empty one none."""
    if not len(h):
        return h.astype(np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, np.uint64(min(len(h), SHINGLE)), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    flat, offsets = word_hashes(column)
    for a, b in pairwise(offsets.tolist()):
        yield flat[a:b]


def _columns(s: np.ndarray, row: int) -> np.ndarray:
    return ((s * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[row])) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Weights:
    """TF-IDF weights of the shingles of a text."""

    def __init__(self, sketch: np.ndarray, documents: int):
        self.sketch, self.n = sketch, max(1, documents)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, times = np.unique(shingles(h), return_counts=True)
        df = np.minimum.reduce([self.sketch[r][_columns(s, r)] for r in range(SKETCH_ROWS)])
        idf = 1 + IDF_SHARE * np.log1p(self.n / np.maximum(df, 1)) / np.log1p(self.n)
        return s, (times * idf).astype(np.float32)


class Shared:
    """The weights on the executors: only arrays are broadcast, so that workers need no class of this package but by value."""

    def __init__(self, arrays):
        self.arrays = arrays

    @property
    def value(self) -> Weights:
        return Weights(*self.arrays.value)


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of least weights over the sum of largest."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i].astype(np.float64), b[1][j].astype(np.float64)
    low = np.minimum(x, y).sum()
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low
    return float(low / total) if total else 0.0


def band_keys(s: np.ndarray, log_w: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Keys of all bands for texts whose shingles lie one after the other: an array (bands, texts).

    Each sample draws r and c from Gamma(2, 1) and beta from U(0, 1) by hash of the shingle; with
    t = floor(ln w / r + beta) the sample is the (shingle, t) of least c * exp(-r * (t - beta + 1)).
    """
    counts = np.diff(np.append(begins, len(s)))
    keys = np.empty((BANDS, len(begins)), np.uint64)
    unit = np.float32(2.0**-24)
    low24 = np.uint64(0xFFFFFF)
    for band in range(BANDS):
        key = np.full(len(begins), np.uint64(band + 1), np.uint64)
        for row in range(ROWS):
            x = mixed(s + np.uint64((band * ROWS + row + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            y = mixed(x ^ np.uint64(0xD1B54A32D192ED03))
            u = [((v >> np.uint64(q)) & low24).astype(np.float32) * unit + unit / 2 for v, q in ((x, 0), (x, 24), (y, 0), (y, 24))]
            beta = ((x >> np.uint64(48)) ^ ((y >> np.uint64(48)) << np.uint64(8)) & low24).astype(np.float32) * unit
            r = -np.log(u[0] * u[1])
            t = np.floor(log_w / r + beta)
            a = np.log(-np.log(u[2] * u[3])) - r * (t - beta + 1)
            least = np.minimum.reduceat(a, begins)
            at = np.flatnonzero(a == np.repeat(least, counts))
            first = at[np.searchsorted(at, begins)]
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + mixed(s[first] + t[first].astype(np.int64).view(np.uint64) * M1))
        keys[band] = key
    return keys


def _freed(df: DataFrame, name: str) -> DataFrame:
    """Store a table and let the shuffle files behind it go."""
    out = store(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The count-min sketch over all documents, and their number. Tasks send compressed blocks; blocks are summed by place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.uint32), 0
        for b in batches:
            for h in _texts(b.column(0)):
                s = np.unique(shingles(h))
                n += 1
                for r in range(SKETCH_ROWS):
                    np.add.at(own[r], _columns(s, r), 1)
        if n:
            blocks = own.reshape(-1, SKETCH_BLOCK)
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in blocks]), pa.array([n] + [0] * (len(blocks) - 1), pa.int64())], names=["place", "block", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for b in batches:
            for place, block, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(zlib.decompress(block), np.uint32)
                sums[place] = sums[place] + x if place in sums else x.astype(np.uint64)
                n += m
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in sums.values()]), pa.array([n] + [0] * (len(sums) - 1), pa.int64())], names=["place", "block", "n"])

    kind = "place int, block binary, n long"
    parts = rows.select("_text").mapInArrow(count, kind)
    blocks = SKETCH_ROWS * (1 << SKETCH_BITS) // SKETCH_BLOCK
    sketch = np.zeros((blocks, SKETCH_BLOCK), np.uint32)
    documents = 0
    for r in parts.repartition(min(blocks, 32), "place").mapInArrow(total, kind).collect():  # 8 MB in all
        sketch[r["place"]] = np.frombuffer(zlib.decompress(bytes(r["block"])), np.uint32)
        documents += r["n"]
    return sketch.reshape(SKETCH_ROWS, -1), documents


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the least node that each node of some edge (x, y) is connected to. Each round is a stored table."""
    both = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select("y", "x"))
    both = store(both.distinct(), "near-links")
    labels = store(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("class")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("class").alias("c")), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        lower = labels.join(near, "node").select("node", F.least("class", "c").alias("c"), F.col("class").alias("old"))
        jump = labels.select(F.col("node").alias("c"), F.col("class").alias("far"))
        after = store(lower.join(jump, "c", "left").select("node", F.least("c", F.coalesce("far", "c")).alias("class"), "old"), "near-labels")
        if not after.filter("class <> old").limit(1).count():
            return after.select("node", "class")
        labels = after.select("node", "class")


def _verified(rows: DataFrame, pairs: DataFrame, shared, least: float) -> DataFrame:
    """The pairs (x, y) whose similarity is `least` or more, by whole texts.

    A y may belong to any share of the pairs: they are dealt to parts of MEMBERS, and each part gets a copy of its text.
    """
    asked = _freed(pairs.select(F.col("x").alias("_id")).union(pairs.select("y")).distinct(), "near-asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = _freed(rows.select("_id", "_text").join(asked, "_id"), "near-texts")
    own = lambda c: texts.select(F.col("_id").alias(c), F.col("_text").alias(f"t{c}"))
    parts = pairs.groupBy("y").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_parts"))
    dealt = pairs.join(parts, "y").withColumn("_part", F.pmod(F.xxhash64("x"), F.col("_parts")).cast("int"))
    copies = parts.join(own("y"), "y").select("y", "ty", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    both = dealt.join(own("x"), "x").join(copies, ["y", "_part"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        last: tuple = (None, None, None)
        for b in batches:
            x, y = (b.column(k).to_pylist() for k in (0, 1))
            good = []
            leaders = b.column(3).to_pylist()
            for k, p in enumerate(_texts(b.column(2))):
                if last[0] != y[k] or last[1] != leaders[k]:
                    last = (y[k], leaders[k], weights.of(word_hashes(pa.array(leaders[k : k + 1]))[0]))
                if similarity(weights.of(p), last[2]) >= least:
                    good.append(k)
            yield pa.record_batch([pa.array([x[k] for k in good], pa.int64()), pa.array([y[k] for k in good], pa.int64())], names=["x", "y"])

    small_batches(rows.sparkSession)
    return both.select("x", "y", "tx", "ty").mapInArrow(check, "x long, y long")


def _rest(rows: DataFrame, led: DataFrame, found: DataFrame, shared, least: float) -> DataFrame | None:
    """Links between nodes with one leader that are still in different classes; None if there are no such nodes.

    Under each leader the nodes outside its largest class are compared with all its nodes. Both
    sides are cut into blocks of BLOCK nodes and every pair of blocks is a group of its own, so
    no task's input grows with a family, and pairs exist only as sums inside a task.
    """
    split = led.join(found.select("node", "class"), "node", "left").select("y", "node", F.coalesce("class", "node").alias("c"))
    parts = split.groupBy("y", "c").agg(F.count("*").alias("n"))
    main = parts.groupBy("y").agg(F.max(F.struct("n", "c"))["c"].alias("m"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.select("y", "m", blocks(F.col("all")).alias("bm"), blocks(F.col("all") - F.col("most")).alias("bl"))
    split = _freed(split.join(main, "y"), "near-split")
    if not split.limit(1).count():
        return None
    asked = _freed(split.select(F.col("node").alias("_id")).distinct(), "near-asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = _freed(rows.select("_id", "_text").join(asked, "_id"), "near-texts").select(F.col("_id").alias("node"), "_text")
    full = split.join(texts, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = lambda lone, l, m: ["y", l.alias("l"), m.alias("m"), F.lit(lone).alias("lone"), "node", "c", (F.col("c") == F.col("m")).alias("main"), "_text"]  # noqa: E731, E741
    pairs = full.filter("c <> m").select(*columns(True, own(F.col("bl")), every(F.col("bm")))).unionByName(full.select(*columns(False, every(F.col("bl")), own(F.col("bm")))))
    pairs = pairs.select("y", "l", "m", "lone", "node", "c", "main", "_text")

    def compare(group: pa.Table) -> pa.Table:
        weights = shared.value
        lone, node, c, main = (group.column(n).to_numpy() for n in ("lone", "node", "c", "main"))
        vectors = [weights.of(h) for h in _texts(_one(group.column("_text")))]
        them = np.flatnonzero(~lone)
        x, y = [], []
        if len(them):
            place = np.repeat(np.arange(len(them)), [len(vectors[k][0]) for k in them])
            s, w = (np.concatenate([vectors[k][j] for k in them]) for j in (0, 1))
            order = np.argsort(s, kind="stable")
            s, w, place = s[order], w[order].astype(np.float64), place[order]
            totals = np.array([vectors[k][1].sum(dtype=np.float64) for k in them])
            for k in np.flatnonzero(lone):
                t, v = vectors[k]
                a, z = np.searchsorted(s, t), np.searchsorted(s, t, side="right")
                at = np.repeat(a - np.concatenate([[0], np.cumsum(z - a)[:-1]]), z - a) + np.arange((z - a).sum())
                low = np.bincount(place[at], weights=np.minimum(w[at], np.repeat(v, z - a)), minlength=len(them))
                good = low >= least * (totals + v.sum(dtype=np.float64) - low)
                for j in them[good & (c[them] != c[k]) & (main[them] | (node[them] < node[k]))]:
                    x.append(max(node[k], node[j])), y.append(min(node[k], node[j]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return _freed(pairs.groupBy("y", "l", "m").applyInArrow(compare, "x long, y long").distinct(), "near-links")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, class_id, n_texts, kept) for each input row.

    class_id is the least id of the row's class, kept says that the row's id is it; n_texts counts
    the different texts of the class. Null and empty texts are alone in their class, each. Rows
    with a null id are compared with nothing and kept, with a null class. Rows that share an id are
    one document that has all their texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).filter(F.col("_id").isNotNull() & (F.coalesce("_text", F.lit("")) != ""))
    sketch, documents = document_frequencies(rows)
    shared = Shared(spark.sparkContext.broadcast((sketch, documents)))  # 8 MB, whatever the input

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            held: list = []
            size = 0

            def out():
                s = np.concatenate([x[1] for x in held])
                w = np.log(np.concatenate([x[2] for x in held]))
                begins = np.cumsum([0] + [len(x[1]) for x in held[:-1]])
                keys = band_keys(s, w, begins)
                return pa.record_batch([pa.array(np.repeat(np.array([x[0] for x in held], np.int64), BANDS)), pa.array(keys.T.ravel().view(np.int64))], names=["_id", "k"])

            for i, h in zip(ids, _texts(b.column(1)), strict=True):
                s, w = weights.of(h)
                if len(s):
                    held.append((i, s, w))
                    size += len(s)
                if size >= 30_000:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

    # Equal texts: the least id stands for all.
    named = _freed(rows.select("_id", F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), F.col("_text")).alias("b")).distinct(), "near-named")
    nodes = named.groupBy("a", "b").agg(F.min("_id").alias("node"))
    nodes = _freed(named.join(nodes, ["a", "b"]).select("_id", "node").distinct(), "near-nodes")
    signed = rows.mapInArrow(sign, "_id long, k long")
    bands = _freed(signed.join(nodes.filter("_id = node").select("_id").distinct(), "_id").select("k", F.col("_id").alias("node")).distinct(), "near-bands")
    # First every node against the leader of each of its buckets: the node whose buckets hold most nodes, which is
    # the one that the others of a family resemble most.
    sizes = bands.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    shared_bands = _freed(bands.join(sizes, "k"), "near-shared")
    known = shared_bands.join(shared_bands.groupBy("node").agg(F.sum("n").alias("p")), "node")
    leaders = known.groupBy("k").agg((-F.max(F.struct("p", (-F.col("node")).alias("m")))["m"]).alias("y"))
    led = _freed(shared_bands.join(leaders, "k").select("y", "node").distinct(), "near-led")
    stars = led.filter("node <> y").select(F.col("node").alias("x"), "y")
    links = _freed(_verified(rows, stars, shared, least), "near-links")
    # One document that has several texts holds them together.
    links = links.union(nodes.filter("_id <> node").join(nodes.filter("_id = node").select("_id"), "_id", "left_semi").select(F.col("_id").alias("x"), F.col("node").alias("y")))
    found = components(links)
    more = _rest(rows, led, found, shared, least)
    if more is not None:
        links = links.union(more)
        found = components(links)
    joined = nodes.join(found, "node", "left").select("_id", F.col("node"), F.coalesce("class", "node").alias("class_id"))
    member = joined.groupBy("_id").agg(F.min("class_id").alias("class_id"))
    sizes = joined.select("node", "class_id").distinct().groupBy("class_id").agg(F.count("*").alias("n_texts"))
    member = _freed(member.join(sizes, "class_id"), "near-classes")
    named_docs = docs.select(F.col(key).alias("_k"))
    out = named_docs.join(member, F.col("_k").cast("long") == F.col("_id"), "left")
    cls = F.coalesce("class_id", F.col("_k").cast("long"))
    return out.select(F.col("_k").alias(key), cls.alias("class_id"), F.coalesce("n_texts", F.lit(1).cast("long")).alias("n_texts"), F.coalesce(F.col("_k").cast("long") == cls, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those whose class has a smaller id; columns as they are."""
    gone = store(classes(docs, key, text, least).filter("not kept").select(F.col(key).alias("_gone")).distinct(), "near-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
