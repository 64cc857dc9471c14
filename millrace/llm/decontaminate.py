"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A text is its lower-cased runs of letters and digits. Every position gives one seed for each mask:
a hash of the tokens at the mask's offsets, so tokens between them may differ. Seeds of documents
and of benchmark items meet in a join; each hit names a diagonal (document position less item
position), and diagonals are combined before any shuffle. On each diagonal the aligned tokens are
compared and the best stretch counts, where a match adds 1 and a substitution takes MISMATCH. Where
that one has too few equal tokens, the stretch with most equal ones counts that scores 0 or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import store

#: Offsets that a seed hashes; the tokens between are ignored. Together they find any two substitutions in items of 12 tokens or more.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 8, 9), (0, 1, 2, 5, 6, 7))
#: Equal tokens that an overlap needs, or four of five of a shorter item; what a substitution takes from a stretch
#: (4: a stretch scores 0 or more while four of five tokens are equal).
LEAST_EQUAL, MISMATCH = 12, 4
#: Items of fewer tokens than a mask, down to SHORTEST, are found where all their tokens stand in a row.
SHORTEST = 3
#: Bytes of a table that may be broadcast, by its longs; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], short: list[int], whole: bool) -> DataFrame:
    """(keep, pos, seed): a row for each position of the token hashes `h` and each mask that fits there.

    short: lengths of items that are found whole; with `whole`, rows of other lengths give no seed of such a length.
    """
    each = rows.select(*keep, "h", F.posexplode("h").alias("pos", "_"))
    fits = lambda mask: (F.size("h") == len(mask)) & (F.col("pos") == 0) if whole and len(mask) <= MASKS[0][-1] else F.col("pos") + mask[-1] < F.size("h")
    one = lambda m, mask: F.when(fits(mask), F.xxhash64(F.lit(m), *[F.get("h", F.col("pos") + k) for k in mask]))
    made = each.select(*keep, "pos", F.explode(F.array(*[one(m, mask) for m, mask in enumerate([*MASKS, *map(range, short)])])).alias("seed"))
    return made.filter(F.col("seed").isNotNull())


def _if_small(df: DataFrame, longs: Column) -> DataFrame:
    """A stored table, marked for broadcast if its rows' longs, and two for each row, come to no more than BROADCAST_BYTES."""
    size = df.agg(F.sum(8 * (longs.cast("long") + 2))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_equal, n_aligned, doc_start, item_start): the best overlap of each document with each item that it repeats.

    n_equal tokens are equal of n_aligned on the best stretch of a diagonal; starts count tokens from 0. Documents
    without an overlap have no row. Null and empty texts, and rows with a null id, overlap nothing;
    rows that share an id are taken together; items of fewer tokens than a mask are found where they stand whole,
    those of fewer than SHORTEST never. Ties go to the earliest stretch. Other columns are not read. A candidate costs its
    item's length on each diagonal that a seed names; an item and a text of one repeated word have as many as they have tokens.
    """
    items = store(benchmark.select(F.col(item).alias("_item"), hashes(F.col(item_text)).alias("h")).filter(F.col("_item").isNotNull() & (F.size("h") > 0)), "decontaminate-items")
    short = sorted(r[0] for r in items.filter(F.size("h").between(SHORTEST, MASKS[0][-1])).select(F.size("h")).distinct().collect())
    theirs = store(_seeds(items.withColumn("_n", F.size("h")), ["_item", "_n"], short, True).withColumnRenamed("pos", "_ipos").distinct(), "decontaminate-seeds")
    texts = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).filter(F.col("_doc").isNotNull() & F.col("_text").isNotNull())
    ours = _seeds(texts.select("_doc", hashes(F.col("_text")).alias("h")), ["_doc"], short, False)
    diagonals = ours.join(_if_small(theirs, F.lit(4)), "seed").select("_doc", "_item", "_n", (F.col("pos") - F.col("_ipos")).alias("_diagonal")).distinct()
    hits = store(diagonals, "decontaminate-hits")
    # Each candidate meets its document's tokens, made anew for candidates only, and its item's.
    asked = hits.groupBy("_doc").agg(F.collect_list(F.struct("_item", "_diagonal", "_n")).alias("_asked"))
    found = texts.join(_if_small(store(asked, "decontaminate-asked"), 3 * F.size("_asked")), "_doc").select("_doc", hashes(F.col("_text")).alias("d"), "_asked")
    # Only the tokens that an item can meet on a diagonal are copied for it, not the whole text.
    facing = lambda a: F.struct(a["_item"].alias("_item"), a["_diagonal"].alias("_diagonal"), F.slice("d", F.greatest(a["_diagonal"], F.lit(0)) + 1, a["_n"]).alias("d"))
    pairs = found.select("_doc", F.explode(F.transform("_asked", facing)).alias("_a")).select("_doc", "_a.*")
    skipped = F.greatest(-F.col("_diagonal"), F.lit(0))
    aligned = pairs.join(_if_small(items, F.size("h")), "_item").select("_doc", "_item", "_diagonal", F.size("h").alias("_n"), F.transform("h", lambda w, i: F.coalesce(F.when(i >= skipped, F.get("d", i - skipped) == w), F.lit(False))).alias("_equal"))

    def step(a: Column, equal: Column) -> Column:
        """Kadane's scan: the running stretch (score, equal, length) and the best so far; i counts positions."""
        gain = F.when(equal, 1).otherwise(-MISMATCH)
        anew = a["score"] <= 0
        score = F.when(anew, gain).otherwise(a["score"] + gain)
        n = F.when(anew, 1).otherwise(a["n"] + 1)
        eq = F.when(anew, 0).otherwise(a["eq"]) + F.when(equal, 1).otherwise(0)
        better = score > a["best"]
        keep = lambda new, old: F.when(better, new).otherwise(a[old])
        return F.struct(score.alias("score"), n.alias("n"), eq.alias("eq"), (a["i"] + 1).alias("i"), keep(score, "best").alias("best"), keep(n, "best_n").alias("best_n"), keep(eq, "best_eq").alias("best_eq"), keep(a["i"] + 1, "best_end").alias("best_end"))

    def most(equal: Column) -> Column:
        """(eq, n, end) of the stretch with most equal tokens that scores 0 or more, by one sorted pass.

        The i-th equal token, at position m, has q = (MISMATCH + 1) * i - MISMATCH * m; a stretch from
        the i-th to the j-th scores 0 or more where q_i <= q_j + 1. Starts are sorted in at q, ends at q + 1.
        """
        at = F.filter(F.transform(equal, lambda e, m: F.when(e, m)), lambda m: m.isNotNull())
        mark = lambda m, i, end: F.struct((i * (MISMATCH + 1) - m * MISMATCH + end).alias("q"), F.lit(end).alias("end"), i.alias("i"), m.alias("m"))
        marks = F.sort_array(F.flatten(F.transform(at, lambda m, i: F.array(mark(m, i, 0), mark(m, i, 1)))))

        def walk(a: Column, x: Column) -> Column:
            first = (x["end"] == 0) & (x["i"] < a["i"])
            eq = x["i"] - a["i"] + 1
            better = (x["end"] == 1) & (eq > a["eq"])
            keep = lambda new, old: F.when(better, new).otherwise(a[old])
            return F.struct(F.when(first, x["i"]).otherwise(a["i"]).alias("i"), F.when(first, x["m"]).otherwise(a["m"]).alias("m"), keep(eq, "eq").alias("eq"), keep(x["m"] - a["m"] + 1, "n").alias("n"), keep(x["m"] + 1, "stop").alias("stop"))

        none = F.struct(F.lit(2**31 - 1).alias("i"), F.lit(0).alias("m"), F.lit(0).alias("eq"), F.lit(0).alias("n"), F.lit(0).alias("stop"))
        return F.aggregate(marks, none, walk, lambda a: F.struct(a["eq"].alias("eq"), a["n"].alias("n"), a["stop"].alias("end")))

    zero = F.struct(*[F.lit(0).alias(c) for c in ("score", "n", "eq", "i", "best", "best_n", "best_eq", "best_end")])
    kadane = lambda s: F.struct(s["best_eq"].alias("eq"), s["best_n"].alias("n"), s["best_end"].alias("end"))
    needed = F.least(F.lit(LEAST_EQUAL), F.ceil(F.col("_n") * MISMATCH / (MISMATCH + 1)).cast("int"))
    scanned = aligned.select("_doc", "_item", "_diagonal", "_equal", needed.alias("_needed"), F.aggregate("_equal", zero, step, kadane).alias("s"))
    judged = scanned.withColumn("s", F.when(F.col("s.eq") >= F.col("_needed"), F.col("s")).otherwise(most(F.col("_equal"))))
    good = judged.filter(F.col("s.eq") >= F.col("_needed"))
    start = F.col("s.end") - F.col("s.n")
    best = good.groupBy("_doc", "_item").agg(F.max(F.struct(F.col("s.eq").alias("best_eq"), -F.col("s.n"), -(F.col("_diagonal") + start), -start)).alias("b"))
    return best.select(F.col("_doc").alias(key), F.col("_item").alias(item), F.col("b.best_eq").alias("n_equal"), (-F.col("b.col2")).alias("n_aligned"), (-F.col("b.col3")).alias("doc_start"), (-F.col("b.col4")).alias("item_start"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that overlap no item, with all their columns. Rows with a null id stay."""
    bad = store(overlaps(docs, benchmark, key, text, item, item_text).select(F.col(key).alias("_bad")).distinct(), "decontaminate-bad")
    bad = _if_small(bad, F.lit(1))
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
