"""Exact nearest neighbours over array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import Refused

#: score by metric, and whether a larger score is nearer. l2 is the squared distance.
METRICS = {"cosine": True, "dot": True, "l2": False}
#: Corpus rows of a block and their elements; a task holds one block as a matrix.
BLOCK_ROWS, BLOCK_ELEMENTS = 32_768, 4_000_000
#: Queries that a block meets at once, scores of one matrix product, and pairs that are scored exactly at once.
QUERY_ROWS, PRODUCT, PAIRS = 1024, 2_000_000, 50_000


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two double matrices, pair by pair, each summed from the first element to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def score(metric: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of rows pair by pair, and which there are: a zero vector has no cosine."""
    if metric == "cosine":
        norms = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
        return dot(a, b) / norms, norms != 0
    d = a - b
    return dot(a, b) if metric == "dot" else dot(d, d), np.ones(len(a), bool)


def nearest(metric: str, q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k nearest rows of v for each row of q: rows of q, rows of v, scores. Of equal ones those that come first in v.

    A matrix product tells which pairs can be among the k best, within a bound of its rounding. Only they are scored
    in order of summation, which gives the results. NaN counts as the largest number, as in Spark's order.
    """
    sign = 1.0 if METRICS[metric] else -1.0
    qn, vn = np.sqrt(dot(q, q)), np.sqrt(dot(v, v))
    left, right = (q / qn[:, None], v / vn[:, None]) if metric == "cosine" else (q, v)
    # Vectors near the ends of a double's range, with infinity or with NaN, are scored with all: a product tells nothing of them.
    q_odd, v_odd = (~((n == 0) | ((n > 1e-140) & (n < 1e140))) for n in (qn, vn))
    most = vn[~v_odd].max(initial=0.0)
    slack = {"cosine": np.ones(len(q)), "dot": qn * most, "l2": (qn + most) ** 2}[metric] * (v.shape[1] + 8) * 1e-15
    slack[q_odd] = 0
    step = max(1, PRODUCT // len(v))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        rough = left[part] @ right.T
        if metric == "l2":
            rough *= 2
            rough -= (qn[part] ** 2)[:, None]
            rough -= (vn**2)[None, :]
        odd = q_odd[part][:, None] | v_odd
        rough[odd | np.isnan(rough)] = -np.inf
        if len(v) > k:
            bound = np.partition(rough, len(v) - k, axis=1)[:, len(v) - k] - 2 * slack[part]
            qi, ci = np.nonzero((rough >= bound[:, None]) | odd)
        else:
            qi, ci = (x.ravel() for x in np.indices(rough.shape))
        made = [score(metric, q[part][qi[n : n + PAIRS]], v[ci[n : n + PAIRS]]) for n in range(0, len(qi), PAIRS)]
        s, there = np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made])
        qi, ci, s = qi[there], ci[there], s[there]
        order = np.lexsort((ci, -sign * np.nan_to_num(s, nan=0.0, posinf=np.inf, neginf=-np.inf), -sign * np.isnan(s), qi))
        qi, ci, s = qi[order], ci[order], s[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        yield qi[keep] + at, ci[keep], s[keep]


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _equal(column: pa.Array, x: pa.Scalar) -> np.ndarray:
    """Where a column equals a value, NaN itself."""
    plain = x.as_py()
    if pa.types.is_nested(column.type):
        return np.array([y == plain for y in column.to_pylist()], bool)
    same = pc.is_nan(column) if plain != plain else pc.equal(column, x)
    return pc.fill_null(same, False).to_numpy(zero_copy_only=False).astype(bool)


class Block:
    """Corpus rows in order of their key, which queries search. Columns: `_v`, `_c`, `_d`, the vector's length, and `_f*`, values to be equal."""

    def __init__(self, batches: list[pa.RecordBatch], k: int, metric: str):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.column = {c: pa.concat_arrays(table[c].chunks) for c in table.column_names}
        self.k, self.metric, self.by_length = k, metric, {}
        lengths = self.column["_d"].to_numpy()
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            m = _matrix(self.column["_v"].take(pa.array(at)))
            same = np.unique((m + 0.0).view(np.dtype((np.void, 8 * d))).ravel(), return_inverse=True)[1] if d else np.zeros(len(at), int)
            self.by_length[int(d)] = at, m, same

    def search(self, queries: pa.Table, filters: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        column = {c: pa.concat_arrays(queries[c].chunks) for c in queries.column_names}
        alike: dict[str, list[int]] = {}
        for n, wanted in enumerate(zip(*[column[c].to_pylist() for c in ("_d", *filters)], strict=True)):
            alike.setdefault(repr(wanted), []).append(n)
        for at in alike.values():
            d = column["_d"][at[0]].as_py()
            if d not in self.by_length:
                continue
            rows, m, same = self.by_length[d]
            fits = np.ones(len(self.column["_d"]), bool)
            for f in filters:
                if (x := column[f][at[0]]).is_valid:
                    fits &= _equal(self.column[f], x)
            # Of equal vectors, which have equal scores, the first k are enough.
            chosen = np.flatnonzero(fits[rows])
            order = np.argsort(same[chosen], kind="stable")
            groups = same[chosen][order]
            chosen = np.sort(chosen[order[np.arange(len(groups)) - np.searchsorted(groups, groups) < self.k]])
            if not len(chosen):
                continue
            with np.errstate(all="ignore"):
                for qi, ci, s in nearest(self.metric, _matrix(column["_v"].take(pa.array(at))), m[chosen], self.k):
                    yield np.array(at)[qi], rows[chosen[ci]], s


def search(queries: DataFrame, query_key: str, query_vector: str, corpus: DataFrame, corpus_key: str, vector: str, k: int, metric: str = "cosine", filter_eq: list[tuple[str, str]] | None = None, vectors: bool = True) -> DataFrame:
    """The k nearest corpus rows of each query: its columns, the corpus row's, and `score`. Ties go to the least corpus key.

    filter_eq: (query column, corpus column) pairs that have to be equal; a NULL query value asks
    for nothing. Rows whose vectors differ in length, or have NULL elements, are no partners. Without `vectors` the
    result leaves both vectors out.

    Every query meets every corpus row: that is what an exact search is. The corpus is dealt to blocks of bounded
    size; queries stream past each block, which gives its own k best of a query.
    """
    if metric not in METRICS:
        raise Refused(f"unknown metric {metric}; there are {', '.join(METRICS)}")
    clash = set(queries.columns) & set(corpus.columns) | {"score"} & {*queries.columns, *corpus.columns}
    if clash:
        raise Refused(f"columns on both sides: {', '.join(sorted(clash))}")
    pairs = filter_eq or []
    filters = [f"_f{n}" for n in range(len(pairs))]
    shown_q, shown_c = ([c for c in df.columns if vectors or c != v or c == key] for df, v, key in ((queries, query_vector, query_key), (corpus, vector, corpus_key)))
    floats = all(isinstance(df.schema[c].dataType.elementType, T.FloatType) for df, c in ((queries, query_vector), (corpus, vector)))

    def whole(df: DataFrame, c: str) -> DataFrame:
        return df.filter(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull()))

    def columns(v: str, values: list[str], side: int, block, query, row) -> list:
        plain = F.col(v) if floats else F.col(v).cast("array<double>")
        return [block.cast("int").alias("_b"), F.lit(side).alias("_side"), plain.alias("_v"), F.size(v).alias("_d"), *[F.col(x).alias(f) for f, x in zip(filters, values, strict=True)], query.alias("_q"), row.alias("_c")]

    n, elements = corpus.filter(F.col(vector).isNotNull()).agg(F.count("*"), F.sum(F.size(vector))).first()
    blocks = max(1, -(-n // BLOCK_ROWS), -(-(elements or 0) // BLOCK_ELEMENTS))
    query, row = F.struct(*shown_q), F.struct(*shown_c)
    none = lambda df, shown: F.lit(None).cast(df.select(*shown).schema)
    c = whole(corpus, vector).select(*columns(vector, [y for _, y in pairs], 0, F.pmod(F.xxhash64(corpus_key, vector), F.lit(blocks)), none(queries, shown_q), row))
    q = whole(queries, query_vector).withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*columns(query_vector, [x for x, _ in pairs], 1, F.col("_at"), query, none(corpus, shown_c)))
    both = c.unionByName(q).repartitionById(blocks, "_b").sortWithinPartitions("_b", "_side", F.col("_c").getField(corpus_key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, block, waiting = None, [], None, []

        def found() -> Iterator[pa.RecordBatch]:
            if block is not None and waiting:
                asked = pa.Table.from_batches(waiting)
                told = pa.concat_arrays(asked["_q"].chunks)
                for qi, ci, s in block.search(asked, filters):
                    yield pa.RecordBatch.from_arrays([told.take(pa.array(qi)), block.column["_c"].take(pa.array(ci)), pa.array(s)], ["_q", "_c", "score"])
            waiting.clear()

        for b in batches:
            kinds = b.column("_b").to_numpy().astype(np.int64) * 2 + b.column("_side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if kinds[lo] // 2 != at:
                    yield from found()
                    at, rows, block = kinds[lo] // 2, [], None
                if kinds[lo] % 2 == 0:
                    rows.append(b.slice(lo, hi - lo))
                    continue
                if rows:
                    block, rows = Block(rows, k, metric), []
                for n in range(lo, hi, QUERY_ROWS):
                    waiting.append(b.slice(n, min(QUERY_ROWS, hi - n)))
                    if sum(w.num_rows for w in waiting) >= QUERY_ROWS:
                        yield from found()
        yield from found()

    kind = T.StructType([T.StructField("_q", queries.select(*shown_q).schema), T.StructField("_c", corpus.select(*shown_c).schema), T.StructField("score", T.DoubleType())])
    scored = both.mapInArrow(run, kind).select("_q.*", "_c.*", "score")
    best = F.desc("score") if METRICS[metric] else F.asc("score")
    w = Window.partitionBy(query_key).orderBy(best, F.col(corpus_key))
    return scored.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
