"""What the operators share: the shared folder, stored tables, small column expressions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session makes its own; others are refused."""
    named = spark.conf.get(CHECKPOINT, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} has to name a folder that driver and executors share")
        named = getattr(spark, "_millrace_dir", None) or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark._millrace_dir = named
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting of the rows that a Python worker gets at once, and its value for frames that this package returns:
#: one value, as frames are lazy and the last one set holds for all.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 256


def small_batches(spark: SparkSession) -> None:
    """Few rows go to a Python worker at once: long texts must not fill its memory."""
    spark.conf.set(BATCH, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Another number of rows while a stored table is made."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


SPACE_BYTES = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, one text after the other, and where each text's begin; none of a null text.

    Words are taken from the UTF-8 bytes, eight at a time for all words at once.
    """
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    padded = np.zeros(size + 16, np.uint8)
    if size:
        padded[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~SPACE_BYTES[padded[:size]]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < size)]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    eight = np.ndarray((size + 8,), "<u8", padded.data, 0, (1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = _stirred(lengths.astype(np.uint64) * MULTIPLY + (eight[starts] & masks[np.minimum(lengths, 8)]))
    k, rest = 8, np.flatnonzero(lengths > 8)
    while len(rest):
        h[rest] = _stirred(h[rest] * MULTIPLY + (eight[starts[rest] + k] & masks[np.minimum(lengths[rest] - k, 8)]))
        k += 8
        rest = rest[lengths[rest] > k]
    return h, np.searchsorted(starts, at)


def words(text: Column) -> Column:
    """The words of a text in order; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 modulo 4. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
