"""Running streaming queries: sources of files, and sinks for append, update, complete and changelog output."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from millrace.errors import Refused
from millrace.operators import setops
from millrace.storage import new_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_files(spark: SparkSession, path: str, schema: StructType | None = None, files_per_trigger: int | None = None, form: str = "parquet") -> DataFrame:
    """A stream of the files at a path, a glob or a folder. The schema is read from the files where none is given."""
    reader = spark.readStream.schema(schema or spark.read.format(form).load(path).schema).format(form)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A glob also takes a path that is a single file, which a plain streaming path may not be.
    return reader.load(path if re.search(r"[*?\[{]", path) else f"{path[:-1]}[{path[-1]}]")


def with_event_time(df: DataFrame, ts: str, lag_ms: int = 0, allowed_lateness_ms: int = 0) -> DataFrame:
    """The watermark follows the largest time seen by the lag; rows that are late, but allowed, keep their windows open."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{lag_ms + allowed_lateness_ms} milliseconds")


def _started(df: DataFrame, writer: DataStreamWriter, checkpoint: str | None, every: str | None) -> StreamingQuery:
    """Start with state in RocksDB. A query copies its session's settings when it starts, so the session gets its own back."""
    spark = df.sparkSession
    before = spark.conf.get(STATE_PROVIDER)
    writer = writer.option("checkpointLocation", checkpoint or new_path(spark, "stream-checkpoint"))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(STATE_PROVIDER, before)


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Process what is available now, or whatever arrives, in batches `every` so often, until stopped.

    A sink is called with each batch's rows and id, again with the same id after a failure.
    """
    return _started(df, df.writeStream.foreachBatch(sink).outputMode(mode), checkpoint, every)


def start_files(df: DataFrame, path: str, form: str, checkpoint: str, every: str | None = None, partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> StreamingQuery:
    """Append to files exactly once: a log next to them names each batch's files, and readers go by the log."""
    writer = df.writeStream.format(form).outputMode("append").option("path", path).options(**(options or {}))
    return _started(df, writer.partitionBy(*partition_by) if partition_by else writer, checkpoint, every)


def has_log(spark: SparkSession, path: str) -> bool:
    """Whether a stream keeps the log of a folder's files."""
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_spark_metadata")
    return log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log)


def drain(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a bounded stream to its end; the rows that it leaves.

    append: all rows of all batches. complete: the last batch's. update: the last row of each key.
    Batches are files named by batch id, so a repeated batch replaces itself.
    """
    if mode == "update" and not keys:
        raise Refused("update output needs the keys that a row replaces")
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream")
    seen: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        seen.append(number)

    query = start(df, sink, mode)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if not seen:
        return spark.createDataFrame([], df.schema)
    schema = StructType(df.schema.fields[:])
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/batch={max(seen)}")
    rows = spark.read.schema(schema.add("batch", "long")).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in sorted(set(seen))])
    if mode == "append":
        return rows.drop("batch")
    rest = [c for c in df.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def upsert_into(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of each key as a table: every batch writes a new version next to the old one.

    Readers take the newest version with `current`. Changelog rows that take a row back remove it.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current(spark, path, number)
        if setops.ROW_KIND not in batch.columns:
            batch = batch.withColumn(setops.ROW_KIND, F.lit("update_after"))
        both = batch if before is None else batch.unionByName(before.withColumn(setops.ROW_KIND, F.lit("insert")))
        setops.upserts(both, keys, order).write.mode("overwrite").parquet(f"{path}/version={number}")

    return sink


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The newest version of an upserted table, or the newest below a number; None if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [n for n in (int(x.partition("=")[2]) for x in names if x.startswith("version=")) if below is None or n < below]
    done = [n for n in numbers if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={n}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/version={max(done)}") if done else None


def dead_letters(df: DataFrame, ts: str, watermark_ms: Callable[[], int | None]) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows below the given watermark, for use inside a batch sink."""
    bound = watermark_ms()
    if bound is None:
        return df, df.limit(0)
    late = F.unix_millis(F.col(ts).cast("timestamp")) < bound
    return df.filter(~late), df.filter(late)
