"""Connectors by name: what `WITH (connector = ...)` means for reading and writing.

File formats, Kafka and JDBC map to Spark's own sources; services that Spark has no source for
take their clients by lazy import, so nothing is needed before it is used. A reader gives a
DataFrame (streaming if asked), a writer takes one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.catalog import Table
from millrace.errors import Refused
from millrace.operators import setops
from millrace.sources import nexmark
from millrace.streaming import runtime

#: Connectors over files: the option that holds the place. Object stores differ only in the scheme of the path.
FILES = {"file": "path", "filesystem": "path", "parquet": "path", "s3_parquet": "path", "gcs_parquet": "path", "azure_parquet": "path", "webhdfs_parquet": "path", "s3": "path", "delta": "path", "iceberg": "path", "directory": "path"}
SCHEMES = {"s3_parquet": "s3a", "s3": "s3a", "gcs_parquet": "gs", "azure_parquet": "abfss", "webhdfs_parquet": "webhdfs"}
JDBC = {"postgres": "postgresql", "mysql": "mysql", "clickhouse": "clickhouse"}
#: Sinks that post batches over HTTP: how a batch becomes a body.
HTTP_SINKS = ("http", "elasticsearch", "opensearch", "splunk_hec", "prometheus", "influxdb")
#: Connectors whose client library is imported where it is used: (module, can be read, can be written).
CLIENTS = {"rabbitmq": ("pika", True, True), "nats": ("nats", True, True), "pulsar": ("pulsar", True, True), "mqtt": ("paho.mqtt.client", True, True), "websocket": ("websocket", True, False), "kinesis": ("boto3", True, True), "firehose": ("boto3", False, True), "dynamodb": ("boto3", False, True), "pubsub": ("google.cloud.pubsub_v1", True, True), "cassandra": ("cassandra.cluster", False, True), "mongodb": ("pymongo", True, True), "redis": ("redis", True, True)}
EXACTLY_ONCE = {"file", "filesystem", "kafka", "parquet", "s3", "s3_parquet", "gcs_parquet", "azure_parquet", "webhdfs_parquet", "postgres"}


def place(table: Table) -> str:
    """The path of a file table, with its connector's scheme where the option names a bucket and key."""
    o, connector = table.options, table.options.get("connector", "")
    path = o.get("path") or o.get("prefix")
    if not path and "bucket" in o:
        path = f"{SCHEMES.get(connector, 'file')}://{o['bucket']}/{o.get('key', '')}"
    if not path:
        raise Refused(f"table {table.name} needs a path")
    return path


def file_format(table: Table) -> str:
    connector, form = table.options.get("connector", ""), table.options.get("format", "")
    if "parquet" in connector:
        return "parquet"
    if connector in ("delta", "iceberg"):
        return connector
    if form == "avro":
        return "avro"
    if form in ("json", "ndjson") or len(table.columns) > 1:
        return "json"
    return form or "text"


def kafka_options(options: dict[str, str], sink: bool = False) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": options["brokers"] if "brokers" in options else options["bootstrap.servers"], ("topic" if sink else "subscribe"): options["topic"]}
    if not sink:
        out["startingOffsets"] = options.get("offsets", "earliest")
    return out | {f"kafka.{k[6:]}": v for k, v in options.items() if k.startswith("kafka.") and k != "kafka.bootstrap.servers"}


def jdbc_options(options: dict[str, str]) -> dict[str, str]:
    kind = JDBC[options["connector"]]
    url = options.get("url") or f"jdbc:{kind}://{options['host']}:{options['port']}/{options['database']}"
    own = {"url": url if url.startswith("jdbc:") else f"jdbc:{url}", "dbtable": options["table"]}
    return own | {k: options[k] for k in ("user", "password", "partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize") if k in options}


def from_lines(lines: DataFrame, schema: StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines, and the lines that are no such rows, for a dead-letter table."""
    text = F.col(column).cast("string")
    parsed = lines.select(text.alias("_line"), F.from_json(text, StructType([*schema.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_row"))
    good = parsed.filter(F.col("_row").isNotNull() & F.col("_row._bad").isNull())
    bad = parsed.filter(F.col("_row").isNull() | F.col("_row._bad").isNotNull()).select(F.col("_line").alias("line"))
    return good.select(*[F.col(f"_row.`{f.name}`") for f in schema]), bad


def read(spark: SparkSession, table: Table, streaming: bool = False) -> DataFrame:
    o, connector, schema = table.options, table.options.get("connector", ""), table.schema()
    if connector in FILES:
        form = file_format(table)
        if form in ("delta", "iceberg") and not _has_format(spark, form):
            raise Refused(f"connector {connector} needs its jar on the class path")
        if form == "text" and len(schema) != 1:
            raise Refused(f"a text table has one column: {table.name}")
        if o.get("mode") == "upsert":
            if streaming:
                raise Refused(f"an upserted table can't be read as a stream: {table.name}")
            newest = runtime.current(spark, place(table))
            return spark.createDataFrame([], schema) if newest is None else newest.select(*[n for n, _ in table.columns])
        if streaming:
            return runtime.read_files(spark, place(table), schema, int(o.get("max_files_per_trigger", "0")) or None, form)
        out = spark.read.schema(schema).format(form).load(place(table))
        return out
    if connector == "nexmark":
        made = nexmark.generate(spark, int(o.get("events", "1000")), int(o.get("tps", "1000")), int(o.get("seed", "42")))
        return made[o.get("table", "bid")].select(*[n for n, _ in table.columns])
    if connector == "kafka":
        raw = (spark.readStream if streaming else spark.read).format("kafka").options(**kafka_options(o)).load()
        return from_lines(raw, schema)[0]
    if connector in JDBC:
        return spark.read.format("jdbc").options(**jdbc_options(o)).load().select(*[n for n, _ in table.columns])
    if connector == "queryable_state":
        return spark.read.format("statestore").option("operatorId", o.get("operator", "0")).load(o["checkpoint"])
    if connector == "http_poll":
        return from_lines(spark.createDataFrame(_poll(o["url"]), "value string"), schema)[0]
    if connector == "rate":
        return (spark.readStream if streaming else spark.read).format("rate").options(rowsPerSecond=o.get("rows_per_second", "1")).load()
    if connector in CLIENTS:
        if not CLIENTS[connector][1]:
            raise Refused(f"{connector} can't be read")
        return from_lines(spark.createDataFrame(_client(connector, o, "read"), "value string"), schema)[0]
    raise Refused(f"table {table.name}: connector {connector!r} can't be read")


def _has_format(spark: SparkSession, name: str) -> bool:
    try:
        return spark._jvm.org.apache.spark.sql.execution.datasources.DataSource.lookupDataSource(name, spark._jsparkSession.sessionState().conf()) is not None
    except Exception:
        return False


def _poll(url: str) -> list[tuple[str]]:
    from urllib.request import urlopen

    with urlopen(url, timeout=30) as f:
        body = json.load(f)
    return [(json.dumps(x),) for x in (body if isinstance(body, list) else [body])]


#: Handlers of service connectors, by (connector, "read" or "write"); a deployment registers its own clients here.
HANDLERS: dict[tuple[str, str], Callable] = {}


def register_client(connector: str, way: str, handler: Callable) -> None:
    """read: options to an iterable of (JSON line,). write: (options, iterator of row dicts), called in each task."""
    HANDLERS[connector, way] = handler


def _client(connector: str, options: dict[str, str], way: str):
    if (connector, way) in HANDLERS:
        return HANDLERS[connector, way](options)
    import importlib

    module = CLIENTS[connector][0]
    try:
        importlib.import_module(module)
    except ImportError as e:
        raise Refused(f"connector {connector} needs the package {module}") from e
    raise Refused(f"connector {connector}: register a client with register_client")


def check_sink(table: Table, mode: str, delivery: str | None) -> None:
    connector = table.options.get("connector", "")
    if delivery == "exactly_once" and connector not in EXACTLY_ONCE:
        raise Refused(f"connector {connector} has no exactly-once sink")
    if mode == "upsert":
        if not table.primary_key:
            raise Refused(f"an upsert table needs a primary key: {table.name}")
        if delivery == "exactly_once":
            raise Refused("exactly-once and upsert exclude each other")


def bulk_body(kind: str, rows: list[dict], options: dict[str, str]) -> bytes:
    """A batch as the body that a service takes."""
    line = lambda r: json.dumps(r, default=str, separators=(",", ":"))
    if kind in ("elasticsearch", "opensearch"):
        head = line({"index": {"_index": options["index"]}})
        return "".join(f"{head}\n{line(r)}\n" for r in rows).encode()
    if kind == "splunk_hec":
        return "\n".join(line({"event": r}) for r in rows).encode()
    if kind == "influxdb":
        tags = [t for t in options.get("tags", "").split(",") if t]

        def point(r: dict) -> str:
            own = "".join(f",{t}={r[t]}" for t in tags)
            fields = ",".join(f"{k}={json.dumps(v, default=str)}" for k, v in r.items() if k not in tags and v is not None)
            return f"{options['measurement']}{own} {fields}"

        return "\n".join(map(point, rows)).encode()
    if kind == "prometheus":
        value = options["value"]
        return "".join(f"{options['metric']}{{{','.join(f'{k}={json.dumps(str(v))}' for k, v in r.items() if k != value)}}} {r[value]}\n" for r in rows).encode()
    return line(rows).encode()


def partitions(table: Table) -> list[str]:
    return [c.strip() for c in table.options.get("partition_by", "").split(",") if c.strip()]


def file_options(table: Table) -> dict[str, str]:
    return {"compression": table.options.get("compression", "zstd")} if file_format(table) == "parquet" else {}


def _send(df: DataFrame, handler: Callable, options: dict[str, str]) -> None:
    """Hand the rows of each task to a client's handler."""

    def send(batches: Iterator) -> Iterator:
        for b in batches:
            handler(options, iter(b.to_dict("records")))
            yield b.iloc[:0]

    df.mapInPandas(send, df.schema).write.format("noop").mode("overwrite").save()


def write(df: DataFrame, table: Table, mode: str = "append", delivery: str | None = None) -> DataFrame | None:
    """Write a bounded DataFrame; `collect` and `changelog` tables give their rows back."""
    o, connector = table.options, table.options.get("connector", "")
    check_sink(table, mode, delivery)
    if connector == "blackhole":
        df.write.format("noop").mode("overwrite").save()
    elif connector == "print":
        df.show(int(o.get("rows", "100")), truncate=False)
    elif connector == "collect":
        return df
    elif connector == "changelog":
        return setops.net(df)
    elif connector in FILES:
        form = file_format(table)
        if mode == "upsert":
            before = runtime.current(df.sparkSession, place(table))
            number = 0 if before is None else int(before.inputFiles()[0].split("version=")[1].split("/")[0]) + 1
            rows = df if setops.ROW_KIND in df.columns else df.withColumn(setops.ROW_KIND, F.lit("update_after"))
            rows = rows.withColumn("_new", F.lit(1))
            both = rows if before is None else rows.unionByName(before.withColumns({setops.ROW_KIND: F.lit("insert"), "_new": F.lit(0)}))
            setops.upserts(both, table.primary_key, ["_new"]).drop("_new").write.mode("overwrite").parquet(f"{place(table)}/version={number}")
            return None
        if runtime.has_log(df.sparkSession, place(table)):
            raise Refused(f"a stream writes {table.name} exactly once; readers would not see other rows")
        writer = df.write.format(form).mode("overwrite" if mode == "overwrite" else "append").options(**file_options(table))
        if partitions(table):
            if mode == "overwrite":
                writer = writer.option("partitionOverwriteMode", "dynamic")
            writer = writer.partitionBy(*partitions(table))
        writer.save(place(table))
    elif connector == "kafka":
        value = F.to_json(F.struct(*df.columns)).alias("value")
        key = [F.to_json(F.struct(*table.primary_key)).alias("key")] if table.primary_key else []
        df.select(*key, value).write.format("kafka").options(**kafka_options(o, True)).save()
    elif connector in JDBC and mode == "upsert":
        if (connector, "write") not in HANDLERS:
            raise Refused(f"connector {connector} appends; for upserts register a client with register_client")
        _send(df, HANDLERS[connector, "write"], o | {"primary_key": ",".join(table.primary_key)})
    elif connector in JDBC:
        df.write.format("jdbc").options(**jdbc_options(o)).mode("append").save()
    elif connector in HTTP_SINKS:
        size, kind = int(o.get("batch_rows", "500")), connector

        def post(batches: Iterator) -> Iterator:
            from urllib.request import Request, urlopen

            for b in batches:
                rows = b.to_dict("records")
                for k in range(0, len(rows), size):
                    headers = {"Content-Type": o.get("content_type", "application/json")} | ({"Authorization": o["authorization"]} if "authorization" in o else {})
                    urlopen(Request(o["url"], bulk_body(kind, rows[k : k + size], o), headers), timeout=30).close()
                yield b.iloc[:0]

        df.mapInPandas(post, df.schema).write.format("noop").mode("overwrite").save()
    elif connector in CLIENTS:
        if not CLIENTS[connector][2]:
            raise Refused(f"{connector} can't be written")
        if (connector, "write") not in HANDLERS:
            _client(connector, o, "write")
        _send(df, HANDLERS[connector, "write"], o)
    else:
        raise Refused(f"table {table.name}: connector {connector!r} can't be written")
    return None
