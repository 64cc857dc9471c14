"""WARC archives: writing, reading back, and a merged index of captures.

Archives are written by Spark's text writer with the record separator as its line separator, so
each part file is a plain WARC file in any store that Spark can write. The index is an external
merge: every archive gives a run of captures that is sorted where it was read; runs meet by key
range, and a loser tree merges the runs of a range in one pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import batches_of, new_path, small_batches, store
from millrace.llm.url_filter import host_of

END = "\r\n\r\n"
#: Payloads below this many bytes are always stored whole.
LEAST_REVISIT = 1000
#: Capture time of a page that has none: this start, and a second for each step of its id.
START = datetime(2024, 1, 1, tzinfo=UTC)
#: Revisit rows that may be broadcast (some 100 bytes each); beyond it the decision is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of payload in one archive file, in expectation: the reader holds one file. Payloads over LARGE bytes go to files of
#: their own, by powers of two, so that a file holds FILE_BYTES or one record.
FILE_BYTES, LARGE = 16 << 20, 64 << 10
#: Index entries in a range of keys, in expectation: a merging task holds one range. The rest waits in shuffle files.
RANGE_ROWS = 50_000


def _revisits(pages: DataFrame, key: str, least: int) -> DataFrame:
    """(page, digest, length, to): the pages whose payload equals that of a page with a larger id, and that page.

    Payloads are equal if their SHA-1 digests and lengths are. Counts are combined before the
    shuffle, so one payload may belong to any share of the rows.
    """
    same = ["_d", "_n"]
    large = pages.filter(F.col("_n") >= least).select(F.col(key).alias("_p"), *same)
    groups = large.groupBy(*same).agg(F.max("_p").alias("_to"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    return large.join(groups, same).filter("_p < _to").select("_p", *same, "_to").distinct()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> None:
    """Write a record for each row.

    A null html is an empty payload, a null url an empty target, line ends in a url are escaped.
    Rows with a null id are written as responses and their id is read back as null. Rows that
    share an id are judged each by its own payload: equal ones are all responses or all revisits.
    Other columns are not read. A payload over 2 GB is more than a Spark string holds.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key), F.col(url).alias("_u"), body.alias("_b"), F.sha1(body.cast("binary")).alias("_d"), F.octet_length(body).cast("long").alias("_n"))
    digests = store(rows.select(key, "_d", "_n"), "warc-digests")
    size = F.when(F.col("_n") <= LARGE, 0).otherwise(F.floor(F.log2("_n"))).cast("int")
    sizes = {r[0]: r[1] for r in digests.groupBy(size.alias("size")).agg(F.avg("_n")).collect()} or {0: 0.0}  # 16 at most
    found = store(_revisits(digests, key, least), "warc-revisits")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = rows.join(found, (rows[key] == found["_p"]) & (rows["_d"] == found["_d"]) & (rows["_n"] == found["_n"]), "left").select(rows[key].alias(key), "_u", "_b", rows["_d"], rows["_n"], "_to")
    seen = F.col("_to").isNotNull()
    target = F.replace(F.replace(F.coalesce("_u", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(int(START.timestamp())) + F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(seen, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.col(key))),
        line("WARC-Date", date),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_d"))),
        line("X-Payload-Length", F.col("_n").cast("string")),
        F.when(seen, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", ident(F.col("_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(seen, "0").otherwise(F.col("_n").cast("string"))),
        F.lit("\r\n"),
        F.when(seen, "").otherwise(F.col("_b")),
    )
    made = rows.select(size.alias("_size"), record.alias("value"))
    for k, mean in sorted(sizes.items()):
        own = made.filter(F.col("_size") == k) if len(sizes) > 1 else made
        own.select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 500)))).text(path)


def records(raw: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record of an archive, by its Content-Length. Raises on a broken archive."""
    at = 0
    while at < len(raw):
        head = raw.find(END.encode(), at)
        if head < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in raw[at:head].decode().split("\r\n")[1:])
        body = head + 4
        end = body + int(headers["Content-Length"])
        if raw[end : end + 4] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, at, end - at, raw[body:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(text) if text else None


READ = "page_id long, url string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long, run long"


def read_archives(spark, path: str) -> DataFrame:
    """Captures in the archives of a folder; to be run with one archive to a batch. The digest and size of a response are taken from its block, those of a revisit from its headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, number = [], int.from_bytes(hashlib.blake2b(name.encode(), digest_size=7).digest(), "big")
                for h, at, size, block in records(raw.as_py()):
                    whole = h["WARC-Type"] == "response"
                    digest = hashlib.sha1(block).hexdigest() if whole else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if whole and h["WARC-Payload-Digest"] != f"sha1:{digest}":
                        raise ValueError(f"{name}: the block at byte {at} has another digest")
                    rows.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Date"], len(block) if whole else int(h["X-Payload-Length"]), digest, h["WARC-Type"], _page(h.get("WARC-Refers-To")), name, at, size, number))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in READ.split(", ")])

    return spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content").mapInArrow(run, READ)


class LoserTree:
    """Merges sorted runs: each step replays one leaf's path against the losers that wait on it."""

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = list(runs)
        self.k = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._enter(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _enter(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.losers[0] = w


def merge_runs(rows: Iterator[tuple[object, tuple]]) -> Iterator[tuple]:
    """Rows of sorted runs, marked by their run and arriving in any interleaving, in order."""
    runs: dict[object, list] = {}
    for run, row in rows:
        runs.setdefault(run, []).append(row)
    yield from LoserTree(iter(runs[r]) for r in sorted(runs))


def merge_index(captures: DataFrame) -> DataFrame:
    """Capture histories in global order of (urlkey, captured, page_id): urlkey, captured and the columns of a capture.

    Keys are split by range together with the capture time, the id and the record's place, which no two
    captures share, so one url or host, or rows without an id, may have any share of the captures. Null ids come first
    among equal captures.
    """
    host = F.array_join(F.reverse(F.split(host_of(F.col("url")), r"\.")), ",")
    rest = F.regexp_extract(F.col("url"), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    keyed = captures.withColumn("urlkey", F.concat(host, F.lit(")"), rest)).withColumn("rank", F.coalesce("page_id", F.lit(-(1 << 63)).cast("long")))
    order = ["urlkey", "captured", "rank", "file", "offset"]
    runs = keyed.select(*order, *[c for c in keyed.columns if c not in order]).sortWithinPartitions(*order)
    names = runs.columns
    parallel = captures.sparkSession.sparkContext.defaultParallelism
    ranged = runs.repartitionByRange(max(parallel, -(-captures.count() // RANGE_ROWS)), *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = names.index("run")

        def rows():
            # A run is what one reading task sorted. Where a range's rows of a run arrive out of order a new run begins.
            last: dict[int, tuple] = {}
            part: dict[int, int] = {}
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    at = r[:5]
                    if r[mark] in last and at < last[r[mark]]:
                        part[r[mark]] = part.get(r[mark], 0) + 1
                    last[r[mark]] = at
                    yield (r[mark], part.get(r[mark], 0)), r

        out: list[tuple] = []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for r in merge_runs(rows()):
            out.append(r)
            if len(out) == 4096:
                yield packed()
                out = []
        if out:
            yield packed()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    small_batches(captures.sparkSession)
    return ranged.mapInArrow(run, kinds)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write the archives of a table of pages to the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    write_archives(pages, path := new_path(spark, "warc"), key, url, html, least)
    with batches_of(spark, 1):  # one archive at a time
        captures = store(read_archives(spark, path), "warc-captures")
    return merge_index(captures)
