"""Byte-level BPE: recursive DuckDB queries contract pre-tokens, ordered aggregation decodes.

Each task holds one small DuckDB database with the vocabulary and the merge table. Distinct
pre-tokens are rows of (word, position, token); a recursive query joins neighbours to the merge
table and contracts each word's leftmost pair of least rank until no pair is left. A document's
ids are those of its pre-tokens in order. Decoding joins (position, id) rows to the vocabulary and
concatenates the pieces in order. Nothing is shuffled.

Contraction takes as many steps as a word has bytes, so words of every length go to the query in
blocks of BLOCK bytes. Blocks meet at seams: a row of tokens, each part of which is contracted
right, is right as a whole if the bytes of every two neighbours contract to just these two (the first merge
across a seam would need only the tokens on its two sides). A seam that fails moves one token to
the left and the block behind it is contracted anew. The cost grows with a word's length, not with
its square.
"""

from __future__ import annotations

import base64
import contextlib
import ctypes
import gc
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import small_batches

#: Pre-tokens in each of the two generations that a task remembers; when the young one is full it replaces the old one.
TABLE_SIZE = 200_000
#: Characters of text that a task works on at once, beyond the one text that reaches it.
CHUNK = 1_500_000
#: Bytes of words that one query contracts, bytes in a block of a word, and ids that one query decodes.
SLICE, BLOCK, DECODED = 400_000, 32, 1_000_000
MEMORY = "200MB"
#: Where a text may be cut ahead of the pattern: a space before something else than white space begins a match of
#: the pattern, whatever stands before it, and a match that ends there would end there at the end of a text too. ASCII
#: letters behind such a space, up to the next one, are one match.
CUT = r" (?=\S)"

# A row is one number: word * 2**40 + position * 2**24 + token. A merge's key is rank * 2**32 + position * 2**16 + the
# position that it takes in, so that one least key names a word's next step. Words at their fixpoint are kept as -1 - row.
CONTRACT = """
WITH RECURSIVE step AS (
  SELECT (CAST(w AS BIGINT) << 40) + (CAST(pos AS BIGINT) << 24) + id AS v FROM first
  UNION ALL
  (WITH pair AS MATERIALIZED (
     SELECT s.v, m.rank + ((s.v >> 8) & 4294901760) + ((s.nv >> 24) & 65535) AS key
     FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nv FROM step WHERE v >= 0) s
     LEFT JOIN merges m ON m.both = CASE WHEN s.nv >> 40 = s.v >> 40 THEN ((s.v & 16777215) << 24) + (s.nv & 16777215) END),
   best AS (SELECT v >> 40 AS w, min(key) AS k FROM pair GROUP BY w)
   SELECT CASE WHEN b.k IS NULL THEN -1 - p.v WHEN p.key = b.k THEN ((p.v >> 24) << 24) + (b.k >> 32) ELSE p.v END
   FROM pair p JOIN best b ON b.w = p.v >> 40 WHERE b.k IS NULL OR ((p.v >> 24) & 65535) <> (b.k & 65535)))
SELECT (-1 - v) >> 40 AS w, (-1 - v) & 16777215 AS id FROM step WHERE v < 0 ORDER BY v DESC
"""
DECODE = "SELECT b FROM ids JOIN vocab USING (id) ORDER BY p"


def read_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes as the tiktoken library would, without special tokens.

    cut: a pattern, without groups, of one space each where texts may be cut before the pattern is applied; None: nowhere.
    """

    def __init__(self, file: str, pattern: str, cut: str | None = CUT):
        import duckdb
        import regex

        self.ranks, self.split = read_ranks(file), regex.compile(pattern).findall
        if max(self.ranks.values(), default=0) >= 1 << 24:
            raise ValueError(f"{file}: ids of 24 bits at most")
        self.cut, self.plain = re.compile(cut).split if cut else lambda t: [t], cut is not None
        self.bytes_of = {k.to_bytes(4, "little"): b for b, k in self.ranks.items()}
        self.one = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})  # slices fit: nothing is spilled
        merges = [((left << 24) + right, k << 32) for b, k in self.ranks.items() for at in range(1, len(b)) if (left := self.ranks.get(b[:at])) is not None and (right := self.ranks.get(b[at:])) is not None]
        columns = [pa.array(c, pa.int64()) for c in zip(*merges, strict=True)] if merges else [pa.array([], pa.int64())] * 2
        self._table("merges", both=columns[0], rank=columns[1])
        self._table("vocab", id=pa.array(list(self.ranks.values()), pa.int32()), b=pa.array(list(self.ranks), pa.binary()))
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _table(self, name: str, **columns) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    def _query(self, raw: list[bytes]) -> Iterator[bytes]:
        """The ids of each word, by one recursive query."""
        n = np.array([len(x) for x in raw], np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.db.register("first", pa.table({"w": np.repeat(np.arange(len(raw), dtype=np.int32), n), "pos": at.astype(np.int32), "id": self.one[np.frombuffer(b"".join(raw), np.uint8)]}))
        rows = self.db.execute(CONTRACT).fetchnumpy()
        ids, ends = np.asarray(rows["id"]).astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(np.asarray(rows["w"]), minlength=len(raw)))).tolist()
        return (ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))

    def _fill(self, found: dict[bytes, bytes], wanted: set[bytes]) -> None:
        """Contract the wanted words that are not yet found."""
        part: list[bytes] = []
        size = 0
        for raw in wanted:
            if raw in found:
                continue
            if (k := self.ranks.get(raw)) is not None:
                found[raw] = k.to_bytes(4, "little")
                continue
            part.append(raw)
            size += len(raw)
            if size >= SLICE:
                found.update(zip(part, self._query(part), strict=True))
                part, size = [], 0
        if part:
            found.update(zip(part, self._query(part), strict=True))

    def contract(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each word, whatever its length, as little-endian unsigned 32-bit integers."""
        found: dict[bytes, bytes] = {}
        cut = {b: [b[k : k + BLOCK] for k in range(0, len(b), BLOCK)] for b in raw if len(b) > BLOCK}
        self._fill(found, {b for b in raw if len(b) <= BLOCK}.union(*cut.values()))
        words = {b: [found[x] for x in parts] for b, parts in cut.items()}
        self._mend(list(words.values()), found)
        found.update((b, b"".join(w)) for b, w in words.items())
        return [found[b] for b in raw]

    def _mend(self, words: list[list[bytes]], found: dict[bytes, bytes]) -> None:
        """Move the seams between the parts of each word to where they hold; each only ever moves to the left, so this ends.

        A part whose tokens have all moved on is empty. Of seams that touch, every second one moves at a time.
        """
        text = lambda ids: b"".join([self.bytes_of[ids[k : k + 4]] for k in range(0, len(ids), 4)])
        parts = [part for w in words for part in w]
        left = [k - 1 if j else -1 for k, j in enumerate(j for w in words for j in range(len(w)))]
        right = [k + 1 if k + 1 < len(left) and left[k + 1] == k else -1 for k in range(len(left))]
        todo = {k for k, at in enumerate(left) if at >= 0}
        while todo:
            pairs = {k: parts[left[k]][-4:] + parts[k][:4] for k in todo}
            self._fill(found, set(map(text, pairs.values())))
            bad = sorted(k for k, pair in pairs.items() if found[text(pair)] != pair)
            moved: dict[int, bytes] = {}
            for k in bad:
                if left[k] not in moved:
                    moved[k] = text(parts[left[k]][-4:] + parts[k])
            self._fill(found, set(moved.values()))
            todo = set(bad)
            for k, raw in moved.items():
                at = left[k]
                parts[k], parts[at] = found[raw], parts[at][:-4]
                if not parts[at]:
                    todo.discard(at)
                    left[k] = left[at]
                    if left[k] >= 0:
                        right[left[k]] = k
                    else:
                        todo.discard(k)
                if right[k] >= 0:
                    todo.add(right[k])
        place = 0
        for w in words:
            w[:] = parts[place : place + len(w)]
            place += len(w)

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > TABLE_SIZE:
            self.before, self.known = self.known, {}
        known, before, unknown = self.known, self.before, []
        for p in pieces:
            if (ids := before.get(p)) is not None:
                known[p] = ids
            elif (k := self.ranks.get(p.encode())) is not None:
                known[p] = k.to_bytes(4, "little")
            else:
                unknown.append(p)
        known.update(zip(unknown, self.contract([p.encode() for p in unknown]), strict=True))

    def _parted(self, text: str) -> list[str]:
        """A text's chunks: those that stood behind a cut space as they are, without it; the first one behind a space that marks it."""
        parts = self.cut(text)
        if parts[0]:
            parts[0] = " " + parts[0]
            return parts
        return parts[1:]

    def _matches(self, chunks: list[str]) -> Iterator[list[str]]:
        """The pre-tokens of each chunk that stood behind a cut space. One search goes over all of them, as it may be cut again at the spaces."""
        whole = "".join([" " + c for c in chunks])
        found = self.split(whole)
        ends = list(accumulate(map(len, found)))
        if chunks and ends[-1:] != [len(whole)]:  # the pattern leaves characters out
            yield from (self.split(" " + c) for c in chunks)
            return
        at = end = 0
        for c in chunks:
            end += len(c) + 1
            to = bisect_left(ends, end, at) + 1
            yield found[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parted = [self._parted(t) for t in texts]
        chunks = set().union(*parted)
        plain = {c: " " + c for c in chunks if c.isascii() and c.isalpha()} if self.plain else {}
        first = [c for c in chunks if c[0] == " "]
        rest = list(chunks.difference(plain, first))
        pieces = dict(zip(rest, self._matches(rest), strict=True)) | {c: self.split(c[1:]) for c in first}
        every = set(plain.values()).union(*pieces.values())
        if new := every.difference(self.known):
            self._learn(every if len(self.known) + len(new) > TABLE_SIZE else new)
        known = self.known
        ids = {c: known[p] for c, p in plain.items()}
        ids.update((c, b"".join([known[x] for x in p])) for c, p in pieces.items())
        return [b"".join(map(ids.__getitem__, p)) for p in parted]

    def close(self) -> None:
        """Let the memory go, back to the system where that can be asked for."""
        self.db.close()
        self.known.clear(), self.before.clear(), self.ranks.clear(), self.bytes_of.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids. An id that the vocabulary lacks is an error."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        # The sorted column's buffers hold the pieces one after the other.
        lengths, data = [np.zeros(1, np.int64)], []
        for k in range(0, len(flat), DECODED):
            part = flat[k : k + DECODED]
            self.db.register("ids", pa.table({"p": np.arange(len(part), dtype=np.int32), "id": part.astype(np.int32)}))
            pieces = self.db.sql(DECODE).to_arrow_table().column("b")
            if len(pieces) != len(part):
                raise ValueError(f"{len(part) - len(pieces)} ids are not in the vocabulary")
            for c in pieces.chunks:
                at = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)[c.offset : c.offset + len(c) + 1]
                lengths.append(np.diff(at))
                data.append(memoryview(c.buffers()[2])[int(at[0]) : int(at[-1])])
        whole, place = b"".join(data), np.cumsum(np.concatenate(lengths), dtype=np.int64)
        ends = place[np.cumsum([0] + [len(x) // 4 for x in ids])].tolist()
        return [whole[a:b] for a, b in pairwise(ends)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    keys, texts, size = [], [], 0
    for b in batches:
        for k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            keys.append(k), texts.append(t)
            size += len(t or "")
            if size >= CHUNK:
                yield keys, texts
                keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def round_trip(df: DataFrame, key: str, text: str, file: str, pattern: str, decode: bool = True) -> DataFrame:
    """(key, ids, decoded) for each input row: the ids of the whole text, four little-endian bytes each, and the bytes that they decode to.

    A null text is encoded as empty: no ids, no bytes. Repeated rows stay, other columns are not read.
    A text or pre-token may have any length; a task holds CHUNK characters and the one text that goes beyond
    them. With decode=False, decoded is null.
    """
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        with contextlib.closing(Codec(file, pattern)) as codec:
            for keys, texts in _chunks(batches):
                ids = codec.encode([t or "" for t in texts])
                back = codec.decode(ids) if decode else [None] * len(ids)
                yield pa.record_batch([pa.array(keys, arrow), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids binary, decoded binary")


def decode(df: DataFrame, key: str, ids: str, file: str, pattern: str) -> DataFrame:
    """(key, decoded) for each input row of ids as round_trip gives them; null ids decode to no bytes."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        with contextlib.closing(Codec(file, pattern)) as codec:
            for keys, rows in _chunks(batches):
                yield pa.record_batch([pa.array(keys, arrow), pa.array(codec.decode([r or b"" for r in rows]), pa.binary())], names=[key, "decoded"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind.simpleString()}, decoded binary")
