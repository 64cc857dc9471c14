"""Token counts without ids: pieces are counted once for each distinct pre-token.

Every task keeps a table from pre-token to its number of pieces, made once for each pre-token
that it meets, and joins it to the pre-token frequencies of each document. The join is by hash
inside the task: nothing is shuffled, and the table's size is bounded. Pre-tokens are found by the
pattern; stretches between spaces with a character whose class the two regular expression engines may
see differently are split by the tokenizers library, and counted through the same table.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.bpe import CUT
from millrace.llm.common import small_batches

#: Distinct pre-tokens that a task keeps; beyond it the table starts anew, and counts stay the same.
TABLE_SIZE = 300_000
#: Code points other than those for which both regular expression engines know the same classes.
OTHER_CLASSES = r"[^\x00-ԯ‐-⁞、-鿯]"


class PieceCounter:
    """Counts the tokens that the tokenizers library gives for a text, added tokens included."""

    def __init__(self, file: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{file}: only byte-level vocabularies without a normalizer are counted here")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{file}: added tokens that take in neighbouring text are not counted here")
        own = Tokenizer.from_file(file)
        self.model, self.pre = own.model, own.pre_tokenizer
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))) if spec["added_tokens"] else None
        self.split, self.odd, self.cut = regex.compile(pattern).findall, regex.compile(OTHER_CLASSES).search, re.compile(f"(?={CUT})").split
        # The printable characters that stand for the bytes in such vocabularies.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.pieces: dict[str, int] = {}

    def _pieces(self, piece: str) -> int:
        n = len(self.model.tokenize("".join(map(self.shown.__getitem__, piece.encode()))))
        if len(self.pieces) >= TABLE_SIZE:
            self.pieces.clear()
        self.pieces[piece] = n
        return n

    def _frequencies(self, text: str) -> Counter[str]:
        if not self.odd(text):
            return Counter(self.split(text))
        found: Counter[str] = Counter()
        for part, times in Counter(self.cut(text)).items():
            for piece in [part[a:b] for _, (a, b) in self.pre.pre_tokenize_str(part)] if part and self.odd(part) else self.split(part):
                found[piece] += times
        return found

    def _segment(self, text: str) -> int:
        known, total = self.pieces, 0
        for piece, times in self._frequencies(text).items():
            n = known.get(piece)
            total += times * (n if n is not None else self._pieces(piece))
        return total

    def count(self, text: str) -> int:
        if self.added is None:
            return self._segment(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._segment, parts))


def count_tokens(df: DataFrame, key: str, text: str, file: str, pattern: str, limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each input row, over whole texts.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows stay. No begin or end tokens,
    no truncation; the strings of added tokens inside a text count as those tokens. Other columns are not read.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(file, pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.record_batch([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], names=[key, "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
