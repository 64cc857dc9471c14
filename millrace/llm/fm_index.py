"""A compressed full-text index over word symbols: Burrows-Wheeler transform in a wavelet tree.

What an index keeps: the wavelet tree's bits, one bit a row for where rows stop to share their
first words, and places in the text for a sample of rows; all other answers are walked out of these.
Everything is vectorised over many patterns: a step of backward search extends thousands of matches
by one word at once.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.ones = int(bits.sum())
        self.zeros, self.size = n - self.ones, n

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def select1(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that has k ones before it; the size where there is none."""
        w = np.searchsorted(self.before, k, side="right") - 1
        rest, word, at = (k - self.before[w]).astype(np.int64), self.words[w], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            over = rest >= low
            rest = np.where(over, rest - low, rest)
            at += np.where(over, step, 0)
            word = np.where(over, word >> np.uint64(step), word)
        return np.where(k >= self.ones, self.size, (w << 6) + at)


class WaveletTree:
    """Rank of any symbol at any place, level by level from the symbols' highest bit (levels in matrix order)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.levels: list[BitVector] = []
        rest = symbols
        for k in reversed(range(self.bits)):
            bit = ((rest >> k) & 1).astype(bool)
            self.levels.append(BitVector(bit))
            rest = np.concatenate([rest[~bit], rest[bit]])
        every = np.arange(size, dtype=np.int32)
        self.start = self._walk(every, np.zeros(size, np.int32))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in zip(reversed(range(self.bits)), self.levels, strict=True):
            ones = level.rank1(at).astype(np.int32)
            at = np.where((symbol >> k) & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._walk(symbol, at) - self.start[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbol = np.zeros(len(at), np.int32)
        for level in self.levels:
            ones, bit = level.rank1(at).astype(np.int32), level.get(at)
            symbol = symbol * 2 + bit
            at = np.where(bit, level.zeros + ones, at - ones)
        return symbol, at - self.start[symbol]


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


class Ranks:
    """Order numbers of the runs of 1, 2, 4, ... symbols at each place of a text; used while an index is made."""

    def __init__(self, text: np.ndarray):
        self.of = {1: text}

    def get(self, k: int) -> np.ndarray:
        if k not in self.of:
            half = self.get(k // 2)
            self.of[k] = np.unique(half.astype(np.int64) * (int(half.max(initial=0)) + 1) + _ahead(half, k // 2), return_inverse=True)[1].astype(np.int32)
        return self.of[k]

    def pieces(self, depth: int) -> list[np.ndarray]:
        """For each place the numbers of the runs, of 16 symbols at most, that make up `depth` symbols."""
        out, at = [], 0
        for k in (16, 8, 4, 2, 1):
            while depth - at >= k:
                out.append(_ahead(self.get(k), at))
                at += k
        return out

    def order(self, depth: int) -> np.ndarray:
        """Places by their next `depth` symbols. Numbers are packed as long as they fit."""
        key, room = np.zeros(len(self.of[1]), np.int64), 0
        for r in self.pieces(depth):
            bits = int(r.max(initial=0) + 1).bit_length()
            if room + bits > 62:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                room = int(key.max(initial=0) + 1).bit_length()
            key = (key << bits) | r
            room += bits
        return np.argsort(key, kind="stable").astype(np.int32)


class FMIndex:
    """Index of passages, each a row of word codes, in the given order; a separator follows each.

    width: the words of the patterns whose matching statistics are asked for.
    """

    #: Every so many words of a passage, from its first, the index keeps a row's place in the text.
    SAMPLE = 8

    def __init__(self, passages: list[np.ndarray], width: int):
        assert width >= 2
        self.width = width
        lengths = np.array([len(p) for p in passages], np.int64)
        codes = np.concatenate(passages) if passages else np.zeros(0, np.int64)
        self.alphabet, coded = np.unique(codes, return_inverse=True)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(int((lengths + 1).sum()), np.int32)
        text[np.arange(len(codes)) + np.repeat(np.arange(len(passages)), lengths)] = coded + 1
        # Separators differ for the sort, by passage: no two suffixes agree beyond one.
        apart = np.where(text == 0, np.cumsum(text == 0, dtype=np.int32) - 1, text + np.int32(len(passages)))
        ranks = Ranks(apart)
        order = ranks.order(int(lengths.max(initial=0)) + 1)
        self.before = WaveletTree(np.roll(text, 1)[order], len(self.alphabet) + 1)
        self.first_row = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))[:-1]]).astype(np.int32)
        # Rows whose suffixes share one word less than a pattern: where a match goes when its last word is dropped.
        new = np.zeros(len(order), bool)
        new[:1] = True
        for r in ranks.pieces(width - 1):
            x = r[order]
            new[1:] |= x[1:] != x[:-1]
        self.groups = BitVector(new)
        inside = np.arange(len(text)) - np.repeat(begin, lengths + 1)
        known = inside[order] % self.SAMPLE == 0
        self.known, self.places = BitVector(known), order[known]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text where the rows' suffixes begin: rows step back to a row whose place is kept."""
        out, left = np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.astype(np.int32)
        steps = 0
        while len(left):
            known = self.known.get(rows)
            out[left[known]] = self.places[self.known.rank1(rows[known])] + steps
            left, rows = left[~known], rows[~known]
            symbol, rank = self.before.symbol_and_rank(rows)
            rows = self.first_row[symbol] + rank
            steps += 1
        return out

    def matching_statistics(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (low, high) whose suffixes begin with each window of `width` words, for documents streamed past the index; and where a document's windows begin.

        The documents' runs of words have to be in the index, as those of its own passages are.
        Documents are read from the right, all at once: a step of backward search extends the match by
        the next word on the left; a match that reaches the width is reported and gives up its last word.
        """
        lengths = np.array([len(d) for d in documents], np.int64)
        n = len(lengths)
        symbols = (np.searchsorted(self.alphabet, np.concatenate(documents)) + 1).astype(np.int32) if n else np.zeros(0, np.int32)
        begin = np.cumsum(lengths) - lengths
        offset = np.concatenate([[0], np.cumsum(np.maximum(0, lengths - self.width + 1))])
        low, high = np.zeros(n, np.int32), np.full(n, self.groups.size, np.int32)
        flat = np.zeros((2, int(offset[-1])), np.int32)
        for t in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > t)
            where = lengths[on] - 1 - t
            symbol = symbols[begin[on] + where]
            both = self.before.rank(np.concatenate([symbol, symbol]), np.concatenate([low[on], high[on]]))
            low[on], high[on] = self.first_row[symbol] + both[: len(on)], self.first_row[symbol] + both[len(on) :]
            if t >= self.width - 1:
                place = offset[on] + where
                flat[0, place], flat[1, place] = low[on], high[on]
                group = self.groups.rank1(low[on] + 1)
                low[on], high[on] = self.groups.select1(group - 1), self.groups.select1(group)
        return flat[0], flat[1], offset

    def first_places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place in the text among each range of rows. Equal ranges are walked out once."""
        if not len(low):
            return np.zeros(0, np.int64)
        starts, at, again = np.unique(low, return_index=True, return_inverse=True)
        sizes = (high[at] - starts).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        rows = np.arange(int(sizes.sum())) - np.repeat(begin - starts, sizes)
        return np.minimum.reduceat(self.locate(rows), begin)[again]
