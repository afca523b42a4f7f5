"""Operator 8: removal of words in windows that an earlier document has, by FM-indexes and matching statistics.

``repeats`` drops the windows whose minimizer no other document has. Of what is
left, one copy of each different run goes to a shard. A run none of whose windows
another document's run has can neither hold nor lend a match: these are left out,
by a hash of windows that may keep one too many. The others are indexed, shard by
shard, in a compressed FM-index: the Burrows-Wheeler transform of the runs' words
in a wavelet matrix (bit vectors with block counts), the documents that the
suffixes are from in a second one, and the common prefixes of neighbours with
their next smaller values.

The runs that an earlier document may share are streamed against it from their
last word to their first. Backward search takes the next word while some document with a smaller
id has what is matched (the least document of an interval of suffixes is a walk
down the second matrix); where it fails, the match is cut to the longest prefix
that more suffixes have, and it goes on. That gives at each word the length of
the longest string from there on that an earlier document has, the matching
statistic; where it is ``length`` words or more, the string is reported.
Equal runs of one document have the same statistics, so a run is streamed once.
In all documents after the first with it, a run is the indexed string itself,
byte for byte, which is its longest match without a search.

Defined results: a null text has no words; a null id counts as later than any
other, as does the largest id; rows that repeat an id are one document in this
order, so they don't take words from each other; other columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common, repeats
from .suffix_dedup import suffix_order

LENGTH, GRAM = 13, 4


def symbols(text: bytes) -> tuple[np.ndarray, bytes]:
    words = text.split()
    found = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return found, found.tobytes()


class BitVector:
    """Bits in 64-bit words with a count before each word: the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32 if len(bits) < 1 << 32 else np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of a symbol before a place, for many symbols and places at a time."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            self.bits.append(BitVector(bit))
            self.zeros.append(int(len(values) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])
        every = np.arange(symbols)
        self.base = self._walk(every, np.zeros(symbols, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbol, at) - self.base[symbol]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value between each ``low`` and ``high``, which is greater."""
        value = np.zeros(len(low), dtype=np.int64)
        for bits, zeros in zip(self.bits, self.zeros):
            a, b = bits.rank(low), bits.rank(high)
            ones = (high - low) == (b - a)
            low, high = np.where(ones, zeros + a, low - a), np.where(ones, zeros + b, high - b)
            value = 2 * value + ones
        return value


def smaller_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places before and after each with a smaller value; -1 and the length where there is none.

    Places point to their neighbour and, while that is no smaller, on to where it points.
    """
    out = []
    for v in (values, values[::-1]):
        to, live = np.arange(-1, len(v) - 1), np.arange(len(v))
        while len(live):
            at = to[live]
            live = live[(at >= 0) & (v[np.maximum(at, 0)] >= v[live])]
            to[live] = to[to[live]]
        out.append(to)
    return out[0], len(values) - 1 - out[1][::-1]


class FMIndex:
    """Matching statistics of strings of symbols against the strings of documents with smaller numbers."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, owners: np.ndarray):
        """``text`` has the strings one after another; ``owners`` are numbers from 0."""
        names, coded = np.unique(text, return_inverse=True)
        self.symbols = len(names) + 1  # the last one ends a string
        total = int(lengths.sum()) + len(lengths)
        ends = np.cumsum(lengths + 1)
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        text = np.empty(total, dtype=np.int64)
        text[inner] = coded
        text[ends - 1] = len(names) + np.arange(len(lengths))
        order = suffix_order(text, np.arange(total), int(lengths.max()) + 2)
        self.common = self._common(text, order)
        text[ends - 1] = len(names)
        self.text, self.ends, self.lengths = text.astype(np.int32), ends - 1, lengths
        self.matrix = WaveletMatrix(text[order - 1], self.symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self.owners = WaveletMatrix(np.repeat(owners, lengths + 1)[order], int(owners.max()) + 1)
        low, high = smaller_neighbours(self.common)
        self.low, self.high = low.astype(np.int32), high.astype(np.int32)

    @staticmethod
    def _common(text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each suffix and the one before; -1 at both ends."""
        out = np.zeros(len(order) + 1, dtype=np.int32)
        out[0] = out[-1] = -1
        live, depth = np.arange(1, len(order)), 0
        while len(live):  # ends of strings are unique, so no comparison passes one
            live = live[text[order[live - 1] + depth] == text[order[live] + depth]]
            depth += 1
            out[live] = depth
        return out

    def statistics(self, which: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the strings ``which``, the longest match at each symbol with a string of an owner below ``under``.

        Returns the statistics of all of them, one after another, and where each begins.
        """
        begin = np.cumsum(self.lengths[which]) - self.lengths[which]
        out = np.zeros(int(self.lengths[which].sum()), dtype=np.int32)
        live = np.arange(len(which))
        left = self.lengths[which].copy()  # symbols not taken yet
        first = self.ends[which] - self.lengths[which]
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(self.text), dtype=np.int64)
        depth = np.zeros(len(which), dtype=np.int64)
        while len(live):
            symbol = self.text[first[live] + left[live] - 1].astype(np.int64)
            a = self.before[symbol] + self.matrix.rank(symbol, low[live])
            b = self.before[symbol] + self.matrix.rank(symbol, high[live])
            good = b > a
            good[good] = self.owners.least(a[good], b[good]) < under[live[good]]
            done = live[good]
            low[done], high[done] = a[good], b[good]
            depth[done] += 1
            cut = live[~good]
            none = cut[depth[cut] == 0]
            cut = cut[depth[cut] > 0]
            # the longest prefix of the match that more suffixes have
            x, y = self.common[low[cut]], self.common[high[cut]]
            depth[cut] = np.maximum(np.maximum(x, y), 0)
            low[cut], high[cut] = np.where(x >= y, self.low[low[cut]], low[cut]), np.where(y >= x, self.high[high[cut]], high[cut])
            root = cut[depth[cut] == 0]
            low[root], high[root] = 0, len(self.text)
            for took in (done, none):
                left[took] -= 1
                out[begin[took] + left[took]] = depth[took]
            live = live[left[live] > 0]
        return out, begin


def shared_windows(text: np.ndarray, lengths: np.ndarray, owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which strings have a window of ``length`` symbols that another owner's string has, and which one that a smaller owner's has.

    Windows are told apart by a hash: one too many is possible, one too few is not.
    """
    string = np.repeat(np.arange(len(lengths)), lengths - length + 1)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(lengths - length + 1) - (lengths - length + 1), lengths - length + 1)
    at = np.repeat(np.cumsum(lengths) - lengths, lengths - length + 1) + nth
    up, down = repeats.powers(len(text) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(text * up[: len(text)], out=sums[1:])
        window = (sums[at + length] - sums[at]) * down[at]
    order = np.argsort(window, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(window[order]) != 0]))
    owner, size = owners[string][order], np.diff(np.append(first, len(order)))
    least, most = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    some, earlier = np.zeros(len(lengths), bool), np.zeros(len(lengths), bool)
    some[string[order][np.repeat(least < most, size)]] = True
    earlier[string[order][np.repeat(least, size) < owner]] = True
    return some, earlier


SHARED = "c long, d long, flag boolean, from long, to long"


def earlier_strings(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(c, d, flag, from, to): the strings of each class that an earlier document has, for its first document and (flag) for later ones."""

    def run(g: np.ndarray, c: np.ndarray, d: np.ndarray, owner: np.ndarray, several: np.ndarray, lengths: np.ndarray, data: bytes) -> Iterator[pa.RecordBatch]:
        def batches(which: np.ndarray, flag: bool, begins: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(which), 100_000):
                k = slice(at, at + 100_000)
                columns = (c[which[k]], d[which[k]], np.full(len(which[k]), flag), begins[k], ends[k])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["c", "d", "flag", "from", "to"])

        lengths, text, later = lengths // 8, np.frombuffer(data, dtype=np.uint64), np.flatnonzero(several)
        yield from batches(later, True, np.zeros(len(later), np.int64), lengths[later])
        # most strings under a minimizer have no more in common: they neither hold nor lend a match
        held, earlier = shared_windows(text, lengths, owner, length)
        which = np.flatnonzero(held)
        if not len(which):
            return
        ids, owner = np.unique(owner[which], return_inverse=True)
        index = FMIndex(text[np.repeat(held, lengths)], lengths[which], owner)
        first = np.flatnonzero(earlier[which])
        for at in range(0, len(first), 1 << 16):
            some = first[at : at + (1 << 16)]
            found, begin = index.statistics(some, owner[some])
            place = np.flatnonzero(found >= length)
            # a match that begins one symbol later and ends at the same place says nothing new
            string = np.searchsorted(begin, place, side="right") - 1
            new = np.ones(len(place), bool)
            new[1:] = (string[1:] != string[:-1]) | (place[1:] != place[:-1] + 1) | (found[place[1:]] != found[place[:-1]] - 1)
            place, string = place[new], string[new]
            begins = place - begin[string]
            yield from batches(which[some[string]], False, begins, begins + found[place])

    return repeats.in_shards(rows, run, SHARED)


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, h, a, b): word stretches of documents in strings of ``length`` or more that a document with a smaller id has."""
    found = repeats.settle(docs, symbols, length, gram, ordered=True)

    def span(text: bytes, at: np.ndarray, n: np.ndarray) -> list[bytes]:
        # only the words of these runs are hashed
        words, size = text.split(), n + length - 1
        edges = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
        wanted = np.cumsum(edges[:-1]) > 0
        data = np.fromiter(map(xxhash.xxh64_intdigest, compress(words, wanted.tobytes())), dtype=np.uint64, count=int(wanted.sum())).tobytes()
        place = (np.cumsum(wanted) - wanted)[at]
        return [data[a:b] for a, b in zip((8 * place).tolist(), (8 * (place + size)).tolist())]

    return repeats.carried(found, earlier_strings(repeats.contexts(docs, found, span), length))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")

    def finish(text: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, str]:
        words = text.split()
        kept, at = [], 0
        for a, b in stretches:
            kept += words[at:a]
            at = b
        kept += words[at:]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return repeats.apply(docs, covered(docs), finish, "n_words long, n_removed long, kept_sha256 string")
