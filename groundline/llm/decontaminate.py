"""Operator 10: benchmark decontamination by latent semantic retrieval.

Documents are coded as the numbers of the benchmark's terms (0: any other word)
and cut into overlapping passages. TF-IDF rows of the passages, with document
frequencies counted over all of them, are projected by a distributed randomised
SVD (a random range finder and one subspace iteration; the benchmark's own
passages take part with as much weight as the corpus). Passages whose latent
cosine with an item is high are candidates, and so is every place where GRAM
words in a row are an item's (looked up by hash), so that no verbatim item
depends on the cosine; a longest common subsequence of words, and one of the
item's answer alone, decides.

The answer is what follows an "Answer:" or "A:" mark, or else the last sentences
of ``ANSWER_WORDS`` words or more.
Long items are searched for in parts and decided as a whole.

The benchmark is a stated query set: the terms and latent rows of up to
``max_items`` items and ``max_terms`` terms go to every task, more items are
searched group by group; nothing that grows with the corpus goes there. The
rank grows with the items. Sums over tasks are combined in two steps.

Defined results: a null text has no words; items without words are no query;
items under ``MIN_WORDS`` words must occur whole; a null id is reported as
such; repeated rows of a table are each handled; other columns are ignored; an
empty table on either side gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK, BLOCKS = 30, 2  # words a block; blocks a passage
RANK, MOST_RANK, ITEMS_A_RANK, EXTRA = 64, 256, 16, 8
#: Items and terms that one search holds in every task.
MAX_ITEMS, MAX_TERMS = 20_000, 200_000
COSINE, COVERED, ANSWER = 0.5, 0.56, 0.4
GRAM = 3  # words in a row that make a candidate
COMMON = 0.1  # terms in more than this share of passages say nothing
MIN_WORDS = 5
ANSWER_WORDS = 5  # an answer without a mark has as many words, so that one changed word does not undo it
MARKS = ".,;:!?\"'`()[]{}<>*#%&$-_=+~|/\\"
_BUCKET = 256
PIECE = 64  # rows summed one after another


_SPACED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + MARKS.encode(), b"abcdefghijklmnopqrstuvwxyz" + b" " * len(MARKS))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without marks."""
    text = text or ""
    return (text if text.isascii() else text.lower()).encode().translate(_SPACED).split()


def answer_of(text: str) -> str:
    marked = re.split(r"(?:^|\s)(?:answer|a)\s*:", text, flags=re.IGNORECASE)
    if len(marked) > 1 and marked[-1].strip():
        return marked[-1]
    sentences = [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if words_of(x)]
    for k in range(len(sentences) - 1, -1, -1):
        if len(words_of(last := " ".join(sentences[k:]))) >= ANSWER_WORDS:
            return last
    return text


def code(text: str, terms: dict[bytes, int]) -> np.ndarray:
    """The number of each word's term; 0 for words that no item has."""
    words = words_of(text)
    return np.fromiter(map(terms.get, words, repeat(0)), dtype=np.uint32, count=len(words))


def coded(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, h (a hash of the text) and ids (32-bit term numbers) of every row, written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [code(t.as_py(), terms).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "h", "ids"])

    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    return common.written(rows.transform(common.in_arrow, run, "doc_id long, h long, ids binary"), "latent-coded", common.TEXT_ROWS)


def _blocks(all_ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term numbers and block of each word of several documents, and each document's first block (one more at the end).

    Empty blocks between documents keep passages, BLOCKS blocks each, apart.
    """
    counts = np.array([max(1, -(-len(x) // BLOCK)) + BLOCKS - 1 for x in all_ids])
    first = np.concatenate([[0], np.cumsum(counts)])
    ids = np.concatenate(all_ids).astype(np.int64)
    lengths = np.array([len(x) for x in all_ids])
    within = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    block = np.repeat(first[:-1], lengths) + within // BLOCK
    keep = ids > 0
    return ids[keep], block[keep], first


def _sums(rows: np.ndarray, at: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of ``rows[at[b : b + n]]`` for each ``b`` of ``begin`` and ``n`` of ``count``, one at least: the first of all groups, then the second of those that have one."""
    order = np.argsort(-count, kind="stable")
    begin = begin[order]
    out = rows[at[begin]]
    for j, m in enumerate(np.searchsorted(-count[order], -np.arange(1, count.max()), side="left"), 1):
        out[:m] += rows[at[begin[:m] + j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return begin, np.diff(np.append(begin, len(sorted_keys)))


def _summed(ids: np.ndarray, block: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
    """Sum of ``rows[ids]`` in each block, (n, k)."""
    out = np.zeros((n, rows.shape[1]), dtype=np.float32)
    if len(ids):
        begin, count = _groups(block)
        out[block[begin]] = _sums(rows, ids, begin, count)
    return out


def _gathered(ids: np.ndarray, block: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each term of ``ids`` and the sum of ``rows[block]`` over its places: of PIECE places first, then of these sums."""
    order = np.argsort(ids.astype(np.uint16) if len(ids) and ids.max() < 1 << 16 else ids, kind="stable")
    ids, block = ids[order], block[order]
    if not len(ids):
        return ids, np.zeros((0, rows.shape[1]), dtype=rows.dtype)
    begin, count = _groups(ids)
    pieces = -(-count // PIECE)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(first, pieces)
    sums = _sums(rows, block, np.repeat(begin, pieces) + nth * PIECE, np.minimum(PIECE, np.repeat(count, pieces) - nth * PIECE))
    return ids[begin], _sums(sums, np.arange(len(sums)), first, pieces)


def _windows(blocks: np.ndarray) -> np.ndarray:
    """Sums of BLOCKS neighbours: the passage that begins at each block but the last ones."""
    out = blocks[: len(blocks) - BLOCKS + 1].copy()
    for k in range(1, BLOCKS):
        out += blocks[k : len(blocks) - BLOCKS + 1 + k]
    return out


def _batches(batches: Iterable[pa.RecordBatch], column: int, words: int = 100_000) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        held, begin, size = [], 0, 0
        for k in range(batch.num_rows):
            held.append(np.frombuffer(batch.column(column)[k].as_py(), dtype=np.uint32))
            size += len(held[-1])
            if size >= words or k == batch.num_rows - 1:
                yield batch.slice(begin, k + 1 - begin), held
                held, begin, size = [], k + 1, 0


def frequencies(rows: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, counting a passage once for every block of the term in it, and how many there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(terms + 1, dtype=np.int64), 0
        for _, held in _batches(batches, 0):
            ids, block, first = _blocks(held)
            pairs = np.unique(block * (terms + 1) + ids)
            total += np.bincount(pairs % (terms + 1), minlength=terms + 1)
            n += int(first[-1])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], ["term", "n"])

    got = rows.select("ids").transform(common.in_arrow, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(terms + 1, dtype=np.int64), 0
    for r in got:
        if r["term"] < 0:
            n = int(r["n"])
        else:
            out[r["term"]] = r["n"]
    return out, n


def _added(rows: DataFrame, terms: int, width: int, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A times ``basis`` over all passages (rows of A have unit length), summed over tasks in two steps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms + 1, width))
        weighted = (basis * idf[:, None]).astype(np.float32)
        squares = idf**2
        for _, held in _batches(batches, 0):
            ids, block, first = _blocks(held)
            rare = idf[ids] > 0
            ids, block = ids[rare], block[rare]
            y = _windows(_summed(ids, block, int(first[-1]), weighted))
            y /= np.maximum(_windows(np.bincount(block, squares[ids], int(first[-1]))), 1e-6).astype(np.float32)[:, None]
            # what each block gives back: the sum over the passages that it is in
            around = np.zeros((len(y) + 2 * (BLOCKS - 1), width), dtype=np.float32)
            around[BLOCKS - 1 : BLOCKS - 1 + len(y)] = y
            some, sums = _gathered(ids, block, _windows(around))
            total[some] += sums
        total *= idf[:, None]
        salt = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array(list(range(0, terms + 1, _BUCKET)), pa.int64()), pa.array([salt] * len(range(0, terms + 1, _BUCKET)), pa.int64()), pa.array([total[k : k + _BUCKET].tobytes() for k in range(0, terms + 1, _BUCKET)], pa.binary())], ["bucket", "salt", "block"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in part.column("block"))
        return pa.table({"bucket": part.column("bucket")[:1], "salt": part.column("salt")[:1], "block": pa.array([total.tobytes()], pa.binary())})

    schema = "bucket long, salt long, block binary"
    sums = rows.select("ids").transform(common.in_arrow, run, schema).groupBy("bucket", "salt").applyInArrow(add, schema)
    out = np.zeros((terms + 1, width))
    for r in sums.groupBy("bucket").applyInArrow(add, schema).collect():
        part = np.frombuffer(r["block"]).reshape(-1, width)
        out[r["bucket"] : r["bucket"] + len(part)] = part
    return out


class Sparse:
    """Rows of unit length over term numbers, each a list of terms and weights."""

    def __init__(self, rows: list[list[int]], idf: np.ndarray):
        terms, values = [], []
        for words in rows:
            ids, n = np.unique(np.array(words, dtype=np.int64), return_counts=True)
            weight = idf[ids] * n
            if not weight.any():  # only common words: they must do
                weight = n * 1e-3
            terms.append(ids)
            values.append(weight / np.linalg.norm(weight))
        self.terms, self.values = np.concatenate(terms), np.concatenate(values)
        self.first = np.cumsum([0, *map(len, terms[:-1])])
        self.row = np.repeat(np.arange(len(rows)), [*map(len, terms)])
        self.order = np.argsort(self.terms, kind="stable")

    def times(self, right: np.ndarray) -> np.ndarray:
        return np.add.reduceat(right[self.terms] * self.values[:, None], self.first, axis=0)

    def turned(self, right: np.ndarray, size: int) -> np.ndarray:
        """The transpose times ``right``, (size, k)."""
        out = np.zeros((size, right.shape[1]))
        terms = self.terms[self.order]
        new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        out[terms[new]] = np.add.reduceat(right[self.row[self.order]] * self.values[self.order][:, None], new, axis=0)
        return out


def rank_for(items: int) -> int:
    return min(MOST_RANK, max(RANK, items // ITEMS_A_RANK))


def latent(rows: DataFrame, queries: Sparse, idf: np.ndarray, rank: int, extra: int = EXTRA) -> np.ndarray:
    """The leading right singular vectors, (terms + 1, rank); ``queries`` are the benchmark's unit TF-IDF rows."""
    terms = len(idf) - 1
    width = min(rank + extra, terms + 1)
    basis = np.random.Generator(np.random.PCG64(10)).standard_normal((terms + 1, width))
    inner = basis
    for _ in range(2):
        inner = np.linalg.qr(basis)[0]
        basis = _added(rows, terms, width, inner, idf)
        own = queries.turned(queries.times(inner), terms + 1)
        basis += own * (np.linalg.norm(basis) / max(np.linalg.norm(own), 1e-9))
    values, vectors = np.linalg.eigh(inner.T @ basis + (inner.T @ basis).T)
    return inner @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def lcs(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each word of ``item``."""
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    full, row = (1 << len(item)) - 1, (1 << len(item)) - 1
    for w in words:
        match = row & places.get(w, 0)
        if match:
            row = ((row + match) | (row - match)) & full
    return len(item) - row.bit_count()


def _whole(item: list[int], words: np.ndarray) -> bool:
    """Whether ``item`` occurs word by word."""
    at = np.flatnonzero(words[: len(words) - len(item) + 1] == item[0]) if len(words) >= len(item) else []
    return any(words[k : k + len(item)].tolist() == item for k in at)


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row."""
    h = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
    for k in range(n):
        h = (h + ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Lookup:
    """Where rows of GRAM words (all of a shorter item's) stand in the items; rows of nothing but common words are left out."""

    def __init__(self, items: list[list[int]], idf: np.ndarray):
        found: dict[int, list[np.ndarray]] = {}
        for k, words in enumerate(items):
            ids = np.array(words, dtype=np.uint64)
            n = min(GRAM, len(ids))
            h = _grams(ids, n)
            at = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(idf[words] > 0, n).any(axis=1))
            found.setdefault(n, []).append(np.stack([h[at], np.full(len(at), k, np.uint64), at.astype(np.uint64)]))
        self.tables = []
        for n, parts in found.items():
            h, item, at = np.concatenate(parts, axis=1)
            order = np.argsort(h, kind="stable")
            bits = min(26, max(16, 3 + len(h).bit_length()))
            seen = np.zeros(1 << bits, bool)
            seen[h >> np.uint64(64 - bits)] = True
            self.tables.append((n, np.uint64(64 - bits), seen, h[order], item[order].astype(np.int64), at[order].astype(np.int64)))

    def places(self, held: list[np.ndarray]) -> np.ndarray:
        """(document, item, where the item would begin) of every hit, each once."""
        ids = np.concatenate(held).astype(np.uint64)
        begin = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        out = [np.empty((0, 3), np.int64)]
        for n, shift, seen, table, item, at in self.tables:
            h = _grams(ids, n)
            p = np.flatnonzero(seen[h >> shift])
            low, high = np.searchsorted(table, h[p]), np.searchsorted(table, h[p], side="right")
            d = np.searchsorted(begin, p, side="right") - 1
            some = (high > low) & (p + n <= begin[d + 1])
            p, low, d, count = p[some], low[some], d[some], (high - low)[some]
            each = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            d, p = np.repeat(d, count), np.repeat(p, count)
            out.append(np.stack([d, item[each], p - begin[d] - at[each]], axis=1))
        return np.unique(np.concatenate(out), axis=0)


FOUND = "doc_id long, h long, item_id long, cosine double, covered double, answer_covered double"


def item_groups(items: list[tuple[int, str, list[bytes]]], max_items: int, max_terms: int) -> Iterator[list[tuple[int, str, list[bytes]]]]:
    """Items in turn, in groups that stay under both bounds (an item that has more terms alone is a group)."""
    held, terms = [], set()
    for item in items:
        new = {*item[2]} - terms
        if held and (len(held) == max_items or len(terms) + len(new) > max_terms):
            yield held
            held, terms, new = [], set(), {*item[2]}
        held.append(item)
        terms |= new
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, least: float = COVERED, answer: float = ANSWER, max_items: int = MAX_ITEMS, max_terms: int = MAX_TERMS) -> DataFrame:
    """doc_id, h, item_id, cosine, covered and answer_covered of every document that holds an item."""
    got = [(i, t, words_of(t)) for i, t in benchmark.select(F.col("item_id").cast("long"), common.text_or_empty()).toLocalIterator()]
    found = [_searched(docs, group, cosine, least, answer) for group in item_groups([x for x in got if x[2]], max_items, max_terms)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], FOUND)


def _searched(docs: DataFrame, got: list[tuple[int, str, list[bytes]]], cosine: float, least: float, answer: float) -> DataFrame:
    """``contaminated`` for one group of items."""
    terms = {t: k + 1 for k, t in enumerate(sorted({w for _, _, words in got for w in words}))}
    items = [([terms[w] for w in words], [terms[w] for w in words_of(answer_of(t))]) for _, t, words in got]
    numbers = [i for i, _, _ in got]
    rows = coded(docs, terms)
    df, n = frequencies(rows, len(terms))
    idf = np.log((n + 1) / (df + 1))
    idf[df > COMMON * n] = 0
    idf[0] = 0
    # long items are looked for in parts, each as long as a passage's sure inside
    inside = BLOCK * (BLOCKS - 1)
    parts = [(k, words[a : a + inside]) for k, (words, _) in enumerate(items) for a in range(0, max(1, len(words) - inside // 2), inside)]
    queries = Sparse([words for _, words in parts], idf)
    vectors = latent(rows, queries, idf, rank_for(len(items)))
    sought = queries.times(vectors)
    sought /= np.maximum(np.linalg.norm(sought, axis=1, keepdims=True), 1e-9)
    of_part = np.array([k for k, _ in parts])
    common_only = [k for k, (words, _) in enumerate(items) if not idf[words].any()]
    projected = (vectors * idf[:, None]).astype(np.float32)
    wanted = sought.T.astype(np.float32)

    lookup = Lookup([words for words, _ in items], idf)

    distinct = [np.unique(words) for words, _ in items]
    of_item: dict[int, np.ndarray] = {}
    for k in range(len(items)):
        of_item[k] = np.flatnonzero(of_part == k) if len(parts) > len(items) else np.array([k])
    marked = np.zeros(len(terms) + 1, dtype=bool)

    def decide(k: int, words: np.ndarray) -> tuple[float, float] | None:
        item, its_answer = items[k]
        if len(item) < MIN_WORDS:
            return (1.0, 1.0) if _whole(item, words) else None
        marked[distinct[k]] = True
        shared = words[marked[words]]  # other words are in no common subsequence
        marked[distinct[k]] = False
        if len(shared) < least * len(item):
            return None  # too few of its words are there, in whatever order
        near = shared.tolist()
        covered = lcs(item, near) / len(item)
        of_answer = lcs(its_answer, near) / max(1, len(its_answer))
        return (covered, of_answer) if covered >= least and of_answer >= answer else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in _batches(batches, 2):
            ids, block, first = _blocks(held)
            rare = idf[ids] > 0
            found = _windows(_summed(ids[rare], block[rare], int(first[-1]), projected))
            start = np.flatnonzero(found.any(axis=1))
            found = found[start]
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
            owner = np.searchsorted(first, start, side="right") - 1
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            step = max(256, (4 << 20) // wanted.shape[1])
            for begin in range(0, len(found), step):
                score = found[begin : begin + step] @ wanted
                for p, q in zip(*np.nonzero(score >= cosine)):
                    d, k = int(owner[begin + p]), int(of_part[q])
                    a = (int(start[begin + p]) - int(first[d])) * BLOCK
                    reach = max(BLOCK, len(items[k][0]) - BLOCK * (BLOCKS - 1))
                    if (old := best.get((d, k))) is None or old[1] < 1:
                        if verdict := decide(k, held[d][max(0, a - reach) : a + BLOCK * BLOCKS + reach]):
                            best[d, k] = max(old or (0.0,) * 3, (float(score[p, q]), *verdict), key=lambda v: v[1:])
            edges = np.searchsorted(owner, np.arange(len(held) + 1))
            for d, k, at in lookup.places(held).tolist():
                if (old := best.get((d, k))) is not None and old[1] == 1:
                    continue
                a, b = max(0, at - BLOCK), at + len(items[k][0]) + BLOCK
                if verdict := decide(k, held[d][a:b]):
                    begins = (start[edges[d] : edges[d + 1]] - first[d]) * BLOCK
                    near = found[edges[d] : edges[d + 1]][(begins < b) & (begins + BLOCK * BLOCKS > a)]
                    score = (near @ wanted[:, of_item[k]]).max() if len(near) else 0
                    best[d, k] = max(old or (0.0,) * 3, (float(score), *verdict), key=lambda v: v[1:])
            for k in common_only:  # no direction to search in
                for d, words in enumerate(held):
                    if _whole(items[k][0], words):
                        best[d, k] = (0.0, 1.0, 1.0)
            keys = [*best]
            at = pa.array([d for d, _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([numbers[k] for _, k in keys], pa.int64()), *(pa.array([best[x][c] for x in keys], pa.float64()) for c in range(3))], ["doc_id", "h", "item_id", "cosine", "covered", "answer_covered"])

    return rows.transform(common.in_arrow, run, FOUND)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "covered", "answer_covered")
