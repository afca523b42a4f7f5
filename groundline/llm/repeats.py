"""What operators 7 and 8 share: which windows of fixed length may occur again, without shuffling every window.

A window of ``length`` symbols is filed under the least hash of the ``gram``
symbol strings in it (a minimizer), so equal windows are filed alike.
Neighbouring windows with one minimizer form a run; a run is known by its
minimizer g and a 128-bit cryptographic digest c of the bytes it spans.

1. ``settle`` drops the runs whose minimizer no other run has: their windows
   are unique. It decides nothing else. Only run records travel, packed in one
   compressed blob for each batch and bucket.
2. What is left is one class for each different run, with all its places
   (members). One copy of each class goes, with the bytes it spans, to a shard
   by minimizer (``contexts``), where an index (a suffix array, or an FM-index)
   finds the stretches that occur again; ``in_shards`` bounds what an index holds.
3. These stretches are carried to all members, gathered for each document and
   applied to its text.

A minimizer's classes are indexed together. A passage that k documents share is
one class inside, and up to k different ones at its two ends: that is the
largest group there is, and it holds each different run once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NO_ID = (1 << 63) - 1
SEGMENT = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_RECORD = np.dtype([("g", "<u8"), ("c", "<u8"), ("d", "<u8"), ("id", "<i8"), ("h", "<i8"), ("at", "<u4"), ("n", "<u4"), ("many", "u1")])
#: Flags of a record: its batch had several of its class; the run may repeat itself.
MANY, TWICE = 1, 2
#: Bytes of different runs that an index holds at a time, or those of one minimizer if they are more.
SHARD_BYTES = 8 << 20
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 17)
        with np.errstate(over="ignore"):
            for base in (_R, pow(_R, -1, 1 << 64)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _powers.append(np.multiply.accumulate(p))
        _powers[:] = _powers[-2:]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(h) - width + 1
    if width == 1:
        return h
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _twice(grams: np.ndarray, least: np.ndarray, width: int, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each run holds its minimizer at two places: only then can it repeat itself."""
    padded = np.zeros(len(least) + 2 * (width - 1), dtype=np.uint64)
    padded[width - 1 : width - 1 + len(least)] = ~least
    padded[: width - 1] = padded[len(padded) - width + 1 :] = np.iinfo(np.uint64).max
    anchors = np.flatnonzero(grams == ~sliding_least(padded, width))
    low, high = np.searchsorted(anchors, first), np.searchsorted(anchors, first + n + width - 1)
    count = high - low
    each = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    same = grams[anchors[each]] == np.repeat(least[first], count)
    return np.add.reduceat(same.astype(np.int64), np.cumsum(count) - count) > 1


def runs(symbols: np.ndarray, data: bytes, length: int, gram: int, within: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(g, c, d, at, n, twice) of the runs of a document's windows, a segment at a time.

    n counts windows, at most four times as many as a window has grams; c and d
    are the digest of the run's part of ``data``, which holds the symbols' bytes.
    """
    width, most = len(data) // max(1, len(symbols)), 4 * (length - gram + 1)
    for begin in range(0, len(symbols) - length + 1, SEGMENT):
        x = symbols[begin : begin + SEGMENT + length - 1]
        up, down = powers(len(x) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(x) + 1, dtype=np.uint64)
            np.cumsum(x * up[: len(x)], out=sums[1:])
            grams = mix((sums[gram:] - sums[:-gram]) * down[: len(x) - gram + 1])
        least = sliding_least(grams, length - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        n = np.diff(np.append(first, len(least)))
        if n.max() > most:
            pieces = -(-n // most)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first, n = np.repeat(first, pieces) + most * nth, np.minimum(np.repeat(n, pieces) - most * nth, most)
        low = ((first + begin) * width).tolist()
        high = ((first + begin + n + length - 1) * width).tolist()
        digest = hashlib.blake2b
        c = np.frombuffer(b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(low, high)]), dtype="<u8")
        twice = _twice(grams, least, length - gram + 1, first, n) if within else np.zeros(len(n), bool)
        yield least[first], c[::2], c[1::2], first + begin, n, twice


def packed(records: np.ndarray) -> bytes:
    """Records column by column, compressed; neighbours of one document are alike in most columns."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(records[f]).tobytes() for f in _RECORD.names))


def unpacked(blob: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(data) // _RECORD.itemsize, 0
    out = np.empty(n, dtype=_RECORD)
    for f in _RECORD.names:
        kind = _RECORD[f]
        out[f] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return out


def _classes(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records sorted by minimizer, class and document, and the first places of minimizers and of classes."""
    order = np.argsort(r["g"], kind="stable")
    g = r["g"][order]
    alike = np.flatnonzero(np.concatenate([[False], g[1:] == g[:-1]]) | np.concatenate([g[1:] == g[:-1], [False]]))
    some = r[order[alike]]
    order[alike] = order[alike][np.lexsort((some["at"], some["h"], some["id"], some["d"], some["c"], some["g"]))]
    r = r[order]
    new = np.ones(len(r), bool)
    new[1:] = r["g"][1:] != r["g"][:-1]
    minimizers = np.flatnonzero(new)
    new[1:] |= (r["c"][1:] != r["c"][:-1]) | (r["d"][1:] != r["d"][:-1])
    return r, minimizers, np.flatnonzero(new)


def _later(r: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a record's document has a greater id than its class's first one."""
    return r["id"] > np.repeat(r["id"][first], np.diff(np.append(first, len(r))))


_OUT = pa.schema([("kind", pa.int32()), ("g", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("flag", pa.bool_())])
RUNS = "kind int, g long, c long, d long, id long, h long, at long, n long, flag boolean"
#: A place of a class (flag: in a later document than its first), or the class itself at its first place (flag: it has several places, or later documents).
MEMBER, CLASS = 0, 1


def _rows(kind: int, r: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    signed = [pa.array(np.ascontiguousarray(r[f]).view(np.int64)) for f in ("g", "c", "d", "id", "h")]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), kind, np.int32)), *signed, *(pa.array(r[f].astype(np.int64)) for f in ("at", "n")), pa.array(flag)], schema=_OUT)


def keyed(docs: DataFrame) -> DataFrame:
    """id (a null one last), h (a hash of the text) and text: documents under the key that records carry."""
    text = common.text_or_empty()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def settle(docs: DataFrame, symbols: Callable[[bytes], tuple[np.ndarray, bytes]], length: int, gram: int, ordered: bool) -> DataFrame:
    """The classes whose windows may occur again, and their members (``RUNS``), written.

    ``symbols`` gives a text's symbols and their bytes. If documents are
    ``ordered``, a minimizer that one document alone has is dropped too.
    """
    buckets = common.parts_for(docs)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                found: list[np.ndarray] = []
                for doc_id, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    for g, c, d, at, n, twice in runs(*symbols(text.as_py().encode()), length, gram, not ordered):
                        r = np.empty(len(g), dtype=_RECORD)
                        r["g"], r["c"], r["d"], r["id"], r["h"], r["at"], r["n"], r["many"] = g, c, d, doc_id, h, at, n, TWICE * twice
                        found.append(r)
                if not found:
                    continue
                r, _, first = _classes(np.concatenate(found))
                del found
                # of a class that has several places here the first alone stands for the others, which need no answer
                size = np.diff(np.append(first, len(r)))
                if ordered:
                    spare = _later(r, first)
                    r["many"][first] |= (np.add.reduceat(spare.astype(int), first) > 0).astype(np.uint8) * MANY
                else:
                    spare = np.ones(len(r), bool)
                    spare[first] = False
                    r["many"][first] |= (size > 1).astype(np.uint8) * MANY
                done, r = r[spare], r[~spare]
                r = r[np.lexsort((r["at"], r["id"], r["g"] % buckets))]
                to = (r["g"] % buckets).astype(np.int32)
                edges = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(r))
                rows = [(int(to[a]), packed(r[a:b])) for a, b in zip(edges[:-1], edges[1:])]
                if len(done):
                    rows.append((-1 - int(done["g"][0] % buckets), packed(done)))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = unpacked(blob.as_py())
                if bucket < 0:
                    yield _rows(MEMBER, r, np.full(len(r), ordered))
                else:
                    held.setdefault(bucket, []).append(r)
        for bucket in [*held]:
            r, minimizers, first = _classes(np.concatenate(held.pop(bucket)))
            size = np.diff(np.append(minimizers, len(r)))
            kept = np.bitwise_or.reduceat(r["many"], minimizers) > 0
            if ordered:
                kept |= np.maximum.reduceat(r["id"], minimizers) > np.minimum.reduceat(r["id"], minimizers)
            else:
                kept |= size > 1
            held_places = np.repeat(kept, size)
            later = _later(r, first) if ordered else np.zeros(len(r), bool)
            more = np.diff(np.append(first, len(r))) > 1 if not ordered else np.add.reduceat(later.astype(int), first) > 0
            more |= np.bitwise_or.reduceat(r["many"] & MANY, first) > 0
            yield _rows(CLASS, r[first[held_places[first]]], more[held_places[first]])
            yield _rows(MEMBER, r[held_places], later[held_places])

    sent = keyed(docs).transform(common.in_arrow, send, "bucket int, blob binary")
    place = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.col("bucket"))
    return common.written(sent.repartition(buckets, place).transform(common.in_arrow, decide, RUNS), "repeat-runs")


def contexts(docs: DataFrame, found: DataFrame, span: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]) -> DataFrame:
    """(g, c, d, owner, flag, data): one copy of each class with the bytes that it spans, dealt and sorted by minimizer.

    ``span`` gives the bytes of a text's runs, whose first windows and counts of windows it gets.
    """
    wanted = found.where(F.col("kind") == CLASS).groupBy("id", "h").agg(F.collect_list(F.struct("g", "c", "d", "at", "n", "flag")).alias("wanted"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, wants in zip(batch.column(0), batch.column(1), batch.column(2)):
                g, c, d, at, n, flag = (wants.values.field(k) for k in range(6))
                data = span(text.as_py().encode(), at.to_numpy(), n.to_numpy())
                yield pa.RecordBatch.from_arrays([g, c, d, pa.array([doc_id.as_py()] * len(data), pa.int64()), flag, pa.array(data, pa.binary())], ["g", "c", "d", "owner", "flag", "data"])

    joined = keyed(docs).join(wanted, ["id", "h"]).select("id", "text", "wanted")
    rows = joined.transform(common.in_arrow, cut, "g long, c long, d long, owner long, flag boolean, data binary")
    return rows.repartition(common.parts_for(docs), "g").sortWithinPartitions("g")


def in_shards(rows: DataFrame, index: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``index(g, c, d, owner, flag, lengths, data)`` over as many minimizers of ``contexts`` at a time as ``SHARD_BYTES`` allow."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def shard(table: pa.Table) -> Iterator[pa.RecordBatch]:
            c, d = (table.column(f).to_numpy() for f in "cd")
            order = np.lexsort((d, c))
            again = order[1:][(c[order][1:] == c[order][:-1]) & (d[order][1:] == d[order][:-1])]
            if len(again):  # rows that repeat an id and its text bring their classes again
                table = table.filter(pa.array(~np.isin(np.arange(len(c)), again)))
            table = table.combine_chunks()
            data = table.column("data").chunk(0)
            offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]
            columns = [table.column(f).to_numpy() for f in ("g", "c", "d", "owner", "flag")]
            yield from index(*columns, np.diff(offsets).astype(np.int64), data.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes())

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                held.append(part)
                size += part.column(5).nbytes
                if size >= SHARD_BYTES:
                    table = pa.Table.from_batches(held)
                    g = table.column("g").to_numpy()
                    last = int(np.searchsorted(g, g[-1]))  # its minimizer may go on
                    if last:
                        yield from shard(table.slice(0, last))
                        held = table.slice(last).to_batches()
                        size = sum(x.column(5).nbytes for x in held)
        if held and sum(x.num_rows for x in held):
            yield from shard(pa.Table.from_batches(held))

    return rows.transform(common.in_arrow, run, schema)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of stretches as sorted, separate ones; touching stretches are one."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def carried(found: DataFrame, stretches: DataFrame) -> DataFrame:
    """(id, h, a, b): ``stretches`` (c, d, flag, from, to) of classes at all places of these; a null flag goes to all members."""
    members = found.where(F.col("kind") == MEMBER).select("c", "d", "id", "h", "at", "flag")
    stretches = stretches.select(F.col("c").alias("of_c"), F.col("d").alias("of_d"), F.col("flag").alias("of_flag"), "from", "to")
    same = (members["c"] == stretches["of_c"]) & (members["d"] == stretches["of_d"]) & F.coalesce(stretches["of_flag"] == members["flag"], F.lit(True))
    return members.join(stretches, same).select("id", "h", (F.col("at") + F.col("from")).alias("a"), (F.col("at") + F.col("to")).alias("b"))


def apply(docs: DataFrame, covered: DataFrame, finish: Callable[[bytes, list[tuple[int, int]]], tuple], names: str) -> DataFrame:
    """doc_id and what ``finish(text, stretches)`` gives, for every row; ``covered`` has (id, h, a, b) in symbols."""
    stretches = covered.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("cover"))
    joined = keyed(docs).join(stretches, ["id", "h"], "left").select("id", "text", "cover")
    fields = [x.split()[0] for x in names.split(", ")]
    types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in names.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cover in zip(batch.column(1), batch.column(2).to_pylist()):
                a = np.array([x["a"] for x in cover or ()], dtype=np.int64)
                b = np.array([x["b"] for x in cover or ()], dtype=np.int64)
                out.append(finish(text.as_py().encode(), merged(a, b)))
            cols = list(zip(*out)) if out else [[]] * len(fields)
            ids = pa.array([None if x == NO_ID else x for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *fields])

    return joined.mapInArrow(run, f"doc_id long, {names}")
