"""Operator 5: SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two fingerprints that differ in at
most ``distance`` bits differ in at most ``distance // segments`` bits of some
segment, so each fingerprint looks its segments up in tables of segment values
at every value of that Hamming ball, and matches are verified on all 64 bits.
Where a pair differs in one bit of the segment, only the side that has 0 there
looks it up, so each pair meets once.

Buckets with many fingerprints (a value that a third of a corpus shares) are
cut again: the bits outside the segment are dealt into ``distance + 1`` pieces,
one of which must be equal, and so on until the buckets are small or no bits
are left. A task emits a spanning forest of the links that it finds, not all
pairs. Components are then found over fingerprints by alternating star
operations, never on the driver.

Defined results: a null text is empty; a text without words has fingerprint 0
and is linked like any other; equal fingerprints are one node, so repeated rows
cost one lookup; a null id takes part but is never a component's id (null only
where a component has no other); other columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
WORDS, DISTANCE, SEGMENTS = 3, 3, 2
#: A bucket with more table entries than this is cut again.
BUCKET = 2048
_CHUNK = 1 << 16
_LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: str, words: int) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = map(b" ".join, zip(*(found[k:] for k in range(words))))
    return np.fromiter((digest(s, SEED) for s in joined), dtype=np.uint64, count=len(found) - words + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set: eight byte lanes at a time, 255 hashes before a lane is full."""
    total = np.zeros(64, dtype=np.int64)
    for begin in range(0, len(hashes), _CHUNK):
        part = hashes[begin : begin + _CHUNK]
        edges = np.arange(0, len(part), 255)
        for shift in range(8):
            lanes = np.add.reduceat((part >> np.uint64(shift)) & _LANES, edges)
            total[shift::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return total


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The shingle hashes of the k-th fingerprint: as they are for 0, else put through a 64-bit finaliser."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(text: str | None, words: int = WORDS, count: int = 1) -> list[int]:
    """``count`` SimHashes of a text as unsigned numbers; a bit is set if more than half the shingle hashes have it."""
    return _prints(_shingle_hashes(text or "", words), count)


def _prints(hashes: np.ndarray, count: int) -> list[int]:
    if not len(hashes):
        return [0] * count
    return [int(np.packbits(bit_counts(remixed(hashes, k)) * 2 > len(hashes), bitorder="little").view("<u8")[0]) for k in range(count)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return fingerprints_of(text, words)[0]


def print_names(count: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, count))]


def fingerprints(docs: DataFrame, words: int = WORDS, count: int = 1) -> DataFrame:
    """doc_id and fp, fp1, ... (the fingerprints as signed longs) of every row."""
    names = print_names(count)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprints_of(t.as_py(), words, count) for t in batch.column(1)], dtype=np.uint64).reshape(-1, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(count))], ["doc_id", *names])

    schema = ", ".join(["doc_id long", *(f"{name} long" for name in names)])
    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).transform(common.in_arrow, run, schema)


def _segments(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _balls(width: int, radius: int) -> np.ndarray:
    """Masks of 1 to ``radius`` bits in ``width``."""
    if radius > 1:
        raise ValueError("use more segments: balls of radius 0 and 1 are looked up")
    return np.array([1 << b for b in range(width)] if radius else [], dtype=np.uint64)


def entries(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """(segment, key, fp, probe): each fingerprint's table entries and lookups."""
    layout, radius = _segments(segments), distance // segments

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for begin in range(0, len(every), _CHUNK):
                fps = every[begin : begin + _CHUNK]
                for k, (first, width) in enumerate(layout):
                    value = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
                    keys, who, probe = [value], [fps], [np.zeros(len(fps), bool)]
                    for mask in _balls(width, radius):
                        zero = (value & mask) == 0
                        keys.append(value[zero] | mask)
                        who.append(fps[zero])
                        probe.append(np.ones(int(zero.sum()), bool))
                    keys, who, probe = map(np.concatenate, (keys, who, probe))
                    for at in range(0, len(keys), _CHUNK):
                        cut = slice(at, at + _CHUNK)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[cut]), k, np.int32)), pa.array(keys[cut].view(np.int64)), pa.array(who[cut].view(np.int64)), pa.array(probe[cut])], ["segment", "key", "fp", "probe"])

    return nodes.select("fp").transform(common.in_arrow, run, "segment int, key long, fp long, probe boolean")


class Forest:
    """Union-find over any hashable items; ``join`` tells whether it linked two trees."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(fps: np.ndarray, starts: np.ndarray, probes: np.ndarray, distance: int, forest: Forest) -> None:
    """Puts the links of the buckets that begin at ``starts`` into the forest."""
    for begin, end in zip(starts, [*starts[1:], len(fps)]):
        if end - begin < 2:
            continue
        part, probe = fps[begin:end], probes[begin:end]
        table, lookups = part[~probe], part
        if not len(table):
            continue
        for at in range(0, len(lookups), max(1, _CHUNK // len(table))):
            some = lookups[at : at + max(1, _CHUNK // len(table))]
            near = np.bitwise_count(some[:, None] ^ table[None, :]) <= distance
            some, near = some[near.any(axis=1)], near[near.any(axis=1)]
            if not len(some):
                continue
            label = np.arange(len(table))  # the least table entry that each one reaches through these lookups
            while True:
                rows = np.where(near, label, len(table)).min(axis=1)
                new = np.minimum(label, np.where(near, rows[:, None], len(table)).min(axis=0))
                if (new == label).all():
                    break
                label = new
            moved = np.flatnonzero(label != np.arange(len(table)))
            for a, b in [*zip(some.tolist(), table[rows].tolist()), *zip(table[moved].tolist(), table[label[moved]].tolist())]:
                if a != b:
                    forest.join(a, b)


def _bucket_links(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """(a, b): links found in the buckets of ``rows``; each task links what it has found connected to the least of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        tail: list[np.ndarray] | None = None

        def look(cols: list[np.ndarray], edges: np.ndarray) -> None:
            _links(cols[-2].view(np.uint64), edges, cols[-1], distance, forest)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = cols if tail is None else [np.concatenate(x) for x in zip(tail, cols)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:-2]], axis=0)
            edges = np.flatnonzero(new)
            last = edges[-1]  # the last bucket may go on in the next batch
            tail = [c[last:] for c in cols]
            if last:
                sizes = np.diff(edges)
                held = np.repeat(sizes > 1, sizes)
                kept = [c[:last][held] for c in cols]
                if len(kept[0]):
                    look(kept, np.concatenate([[0], np.cumsum(sizes[sizes > 1])[:-1]]))
        if tail is not None and len(tail[0]) > 1:
            look(tail, np.array([0]))
        nodes = [*forest.up]
        for at in range(0, len(nodes), _CHUNK):
            part = nodes[at : at + _CHUNK]
            a, b = np.array(part, dtype=np.uint64), np.array([forest.root(x) for x in part], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    spread = rows.select(*keys, "fp", "probe").repartition(*keys).sortWithinPartitions(*keys)
    return spread.transform(common.in_arrow, run, "a long, b long")


def _pieces(key_bits: int, distance: int) -> list[int]:
    """Masks that deal the bits outside ``key_bits`` into ``distance + 1`` pieces."""
    free = [b for b in range(64) if not key_bits >> b & 1]
    count = distance + 1
    if len(free) < 2 * count:
        return []
    cut = [len(free) * k // count for k in range(count + 1)]
    return [sum(1 << b for b in free[x:y]) for x, y in zip(cut, cut[1:])]


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``nodes`` (fp) that join all within ``distance`` bits."""
    layout = _segments(segments)
    rows = common.written(entries(nodes, distance, segments), "simhash-entries")
    table = rows.where("not probe").groupBy("segment", "key").count().where(F.col("count") > bucket).select("segment", "key")
    hot = common.written(table, "simhash-hot")
    if hot.isEmpty():
        return _bucket_links(rows, ["segment", "key"], distance)
    # what stands in a hot bucket looks up the values around it, so those are cut as well
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1).cast("long") * (1 << b) for b in range(max(w for _, w in layout))])
    hot = hot.select("segment", F.explode(F.transform(flips, lambda m: F.col("key").bitwiseXOR(m))).alias("key")).distinct()
    found = [_bucket_links(rows.join(hot, ["segment", "key"], "left_anti"), ["segment", "key"], distance)]
    level = rows.join(hot, ["segment", "key"], "left_semi").select(F.col("segment").cast("long").alias("path"), "key", F.lit(0).cast("long").alias("more"), "fp", "probe")
    # path numbers the choice of segment and of pieces so far; masks has the bits that each path's keys fix
    masks = {k: ((1 << w) - 1) << first for k, (first, w) in enumerate(layout)}
    while True:
        children = {path: _pieces(mask, distance) for path, mask in masks.items()}
        if not all(children.values()):
            found.append(_bucket_links(level, ["path", "key", "more"], distance))
            break
        cut = [F.struct(F.lit(path * 16 + i).cast("long").alias("path"), F.lit(piece - (1 << 64) if piece >> 63 else piece).cast("long").alias("mask")) for path, pieces in children.items() for i, piece in enumerate(pieces)]
        options = F.filter(F.array(*cut), lambda o: F.floor(o["path"] / 16) == F.col("path"))
        level = level.select(F.explode(options).alias("o"), "key", "more", "fp", "probe").select(F.col("o.path").alias("path"), "key", F.xxhash64("more", F.col("fp").bitwiseAND(F.col("o.mask"))).alias("more"), "fp", "probe")
        level = common.written(level, "simhash-level")
        masks = {path * 16 + i: masks[path] | piece for path, pieces in children.items() for i, piece in enumerate(pieces)}
        keys = ["path", "key", "more"]
        sizes = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("t")).where((F.col("n") > 1) & (F.col("t") > 0))
        sizes = common.written(sizes, "simhash-sizes")
        found.append(_bucket_links(level.join(sizes.where(F.col("n") <= 8 * bucket), keys, "left_semi"), keys, distance))
        large = sizes.where(F.col("n") > 8 * bucket)
        if large.isEmpty():
            break
        level = level.join(large, keys, "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``pairs`` (a, b): the least node that it reaches.

    Large-star and small-star steps in turn, each written, until the links no
    longer change. Minima are combined on the map side and joined back, so a
    node with many links is split like any other hot key.
    """
    now = common.written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = common.written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("the links did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _joined_by(prints: DataFrame, labels: DataFrame, name: str, distance: int, segments: int) -> DataFrame:
    """``labels`` (fp, first, root) with the roots that fingerprint ``name`` links made one.

    Each value of ``name`` stands for the least root that it occurs with; the
    others are linked to that one. Links within a root are left out, so a large
    group that an earlier fingerprint has joined costs no further rounds.
    """
    pairs = common.written(prints.select("fp", name).distinct().join(labels, "fp").select(name, "root").distinct(), "simhash-pairs")
    owners = common.written(pairs.groupBy(name).agg(F.min("root").alias("owner")), "simhash-owners")
    found = links(owners.select(F.col(name).alias("fp")), distance, segments)
    of = lambda side: owners.select(F.col(name).alias(side), F.col("owner").alias(f"owner_{side}"))
    between = found.join(of("a"), "a").join(of("b"), "b").select(F.col("owner_a").alias("a"), F.col("owner_b").alias("b")).where("a <> b")
    within = pairs.join(owners, name).where("root <> owner").select(F.col("root").alias("a"), F.col("owner").alias("b"))
    merged = components(between.unionByName(within)).withColumnRenamed("root", "new")
    moved = labels.join(merged, labels["root"] == F.col("node"), "left").select("fp", "first", F.coalesce("new", "root").alias("root"))
    return common.written(moved, "simhash-labels")


def linked(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, segments: int = SEGMENTS, count: int = 1) -> DataFrame:
    """doc_id, fp and component_id of every row; the id is the least doc_id of the component.

    With ``count`` fingerprints, rows are linked if any of these is within
    ``distance``: what one misses by chance, another may find.
    """
    prints = common.written(fingerprints(docs, words, count), "simhash-prints")
    labels = _labels(prints, distance, segments, count)
    least = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    names = labels.join(least, "root").select("fp", "component_id")
    return prints.select("doc_id", "fp").join(names, "fp").select("doc_id", "fp", "component_id")


def _labels(prints: DataFrame, distance: int, segments: int, count: int) -> DataFrame:
    """fp, first (its least doc_id) and root (the same for linked ones) of every different ``fp``."""
    nodes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = components(links(nodes, distance, segments))
    labels = nodes.join(found, nodes["fp"] == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    for name in print_names(count)[1:]:
        labels = _joined_by(prints, labels, name, distance, segments)
    return labels


def similar_groups(sets: list[np.ndarray], least: float) -> np.ndarray:
    """A number for each set, equal for sets that a chain of pairs with a Jaccard similarity of ``least`` or more joins.

    The first set that is in no star yet is held against all, and those like it
    are its star. Two stars can have a pair across only if its ends are within
    twice the distance of each other's centres (Jaccard distance is a metric),
    so only such sets are held against all as well.
    """
    size = np.array([len(x) for x in sets])
    numbers, places = np.unique(np.concatenate(sets), return_inverse=True)
    some = np.flatnonzero(size)
    begin = (np.cumsum(size) - size)[some]
    forest, star, across = Forest(), np.full(len(sets), -1), []

    def alike(k: int) -> np.ndarray:
        mine = np.zeros(len(numbers), dtype=bool)
        mine[places[begin[np.searchsorted(some, k)] :][: size[k]]] = True
        shared = np.zeros(len(sets), dtype=np.int64)
        shared[some] = np.add.reduceat(mine[places].astype(np.int32), begin)
        return shared / (size + size[k] - shared)

    for k in some.tolist():
        if star[k] < 0:
            like = alike(k)
            for x in np.flatnonzero(like >= least).tolist():
                forest.join(k, x)
            star[(star < 0) & (like >= least)] = k
            across += [(k, x) for x in np.flatnonzero(like >= 2 * least - 1 - 1e-9).tolist()]
    seen = set()
    for k, x in across:
        if star[x] != k and x not in seen and forest.root(k) != forest.root(x):
            seen.add(x)
            for y in np.flatnonzero(alike(x) >= least).tolist():
                forest.join(x, y)
    return np.array([forest.root(k) for k in range(len(sets))])


def near_groups(docs: DataFrame, least: float, words: int, distance: int, segments: int, count: int) -> DataFrame:
    """(doc_id, h, copies): one row for each group of rows that chains of pairs with a Jaccard similarity of ``least`` or more join.

    Fingerprints give the candidates, the components of ``linked``. In each of
    these, one text of every different set of shingles goes to a task that
    holds the sets against each other. The row is the group's first by doc_id
    (nulls last) and h, the hash of its text; ``copies`` is how many rows of the
    table have both, so repeated rows, ids and null ids are told apart.
    """
    names = print_names(count)

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, digests = np.empty((batch.num_rows, count), dtype=np.uint64), []
            for k, t in enumerate(batch.column(2)):
                hashes = _shingle_hashes(t.as_py(), words)
                fps[k] = _prints(hashes, count)
                digests.append(xxhash.xxh3_128_digest(np.unique(hashes).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(count))], ["doc_id", "h", "digest", *names])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, held = None, {}

        def flush() -> pa.RecordBatch:
            parts = similar_groups([*held.values()], least)
            return pa.RecordBatch.from_arrays([pa.array([root] * len(held), pa.int64()), pa.array([*held], pa.binary()), pa.array(parts, pa.int32())], ["root", "digest", "part"])

        for batch in batches:
            for r, digest, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if r != root and held:
                    yield flush()
                    held = {}
                root = r
                if digest not in held:
                    held[digest] = np.unique(_shingle_hashes(t.as_py(), words))
        if held:
            yield flush()

    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text.alias("text"))
    schema = ", ".join(["doc_id long, h long, digest binary", *(f"{name} long" for name in names)])
    prints = common.written(rows.transform(common.in_arrow, sketch, schema), "near-prints", common.TEXT_ROWS)
    labels = _labels(prints, distance, segments, count).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "copies"))
    same = prints.groupBy("fp", "digest", "doc_id", "h").agg(F.count(F.lit(1)).alias("copies"))
    classes = same.groupBy("fp", "digest").agg(first.alias("one"))
    classes = common.written(classes.join(labels, "fp").select("root", "digest", "one"), "near-classes")
    several = classes.groupBy("root").count().where("count > 1").select("root")
    wanted = classes.join(several, "root").select("root", "digest", F.col("one.doc_id").alias("one_id"), F.col("one.h").alias("one_h"))
    texts = rows.join(wanted, rows["h"].eqNullSafe(wanted["one_h"]) & rows["doc_id"].eqNullSafe(wanted["one_id"])).select("root", "digest", "text", "doc_id")
    dealt = texts.repartition("root").sortWithinPartitions("root", F.col("doc_id").asc_nulls_last(), "digest").select("root", "digest", "text")
    parts = common.written(dealt.transform(common.in_arrow, split, "root long, digest binary, part int"), "near-parts", common.TEXT_ROWS)
    found = classes.join(parts, ["root", "digest"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    return found.groupBy("root", "part").agg(F.min("one").alias("one")).select("one.doc_id", "one.h", "one.copies")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
