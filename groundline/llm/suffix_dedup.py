"""Operator 7: removal of byte strings that occur again, by enhanced suffix arrays.

``repeats`` drops the windows whose minimizer no other run has. Of what is left,
one copy of each different run is indexed, shard by shard: a suffix array of
the suffixes that share ``length`` bytes with another, held against each other
byte by byte, the common prefixes of neighbours, and a stack scan that builds
the tree of common-prefix intervals. An interval whose suffixes are preceded by
different bytes (or by none) is a maximal repeat; so is a run that has several
places, as a whole. Each suffix names the deepest maximal repeat that it begins
and each repeat the one above, so all occurrences of all groups take one row a
suffix: those of a group are its own and those of the groups under it, at all
places of their runs. The removed bytes are the union of these occurrences.

Strings are maximal within the runs of a shard: a longer repeat is a chain of
groups that overlap.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; rows that repeat an id and its text are documents of their own, so
both lose what they share; a null id is like any other; other columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

LENGTH, GRAM = 200, 50
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 64, 256, dtype=np.uint64)


def symbols(text: bytes) -> tuple[np.ndarray, bytes]:
    return _BYTES[np.frombuffer(text, dtype=np.uint8)], text


def suffix_order(values: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` values that follow, by prefix doubling.

    Every value that ends a string is unique, so suffixes never compare past it.
    """
    rank, h = spread_ranks(values), 1
    active = np.arange(len(rank))
    while h < depth and len(active):
        far = np.full(len(active), -1, dtype=np.int64)
        inside = active + h < len(rank)
        far[inside] = rank[active[inside] + h]
        order = np.lexsort((far, rank[active]))
        active, far = active[order], far[order]
        head = rank[active]
        same = (head[1:] == head[:-1]) & (far[1:] == far[:-1])
        # new ranks: first place within the old rank; places equal to neighbours stay together
        block = np.concatenate([[True], head[1:] != head[:-1]])
        at = np.arange(len(active))
        base = at - np.maximum.accumulate(np.where(block, at, 0))
        step = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
        rank[active] = head + base - (at - step)
        alone = np.concatenate([[True], ~same]) & np.concatenate([~same, [True]])
        active = active[~alone]
        h *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def spread_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks that leave room for equals: each value's rank is the number of smaller ones."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    first = np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))
    return rank


def _eight(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as numbers that compare like them."""
    return np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))


def repeated_suffixes(data: bytes, ends: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` that share ``least`` bytes with another: in order, with common prefixes.

    ``ends`` has the end of each suffix's string. Suffixes are put together by
    a hash of their first ``least`` bytes, which are then compared, and sorted
    by what follows, eight bytes a round, in which only those still alike take
    part. A common prefix under ``least`` counts as 0.
    """
    x, _ = symbols(data)
    up, down = repeats.powers(len(x) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        head = repeats.mix((sums[starts + least] - sums[starts]) * down[starts])
    order = np.argsort(head, kind="stable")
    head = head[order]
    same = head[1:] == head[:-1]
    held = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at, rank = starts[order][held], np.cumsum(np.concatenate([[True], ~same]))[held]
    end = ends[order][held]
    if not len(at):
        return at, at
    eight = _eight(data + bytes(8))
    first = np.concatenate([[True], rank[1:] != rank[:-1]])
    heads = [*range(0, least - 7, 8), max(0, least - 8)] if least >= 8 else []
    rest = np.flatnonzero(~first)
    if any((eight[at[rest] + k] != eight[at[rest - 1] + k]).any() for k in heads):
        # equal hashes of different bytes: sorted by the bytes themselves
        order = np.lexsort([*(eight[at + k] for k in reversed(heads)), rank])
        at, end, rank = at[order], end[order], rank[order]
        first = np.concatenate([[True], rank[1:] != rank[:-1]])
        for k in heads:
            first[1:] |= eight[at[1:] + k] != eight[at[:-1] + k]
    rank = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    place = np.arange(len(at))  # suffixes in their present order
    lcp = np.where(first, 0, least)
    live, depth = np.arange(len(at)), least
    while len(live):
        who = place[live]
        left = np.minimum(end[who] - at[who] - depth, 8)
        key = eight[np.minimum(at[who] + depth, len(data))].astype(np.uint64)
        cut = left < 8
        key[cut] &= ~(np.iinfo(np.uint64).max >> (np.maximum(left[cut], 0) * 8).astype(np.uint64))
        order = np.lexsort((left, key, rank[live]))
        who, key, left = who[order], key[order], left[order]
        place[live] = who
        block = np.concatenate([[True], rank[live][1:] != rank[live][:-1]])
        apart = np.concatenate([[0], key[1:] ^ key[:-1]]).astype(np.uint64)
        zero = np.full(len(live), 8)
        for k in range(8):
            zero[(apart >> np.uint64(8 * k)) > 0] = 7 - k
        shared = np.minimum(zero, np.minimum(left, np.concatenate([[8], left[:-1]])))
        lcp[live[~block]] = depth + shared[~block]
        split = block | (shared < 8)
        rank[live] = live[np.maximum.accumulate(np.where(split, np.arange(len(live)), 0))]
        alone = split & np.concatenate([split[1:], [True]])
        live, depth = live[~alone], depth + 8
    return at[place], lcp


def intervals(lcp: np.ndarray, before: np.ndarray, least: int) -> tuple[list[tuple[int, int, int, int, bool]], np.ndarray]:
    """Stack scan of the common-prefix intervals of at least ``least``.

    Returns (length, from, to, parent, diverse) for each interval, ``to``
    exclusive and parent -1 at the top, and the deepest interval of each suffix
    (-1: none). ``before`` has the value left of each suffix, a unique negative
    number where there is none.
    """
    found: list[list] = []
    deepest = np.full(len(lcp), -1, dtype=np.int64)
    stack: list[int] = []
    values, left = lcp.tolist(), before.tolist()
    # an interval: length, from, to, parent, diverse, a left value
    for i in range(1, len(values) + 1):
        now = values[i] if i < len(values) else 0
        begin = i - 1
        while stack and found[stack[-1]][0] > now:
            k = stack.pop()
            top = found[k]
            top[2], begin = i, top[1]
            if now >= least and (not stack or found[stack[-1]][0] < now):
                found.append([now, begin, -1, -1, top[4], top[5]])  # the parent takes over the child
                top[3] = len(found) - 1
                stack.append(len(found) - 1)
            elif stack:
                up = found[stack[-1]]
                top[3] = stack[-1]
                up[4] = up[4] or top[4] or up[5] != top[5]
        if now >= least:
            if not stack or found[stack[-1]][0] < now:
                found.append([now, i - 1, -1, stack[-1] if stack else -1, False, left[i - 1]])
                stack.append(len(found) - 1)
                deepest[i - 1] = stack[-1]
            top = found[stack[-1]]
            top[4] = top[4] or left[i] != top[5]
            deepest[i] = stack[-1]
    return [tuple(x[:5]) for x in found], deepest


def _shard(lengths: np.ndarray, data: bytes, least: int) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
    """Suffixes of the strings in ``data`` that occur again: number of the string and place of each, and their intervals."""
    ends = np.cumsum(lengths)
    windows = np.maximum(lengths - least + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), windows)
    starts = np.arange(windows.sum()) + np.repeat(ends - lengths - (np.cumsum(windows) - windows), windows)
    order, lcp = repeated_suffixes(data, ends[owner], starts, least)
    owner = np.searchsorted(ends, order, side="right")
    place = order - (ends - lengths)[owner]
    left = np.frombuffer(data, dtype=np.uint8)
    before = np.where(place > 0, left[order - 1].astype(np.int64), -1 - order) if len(order) else order
    found, deepest = intervals(lcp, before, least)
    return owner, place, found, deepest


def nearest_diverse(found: list[tuple[int, int, int, int, bool]]) -> np.ndarray:
    """For each interval the deepest one around it, itself included, that is a maximal repeat (-1: none); one more entry, -1, for none."""
    parent = np.array([*(f[3] for f in found), -1], dtype=np.int64)
    diverse = np.array([*(f[4] for f in found), True], dtype=bool)
    out = np.append(np.arange(len(found)), -1)
    while len(live := np.flatnonzero(~diverse[out])):
        out[live] = parent[out[live]]
    return out


def maximal_repeats(strings: list[bytes], least: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(number of the string, place)]) of every maximal repeat of ``strings``."""
    owner, place, found, _ = _shard(np.array([*map(len, strings)], dtype=np.int64), b"".join(strings), least)
    return [(n, sorted(zip(owner[a:b].tolist(), place[a:b].tolist()))) for n, a, b, _, diverse in found if diverse]


GROUPS = "c long, d long, flag boolean, from long, to long, of long, parent long, parent_length long"


def repeat_groups(rows: DataFrame, least: int = LENGTH) -> DataFrame:
    """(c, d, flag, from, to, of, parent, parent_length): where the maximal repeats of ``contexts`` lie.

    A row is an occurrence at all places of the class (c, d), from ``from`` to
    ``to``, of the group ``of``, the deepest there; ``parent`` is the group of
    shorter strings around it (null: none). ``flag`` is null.
    """

    def run(g: np.ndarray, c: np.ndarray, d: np.ndarray, first_id: np.ndarray, several: np.ndarray, lengths: np.ndarray, data: bytes) -> Iterator[pa.RecordBatch]:
        owner, place, found, deepest = _shard(lengths, data, least)
        nearest = nearest_diverse(found)
        length = np.array([*(f[0] for f in found), 0], dtype=np.int64)
        parent = np.array([*(f[3] for f in found), -1], dtype=np.int64)
        # a run with several places repeats as a whole: a group under the one that its beginning has in the tree
        around = np.full(len(lengths), -1, dtype=np.int64)
        begins = np.flatnonzero(place == 0)
        around[owner[begins]] = nearest[deepest[begins]]
        whole = np.flatnonzero(several & (length[around] < lengths))
        group = nearest[deepest]
        inside = np.flatnonzero(group >= 0)
        group, at, of = group[inside], place[inside], owner[inside]
        # numbers of groups: as in the tree, then one for each run that repeats as a whole
        base = xxhash.xxh64_intdigest(c[:1].tobytes() + d[:1].tobytes()) >> 1 & ~0xFFFFFFFF
        above = np.concatenate([nearest[parent[group]], around[whole]])
        columns = [
            np.concatenate([c[of], c[whole]]), np.concatenate([d[of], d[whole]]), None, np.concatenate([at, np.zeros(len(whole), np.int64)]), np.concatenate([at + length[group], lengths[whole]]),
            base + np.concatenate([group, len(found) + whole]), np.where(above >= 0, base + above, -1), length[above],
        ]
        n = len(columns[0])
        for a in range(0, n, 100_000):
            flat = [pa.nulls(len(columns[0][a : a + 100_000]), pa.bool_()) if x is None else pa.array(x[a : a + 100_000]) for x in columns]
            yield pa.RecordBatch.from_arrays(flat, [x.split()[0] for x in GROUPS.split(", ")])

    return repeats.in_shards(rows, run, GROUPS)


def _occurrences(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The runs of ``docs`` and the maximal repeats in them."""
    found = repeats.settle(docs, symbols, length, gram, ordered=False)
    span = lambda text, at, n: [text[a:b] for a, b in zip(at.tolist(), (at + n + length - 1).tolist())]
    return found, repeat_groups(repeats.contexts(docs, found, span), length)


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, h, a, b): byte stretches of documents that maximal repeats of ``length`` or more cover."""
    found, groups = _occurrences(docs, length, gram)
    return repeats.carried(found, _merged(groups))


def _merged(groups: DataFrame) -> DataFrame:
    """The union of the occurrences in each class, as ``carried`` takes it."""
    ordered = F.array_sort(F.collect_set(F.struct("from", "to")))
    grown = F.aggregate(
        ordered,
        F.lit(None).cast("array<struct<from:bigint,to:bigint>>"),
        lambda held, x: F.when(held.isNull(), F.array(x))
        .when(F.element_at(held, -1)["to"] < x["from"], F.concat(held, F.array(x)))
        .otherwise(F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(F.element_at(held, -1)["from"].alias("from"), F.greatest(F.element_at(held, -1)["to"], x["to"]).alias("to"))))),
    )
    return groups.groupBy("c", "d").agg(grown.alias("s")).select("c", "d", F.lit(None).cast("boolean").alias("flag"), F.explode("s").alias("s")).select("c", "d", "flag", "s.from", "s.to")


def groups_of(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rounds: int = 10_000) -> DataFrame:
    """(of, length, doc_id, h, at): every occurrence of every maximal repeat group of ``docs``, those of the groups under it included."""
    found, groups = _occurrences(docs, length, gram)
    groups = common.written(groups, "repeat-groups")
    up = groups.where("parent >= 0").select(F.col("of").alias("below"), "parent", "parent_length").distinct()
    now = groups.select("of", (F.col("to") - F.col("from")).alias("length"), "c", "d", "from")
    out = [now]
    for _ in range(rounds):  # each round carries occurrences one group up
        now = common.written(now.join(up, now["of"] == up["below"]).select(F.col("parent").alias("of"), F.col("parent_length").alias("length"), "c", "d", "from").distinct(), "repeat-parents")
        if now.isEmpty():
            break
        out.append(now)
    every = reduce(DataFrame.unionByName, out).distinct()
    members = found.where(F.col("kind") == repeats.MEMBER).select("c", "d", F.col("id").alias("doc_id"), "h", "at")
    doc_id = F.when(F.col("doc_id") != repeats.NO_ID, F.col("doc_id")).alias("doc_id")
    return every.join(members, ["c", "d"]).select("of", "length", doc_id, "h", (F.col("at") + F.col("from")).alias("at")).distinct()


def remove(text: bytes, stretches: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in stretches:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")

    def finish(text: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, int, str]:
        kept = remove(text, stretches)
        return len(text), len(text) - len(kept), len(stretches), hashlib.sha256(kept).hexdigest()

    return repeats.apply(docs, repeated(docs), finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
