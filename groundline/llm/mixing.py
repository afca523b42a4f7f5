"""Operator 9: mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order, which lays their words out
as one stream, twice over, cut into blocks of ``block_words``. Slot i of the
schedule takes the golden-ratio point frac(i * phi) through the cumulative
weights of the targets to a source; a slot's rank among its source's slots is
the block it takes. So every stretch of the schedule holds the sources near
their weights, a rerun gives the same mix, and slots beyond a source's last
block are skipped; blocks that the points leave short come at the end.

Running sums are taken in buckets (of the hashed order, and of the slots) whose
totals are summed after, so no task orders a whole source. The targets of all
sources follow from one level, found on the driver from one row a source.

Defined results: a null source is a source of its own and the last one; a null
text has size 0; rows that repeat an id are documents of their own; a source
without words has target 0; other columns are ignored; an empty table gives no
row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
TOTAL, CAP = 1.5, 2
BLOCK_WORDS = 1024
SEED = "mix-1"
GOLDEN = 0.6180339887498949
SLOTS_A_TASK = 1 << 16


def targets(sizes: list[int], weights: list[float], total: float = TOTAL, cap: float = CAP) -> list[float]:
    """Shares of ``total`` times all sizes by weight; what exceeds ``cap`` times a size is shared anew.

    That ends where every target is the least of its cap and one level times
    its weight; the level is found along the order of cap over weight.
    """
    left, weight = total * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: (cap * sizes[k] / weights[k], k))
    for n, k in enumerate(order):
        if cap * sizes[k] * weight > left * weights[k]:
            for j in order[n:]:
                out[j] = left / weight * weights[j]
            break
        out[k] = float(cap * sizes[k])
        left, weight = left - out[k], weight - weights[k]
    return out


def _order(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def streams(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, h (a hash of the text), source, size and ``begin``: the document's place in its source's stream of words."""
    rows = docs.select("doc_id", F.xxhash64(common.text_or_empty()).alias("h"), F.col("source").cast("string").alias("source"), common.word_count(F.col("text")).alias("size"), _order("doc_id", seed).alias("o"))
    rows = common.written(rows.withColumn("bucket", F.substring("o", 1, 3)), "mix-sizes")
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("o", "doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = local.join(totals, local["source"].eqNullSafe(totals["s"]) & (local["bucket"] == totals["b"]))
    return full.select("doc_id", "h", "source", "size", (F.col("before") + F.col("local")).alias("begin"))


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> list[tuple]:
    """(source, source_size, target) in code-point order, null last: one row a source, on the driver."""
    rows = [tuple(r) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    rows.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    found = targets([r[1] for r in rows], [weights[k % len(weights)] for k in range(len(rows))], total, cap)
    return [(*r, t) for r, t in zip(rows, found)]


def schedule(spark: SparkSession, plan: list[tuple], block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, k (the source's place in ``plan``) and block: which block of which source each slot takes."""
    needed = np.array([math.ceil(math.floor(t) / block_words) for _, _, t in plan], dtype=np.int64)
    slots = int(needed.sum())
    bounds = np.cumsum([t for _, _, t in plan])
    bounds = bounds / bounds[-1] if len(plan) and bounds[-1] > 0 else np.ones(len(plan))
    chunks = max(1, -(-slots // SLOTS_A_TASK))

    def points(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(chunk * SLOTS_A_TASK, min(slots, (chunk + 1) * SLOTS_A_TASK), dtype=np.int64)
        x = i * GOLDEN
        return i, np.minimum(np.searchsorted(bounds, x - np.floor(x), side="right"), len(bounds) - 1)

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("id").to_pylist():
                k, n = np.unique(points(chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), chunk)), pa.array(k), pa.array(n)], ["chunk", "k", "n"])

    ranged = spark.range(0, chunks, 1, min(chunks, 1000))
    per = ranged.transform(common.in_arrow, counts, "chunk long, k long, n long")
    before = per.select("chunk", "k", F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = before.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("k", "before"))).alias("before"))

    def ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i, k = points(chunk)
                starts = dict(starts)
                block = np.empty(len(i), dtype=np.int64)
                for s, start in starts.items():
                    mine = k == s
                    block[mine] = start + np.arange(mine.sum())
                used = block < needed[k]
                yield pa.RecordBatch.from_arrays([pa.array(i[used]), pa.array(k[used].astype(np.int64)), pa.array(block[used])], ["slot", "k", "block"])

    points_taken = before.transform(common.in_arrow, ranked, "slot long, k long, block long")
    # sources that the points leave short: their last blocks, after all others
    got = per.groupBy("k").agg(F.sum("n").alias("n"))
    want = spark.createDataFrame([(k, int(n)) for k, n in enumerate(needed)], "k long, need long")
    short = want.join(got, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), "need").where("n < need")
    tail = short.select("k", F.explode(F.sequence("n", F.col("need") - 1)).alias("block"))
    tail = tail.select((F.lit(slots) + F.col("block") * len(plan) + F.col("k")).alias("slot"), "k", "block")
    return points_taken.unionByName(tail)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP, block_words: int = BLOCK_WORDS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with their places and plan, and the mix itself.

    First frame: doc_id, h, size, source, source_size, target, begin. Second: a
    row for each stretch of a document in a block, (slot, k, begin, epoch,
    first, words) with ``first`` counted in words from the document's start.
    """
    spark = docs.sparkSession
    sized = common.written(streams(docs, seed), "mix-streams")
    plan = source_targets(sized, weights, total, cap)
    planned = spark.createDataFrame([(k, *p) for k, p in enumerate(plan)], "k long, s string, source_size long, target double")
    placed = sized.join(planned, sized["source"].eqNullSafe(planned["s"])).drop("s")
    epochs = placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(cap) - 1))).alias("epoch"))
    epochs = epochs.withColumn("from", F.col("begin") + F.col("epoch") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.floor("target")))
    pieces = epochs.where("from < to").select("k", "begin", "epoch", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block_words), F.floor((F.col("to") - 1) / block_words))).alias("block"))
    slots = schedule(spark, plan, block_words)
    low, high = F.greatest("from", F.col("block") * block_words), F.least("to", (F.col("block") + 1) * block_words)
    joined = pieces.join(slots, ["k", "block"]).select("slot", "k", "begin", "epoch", (low - F.col("from")).alias("first"), (high - low).alias("words"))
    return placed, joined


def taken(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with the words that the mix takes of each document, and the first slot of the schedule that holds some of it (null: none)."""
    sums = pieces.groupBy("k", "begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    full = placed.join(sums, ["k", "begin"], "left")
    some = F.col("size") > 0  # a document without words stands where the next one begins
    return full.select("doc_id", "size", "source", "source_size", "target", F.when(some, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long").alias("taken"), F.when(some, F.col("first_slot")).alias("first_slot"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(*mix(common.table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


SQL = {
    "op9_mixing": f"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
                  md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as o from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight,
             row_number() over (order by source nulls last) as n from s),
r as (select *, {TOTAL} * sum(source_size) over () - coalesce(sum({CAP} * source_size) over before, 0) as lefts,
             cast(sum(weight) over () - coalesce(sum(weight) over before, 0) as double) as weights
      from w window before as (order by {CAP} * source_size / cast(weight as double), n rows between unbounded preceding and 1 preceding)),
f as (select *, {CAP} * source_size * weights > lefts * weight as free from r),
l as (select lefts / weights as level from f where free order by {CAP} * source_size / cast(weight as double), n limit 1),
t as (select source, source_size, case when free then (select level from l) * weight else cast({CAP} * source_size as double) end as target from f),
p as (select d.doc_id, d.source, d.size, coalesce(sum(d.size) over (partition by d.source order by d.o, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as b from d),
g as (select t.*, row_number() over (order by source nulls last) - 1 as k, cast(ceil(floor(target) / {BLOCK_WORDS}) as bigint) as needed from t),
e as (select k, needed, coalesce(sum(target) over (order by k rows between unbounded preceding and 1 preceding), 0) / sum(target) over () as low,
             case when k = max(k) over () then 2 else sum(target) over (order by k rows between unbounded preceding and current row) / sum(target) over () end as high from g),
i as (select slot, slot * '{GOLDEN}'::double - floor(slot * '{GOLDEN}'::double) as x from (select unnest(range((select cast(sum(needed) as bigint) from g))) as slot)),
b as (select i.slot, e.k, e.needed, row_number() over (partition by e.k order by i.slot) - 1 as block from i join e on i.x >= e.low and i.x < e.high),
n as (select e.k, e.needed, (select count(*) from b where b.k = e.k) as got from e),
z as (select slot, k, block from b where block < needed
      union all select (select sum(needed) from g) + block * (select count(*) from g) + k, k, block from (select k, unnest(range(got, needed)) as block from n)),
q as (select p.doc_id, p.size, g.k, g.source_size, g.target, p.b,
             cast(greatest(0, least(p.size, floor(g.target) - p.b)) + greatest(0, least(p.size, floor(g.target) - g.source_size - p.b)) as bigint) as taken
      from p join g on p.source is not distinct from g.source),
w2 as (select q.*, unnest(range(0, {CAP})) as epoch, row_number() over () as row_id from q),
w3 as (select row_id, doc_id, size, k, source_size, target, taken, b + epoch * source_size as f, least(b + epoch * source_size + size, floor(target)) as u from w2),
w4 as (select row_id, k, unnest(range(cast(floor(f / {BLOCK_WORDS}) as bigint), cast(floor((u - 1) / {BLOCK_WORDS}) as bigint) + 1)) as block from w3 where f < u),
w5 as (select row_id, min(slot) as first_slot from w4 join z on z.k = w4.k and z.block = w4.block group by row_id)
select doc_id, size, source_size, target, taken, cast(min(first_slot) as bigint) as first_slot
from w3 left join w5 using (row_id) group by all"""
}
