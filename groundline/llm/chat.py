"""Operator 2: chat formatting with collapse of cumulative snapshots.

A logger that saves a conversation after every turn leaves its prefixes behind.
Every turn gets a rolling hash of the turns up to it: the sum, modulo 2^64, of
a hash of (position, role, text) over them, in two independent versions. Sums
need no order among tasks, so the turns are sorted into ranges, a conversation
is summed by range, and the ranges' totals are summed after. A range holds as
many rows as any other, whatever the turns are called. A conversation
is dropped when the hash of its whole is that of a proper prefix of a longer
one (an anti-join), or when another with a smaller id is equal to it.

Only hashes are joined. Conversations that remain are gathered and rendered
with one header and one end marker a turn; marker strings in a text are broken
up so that no text can imitate a turn.

Defined results: turns are ordered by turn, role and text, nulls first;
repeated rows are turns of their own; a null role is "user", a null text is
empty; rows without conv_id are one conversation with the id null; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BEGIN, END = "<|im_start|>", "<|im_end|>"
DEFAULT_ROLE = "user"



def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), h1 and h2: the rolling hashes of each conversation's prefixes."""
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(DEFAULT_ROLE)).alias("role"), common.text_or_empty().alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number is the partition's and, in its last 33 bits, the row's: rising in the order just made
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("at"), "role", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text", F.lit(2)).alias("y"))
    rows = common.written(rows.withColumn("block", F.shiftright("at", 33)), "chat-turns")
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("at")))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & (a["block"] == b["block"])
    joined = placed.join(blocks, same(placed, blocks), "left").select(placed["conv_id"], placed["block"], (F.col("nth") + F.col("n_before")).alias("position"), "role", "x", "y")
    # 31-bit halves summed as longs: exact for 2^32 turns, and equal sums for equal prefixes
    mixed = lambda seed: F.xxhash64(F.lit(seed), "position", "role", "x", "y")
    parts = {}
    for k in (1, 2):
        parts[f"a{k}"], parts[f"b{k}"] = F.shiftright(mixed(k), 32), mixed(k).bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = joined.select("conv_id", "block", "position", *[v.alias(k) for k, v in parts.items()])
    running = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.select("conv_id", "block", "position", *[F.sum(k).over(running).alias(k) for k in parts])
    totals = hashed.groupBy("conv_id", "block").agg(*[F.sum(k).alias(k) for k in parts])
    totals = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(k).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{k}_before") for k in parts])
    full = local.join(totals, local["conv_id"].eqNullSafe(totals["c"]) & (local["block"] == totals["b"]), "left")
    sums = [F.col(k) + F.col(f"{k}_before") for k in parts]
    return full.select("conv_id", "position", F.xxhash64("position", *sums[:2]).alias("h1"), F.xxhash64("position", *sums[2:]).alias("h2"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the maximal conversations, with ``copies``: how many equal conversations each stands for."""
    hashes = common.written(turn_hashes(turns), "chat-hashes")
    n = hashes.groupBy("conv_id").agg(F.max("position").alias("n_turns")).withColumnRenamed("conv_id", "c")
    marked = hashes.join(n, hashes["conv_id"].eqNullSafe(n["c"])).drop("c")
    key = ["position", "h1", "h2"]
    whole = marked.where("position = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = marked.where("position < n_turns").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"), "copies")


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and the rendered text of the conversations in ``kept``."""
    role = F.coalesce("role", F.lit(DEFAULT_ROLE))
    rows = turns.select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), common.text_or_empty().alias("text"))
    rows = rows.join(kept, rows["c"].eqNullSafe(kept["conv_id"]))
    line = lambda t: F.concat(F.lit(BEGIN), _safe(t["role"]), F.lit("\n"), _safe(t["text"]), F.lit(END + "\n"))
    turns_of = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id", "n_turns", "copies").agg(turns_of.alias("turns")).select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", line), "").alias("text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations")
    return render(turns, collapse(turns))


SQL = {
    "op2_chat_format": f"""
with t as (select conv_id, turn, coalesce(role, '{DEFAULT_ROLE}') as role, coalesce(text, '') as text from conversations),
c as (select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, role, text) as turns, len(turns) as n from t group by conv_id),
p as (select distinct list_slice(turns, 1, k) as turns from (select turns, unnest(range(1, n)) as k from c)),
w as (select turns, min(conv_id) as conv_id, count(*) as copies from c group by turns)
select conv_id, cast(len(turns) as bigint) as n_turns, copies,
       array_to_string(list_transform(turns, lambda x: '{BEGIN}' || replace(x.role, '<|im_', '<| im_') || chr(10) || replace(x.text, '<|im_', '<| im_') || '{END}' || chr(10)), '') as text
from w where turns not in (select turns from p)"""
}
