"""Operator 6 [native]: exact deduplication by progressive refinement.

Rows are grouped by the byte length of their text, the groups that survive
(two rows or more) by a hash of a prefix too, and the groups that survive that
by the SHA-256 of the whole normalised text. Only light rows (an id and hashes)
are shuffled and joined, never texts, except in ``deduplicate`` for the
surviving groups. All aggregates combine on the map side, and the joins back
to the rows are plain sort-merge joins that Spark can split at a hot key.

Normalisation lower-cases A-Z only, which keeps the byte length. Defined
results: a null text is empty; of equal texts the largest id stays and a null
id counts as smaller than any other; rows that repeat an id and its text share
its fate; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PREFIX_CHARS = 256


def _digest(text: Column) -> Column:
    return F.sha2(common.ascii_lower(text).cast("binary"), 256)


def survivors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` occur twice or more."""
    groups = rows.groupBy(*keys).count().where("count > 1").drop("count")
    return rows.join(groups, keys, "left_semi")


def exact_groups(docs: DataFrame, digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of ``docs`` (doc_id, text).

    ``digest_all`` asks for the digest of every text, so that the only scan of
    the texts computes it; otherwise it is computed for the rows that survive
    both earlier steps and is null for the others.
    """
    text = common.text_or_empty()
    light = docs.select(
        "doc_id",
        F.octet_length(text).alias("n"),
        F.xxhash64(common.ascii_lower(F.substring(text, 1, prefix_chars))).alias("p"),
        *([_digest(text).alias("text_sha256")] if digest_all else []),
    )
    light = common.written(light, "exact-light")
    alike = survivors(survivors(light, ["n"]), ["n", "p"])
    if not digest_all:
        pairs, ids = alike.select("n", "p").distinct(), alike.select(F.col("doc_id").alias("id")).distinct()
        full = docs.select("doc_id", text.alias("text"))
        full = full.join(ids, full["doc_id"].eqNullSafe(ids["id"]), "left_semi")
        full = full.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64(common.ascii_lower(F.substring("text", 1, prefix_chars))).alias("p"), _digest(F.col("text")).alias("text_sha256"))
        alike = full.join(pairs, ["n", "p"], "left_semi")
        light = light.join(pairs, ["n", "p"], "left_anti").withColumn("text_sha256", F.lit(None).cast("string")).unionByName(alike)
    groups = alike.groupBy("text_sha256").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("size > 1")
    out = light.join(groups, "text_sha256", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: one with the largest id, any of those that repeat it.

    Rows are told apart by what they hold, never by id alone, so ids may repeat.
    Texts whose length and prefix are their own are neither read whole nor moved.
    """
    n, p, d, last = common.fresh(docs.columns, "n", "p", "digest", "last")
    text = common.text_or_empty()
    marked = docs.withColumns({n: F.octet_length(text), p: F.xxhash64(common.ascii_lower(F.substring(text, 1, PREFIX_CHARS)))})
    alike = common.written(survivors(survivors(marked.select(n, p), [n]), [n, p]).distinct(), "exact-alike")
    several = marked.join(alike, [n, p], "left_semi").withColumn(d, _digest(text))
    groups = several.groupBy(d).agg(F.max("doc_id").alias(last))
    kept = several.join(groups, d).where(F.col("doc_id").eqNullSafe(F.col(last))).dropDuplicates([d])
    return marked.join(alike, [n, p], "left_anti").select(*docs.columns).unionByName(kept.select(*docs.columns))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"), digest_all=True)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op6_exact_dedup": f"""
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256({_LOWER}) as text_sha256
from documents window w as (partition by {_LOWER})"""
}
