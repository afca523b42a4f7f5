"""A training-data pipeline in five stages, each of one of the operators in ``groundline.llm``.

``run`` applies them to ``documents``; what a stage returns is written as
Parquet in the shared folder and read again as the next one's documents. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import common, decontaminate, mixing, simhash, token_output, toxicity

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None

#: One 64-bit fingerprint puts about a quarter of the pairs with a Jaccard similarity of 0.8 within 7 bits, so several are looked up.
NEAR_WORDS, NEAR_DISTANCE, NEAR_SEGMENTS, NEAR_PRINTS = 5, 7, 4, 6
NEAR_SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold.

    A null text is scored as an empty one; equal rows get equal scores and share
    their fate; a null id has no label; an empty table stays empty; columns of
    any name pass through, a ``score`` among them.
    """
    (score,) = common.fresh(docs.columns, "score")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, *model, keep=docs.columns, name=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, checked by their shingles, one document: the one with the smallest id.

    Rows are told apart by id and text, so repeated and null ids are no matter:
    a row without id stays only where its group has no other. Of rows equal in
    both one stays. Null and empty texts are equal; an empty table stays empty;
    columns of any name pass through.
    """
    groups = common.written(simhash.near_groups(docs, NEAR_SIMILARITY, NEAR_WORDS, NEAR_DISTANCE, NEAR_SEGMENTS, NEAR_PRINTS), "near-kept")
    (h,) = common.fresh(docs.columns, "h")
    marked = docs.withColumn(h, F.xxhash64(common.text_or_empty()))
    some = lambda which: marked.join(which, marked["doc_id"].cast("long").eqNullSafe(which["doc_id"]) & (marked[h] == which["h"]), "left_semi")
    repeated = groups.where("copies > 1")
    alone = some(groups.where("copies = 1")).select(*docs.columns)
    if repeated.isEmpty():
        return alone
    return alone.unionByName(some(repeated).dropDuplicates(["doc_id", h]).select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are told apart by id and text; a null text holds nothing; a null id is
    like any other; an empty table on either side drops nothing; columns of any
    name pass through.
    """
    found = decontaminate.contaminated(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id"), F.col("h").alias("leak_h")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["leak_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["leak_h"])
    return docs.join(found, same, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their first word: 0, 1 or 2 times; documents without words once.

    Rows are told apart by id and text; rows equal in both stay as often as the
    one of them that is taken most. A null source is a source of its own; an
    empty table stays empty; columns of any name pass through.
    """
    placed, pieces = mixing.mix(docs)
    begun = pieces.where("first = 0").groupBy("k", "begin").agg(F.count_distinct("epoch").alias("copies"))
    copies = placed.join(begun, ["k", "begin"], "left").select("doc_id", "h", F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0))).otherwise(1).alias("copies"))
    copies = copies.groupBy("doc_id", "h").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0")
    same = docs["doc_id"].eqNullSafe(copies["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == copies["h"])
    (copy,) = common.fresh(docs.columns, "copy")
    joined = docs.join(copies, same).select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), copies["copies"])).alias(copy))
    return joined.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of the documents, read back: a row for each document and copy.

    A null text is the end id alone; null ids come first; repeated rows are each
    written; other columns are left out; an empty table gives no row.
    """
    return token_output.read_tokens(token_output.write_tokens(docs, common.scratch(spark, "tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
