"""Corpus cleaning in five stages: quality, lines, near duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and the columns of ``documents``; its result is written as Parquet in
the shared folder and read again as the next one's docs, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.llm import decontaminate, line_dedup, near_dedup, quality_trees, sentencepieces
from trustweave.scratch import cut
from trustweave.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    Null and empty texts are scored like others. Rows are told by doc_id (null is one id): of repeated ids all rows stay if any passes, since
    the verdict is on the document. Without labels all scores are alike; an empty table gives an empty one.
    """
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    good = quality_trees.score_quality(docs, labels).where("predicted = 1").select("doc_id")
    return docs.join(good.distinct(), docs.doc_id.eqNullSafe(good.doc_id), "left_semi").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the boilerplate lines of each source; a document left without a word goes.

    So do null, empty and blank texts. A null source is a source of its own, repeated rows count as pages each, null and repeated ids
    have no part in it; an empty table gives an empty one.
    """
    out = line_dedup.drop_boilerplate_lines(docs).withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("cleaned").cast("long"))
    return out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that of the smallest doc_id, a null one only where there is no other.

    Repeated rows (one doc_id and text) are of one group, so one of them stays; of an id with different texts each is judged by its own.
    Texts without a word are linked with nothing and all stay; an empty table gives an empty one.
    """
    ship(spark)
    found = cut(near_dedup.near_duplicates(docs).select("doc_id", "text_id", "group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    first = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("_doc"), F.col("o.text_id").alias("_text"))
    bare = found.where(F.col("group").isNull()).select(F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text")).distinct()
    rows = docs.withColumn("_id", F.xxhash64(F.col("text").cast("string")))
    stay = first.unionByName(bare)
    kept = rows.join(stay, (F.col("_id") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    again = found.where(F.col("group").isNotNull()).groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        said = F.col("text").rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(said).dropDuplicates(["doc_id", "_id"]).unionByName(kept.where(~F.coalesce(said, F.lit(False))))
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none. Rows are told by a hash of their text, so null and repeated ids don't matter; an empty table gives an
    empty one, an empty benchmark changes nothing.
    """
    items = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("_id", F.xxhash64(F.col("text").cast("string")))
    held = decontaminate.contaminated(rows.select(F.col("_id").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(held, "_id", "left_anti").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of what is left: one row for each document and sample.

    Null and empty texts have the empty segmentation; repeated rows are encoded each, alike for one doc_id; an empty table gives no rows.
    """
    ship(spark)
    return sentencepieces.encode_sampled(docs, digests=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: No SQL: boosted trees, SuperMinHash groups and sampled segmentations are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs
