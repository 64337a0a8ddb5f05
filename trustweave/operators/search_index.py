"""Positional postings kept beside the documents: each batch of an ingest writes what it changed, and now and then all is merged.

Under a folder, ``postings/n`` holds the postings of the passages that batch n wrote, by buckets of stems; ``passages/n`` says which passages it
wrote (live) or removed. ``postings/base-n`` and ``passages/base-n`` hold all that is left of the batches before n. A batch reads nothing but what earlier ones wrote and
overwrites its own folders when it is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fulltext
from ..scratch import remove
from . import search

#: Buckets that stems are dealt to, and batches between two merges.
BUCKETS, MERGE = 64, 20
#: Up to so many passages that later batches replaced are sent to the tasks that read postings (some 50 bytes each); with more, postings are shuffled.
SENT = 2_000_000

POSTINGS, PASSAGES = "stem string, passage_id {0}, positions array<int>, batch long", "passage_id {0}, live boolean, batch long"


def _bucket():
    return F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)).cast("int")


def update(spark: SparkSession, folder: str, n: int, changed: DataFrame, gone: DataFrame | None = None, stem: search.Stem = fulltext.english, merge: int = MERGE) -> None:
    """Batch ``n`` (0, 1, ...): passages written anew (passage_id, text) and passages removed (passage_id). Null and empty texts have no postings.

    A passage that is in both counts as written. Every ``merge`` batches what is left becomes a new base, and what the last base but one replaced is deleted; so much is kept
    that the newest batch can be repeated.
    """
    rows = changed.select("passage_id", "text")
    marks = rows.select("passage_id", F.lit(True).alias("live"))
    if gone is not None:
        marks = marks.unionByName(gone.select("passage_id", F.lit(False).alias("live")))
    marks = marks.groupBy("passage_id").agg(F.max("live").alias("live"))
    made = search.postings(rows, stem).withColumn("batch", F.lit(n).cast("long")).withColumn("bucket", _bucket())
    # a bucket's postings lie together, in as many files as their size asks for
    _write(made.hint("rebalance", F.col("bucket")), f"{folder}/postings/{n}")
    marks.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/passages/{n}")
    if (n + 1) % merge == 0:
        kind = rows.schema["passage_id"].dataType.simpleString()
        base = n + 1 - merge
        # files hold one bucket each, so what is left of them is written where it was read; only where postings had to be shuffled their buckets are brought together again
        left, last = _left(spark, folder, n + 1, kind, merge, base).withColumn("batch", F.lit(n).cast("long")), passages(spark, folder, n + 1, kind, merge, base)
        _write(left, f"{folder}/postings/base-{n + 1}")
        last.withColumn("live", F.lit(True)).withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/passages/base-{n + 1}")
        old = [f"base-{base - merge}", *map(str, range(base - merge, base))] if base else []
        remove(spark, [f"{folder}/{table}/{part}" for table in ("postings", "passages") for part in old])


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)


def _parts(batches: int, merge: int, base: int | None) -> tuple[list[str], int]:
    base = batches - batches % merge if base is None else base
    return ([f"base-{base}"] if base else []) + [str(k) for k in range(base, batches)], base


def passages(spark: SparkSession, folder: str, batches: int, kind: str = "bigint", merge: int = MERGE, base: int | None = None) -> DataFrame:
    """Passages (passage_id) that live after the first ``batches`` batches; ``kind`` is the type of the ids."""
    parts, _ = _parts(batches, merge, base)
    if not parts:
        return spark.createDataFrame([], f"passage_id {kind}")
    marks = spark.read.schema(PASSAGES.format(kind)).parquet(*[f"{folder}/passages/{p}" for p in parts])
    return marks.groupBy("passage_id").agg(F.max_by("live", "batch").alias("live")).where("live").select("passage_id")


def postings(spark: SparkSession, folder: str, batches: int, kind: str = "bigint", merge: int = MERGE, base: int | None = None, stems: DataFrame | None = None) -> DataFrame:
    """Postings (stem, passage_id, positions) after the first ``batches`` batches; with ``stems`` (stem) only theirs, read from their buckets alone.

    A posting counts unless a later batch wrote or removed its passage.
    """
    rows = _left(spark, folder, batches, kind, merge, base, stems)
    return spark.createDataFrame([], POSTINGS.format(kind)).drop("batch") if rows is None else rows.select("stem", "passage_id", "positions")


def _left(spark: SparkSession, folder: str, batches: int, kind: str, merge: int, base: int | None, stems: DataFrame | None = None) -> DataFrame | None:
    parts, base = _parts(batches, merge, base)
    if not parts:
        return None
    schema = POSTINGS.format(kind) + ", bucket int"
    read = lambda p: spark.read.schema(schema).parquet(f"{folder}/postings/{p}")
    if stems is not None:
        stems = stems.select("stem").distinct()
        own = [r.b for r in stems.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
        whole = read
        read = lambda p: whole(p).where(F.col("bucket").isin(own)).join(stems, "stem", "left_semi")
    rows = read(parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(read(p))
    if len(parts) > 1:
        # only what an earlier part holds can be replaced, so batches that add passages ask for nothing
        marks = spark.read.schema(PASSAGES.format(kind)).parquet(*[f"{folder}/passages/{p}" for p in parts])
        held = marks.groupBy("passage_id").agg(F.max("batch").alias("last"), F.min(F.when(F.col("live"), F.col("batch"))).alias("first"))
        last = held.where("first < last").select(F.col("passage_id").alias("_id"), "last")
        n = last.count()
        if n:
            rows = rows.join(F.broadcast(last) if n <= SENT else last, (F.col("passage_id") == F.col("_id")) & (F.col("batch") < F.col("last")), "left_anti")
            rows = rows if n <= SENT else rows.hint("rebalance", F.col("bucket"))
    return rows


def searched(spark: SparkSession, folder: str, batches: int, searches: DataFrame, kind: str = "bigint", stem: search.Stem = fulltext.english, merge: int = MERGE) -> DataFrame:
    """``search.ranked`` over the kept postings, of which only the buckets of the searches' stems are read."""
    asked = search.terms(searches, stem)
    index = postings(spark, folder, batches, kind, merge, stems=asked)
    return search.ranked(searches, index, passages(spark, folder, batches, kind, merge), stem)


def follow(spark: SparkSession, folder: str, n: int, classified: DataFrame, gone: DataFrame | None = None, text: str = "body") -> None:
    """Take an ingest's batch into the index: ``classified`` as from ``ingest.classify`` (id, change, status and ``text``), ``gone`` as from ``ingest.tombstones`` (id).

    Rows that are unchanged are left alone; what is not active or due for an update any more is removed.
    """
    rows = classified.where("change <> 'unchanged'").select(F.col("id").alias("passage_id"), F.col(text).alias("text"), F.col("status").isin("active", "needs_update").alias("live"))
    removed = rows.where("NOT live").select("passage_id")
    if gone is not None:
        removed = removed.unionByName(gone.select(F.col("id").alias("passage_id")))
    update(spark, folder, n, rows.where("live"), removed)
