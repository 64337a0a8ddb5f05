"""Ingest as a stream: micro-batches of units, each applied to the current documents once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search_index
from ..operators.ingest import classify
from ..scratch import remove

#: After so many micro-batches their changes are merged into a new base, so a batch reads one base and fewer deltas than this.
COMPACT = 50


def current(spark: SparkSession, folder: str, batches: int, schema, base: int | None = None) -> DataFrame:
    """The documents after the first ``batches`` micro-batches: the last base and, for each id, its latest change since."""
    base = batches - batches % COMPACT if base is None else base
    paths = [f"{folder}/delta/{n}" for n in range(base, batches)]
    rows = spark.read.schema(schema).parquet(*paths) if paths else None
    if base:
        old = spark.read.schema(schema).parquet(f"{folder}/base/{base}")
        rows = old if rows is None else old.unionByName(rows)
    if rows is None:
        return spark.createDataFrame([], schema)
    return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*") if paths else rows


def start(units: DataFrame, folder: str, checkpoint: str, order: str = "seq", index: str | None = None, text: str = "body"):
    """Apply a stream of (id, content_hash, ...) to the documents under ``folder``; ``order`` says which of an id's units is the newest.

    Batch n writes the rows that it changes under ``delta/n`` and nothing else (every ``COMPACT`` batches also a base, and deletes what the base before replaced), reads only what
    earlier batches wrote, and overwrites its own output when it is repeated after a failure, so its result is the same. Of units with one
    id and order the larger content hash counts. Runs over what is there and ends. With ``index`` the search index under that folder follows: batch n is its
    batch n, with the passages of ``text``.
    """
    kept = T.StructType([*units.schema.fields, T.StructField("status", T.StringType()), T.StructField("batch", T.LongType())])

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct(order, "content_hash")).alias("r")).select("r.*")
        changed = classify(newest, current(spark, folder, n, kept)).where("change <> 'unchanged'").drop("change").withColumn("batch", F.lit(n).cast("long"))
        changed.select(*kept.names).write.mode("overwrite").parquet(f"{folder}/delta/{n}")
        if index:
            written = spark.read.schema(kept).parquet(f"{folder}/delta/{n}")
            search_index.follow(spark, index, n, written.withColumn("change", F.lit("changed")), text=text)
        if (n + 1) % COMPACT == 0:
            base = n + 1 - COMPACT
            current(spark, folder, n + 1, kept, base).write.mode("overwrite").parquet(f"{folder}/base/{n + 1}")
            if base:  # what the base before this one replaced; the newest batch can still be repeated
                remove(spark, [f"{folder}/base/{base - COMPACT}", *(f"{folder}/delta/{k}" for k in range(base - COMPACT, base))])

    return units.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
