"""Standing of people kept as decayed sums, which move to another day and merge without their edges being read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..scratch import spread
from .trust import channel, lookup

KEY = ["person_id", "kind", "topics", "country"]


def _decay(day, at) -> Column:
    return F.pow(F.lit(0.5), F.datediff(F.lit(day).cast("date"), at) / 365)


def sums(edges: DataFrame, docs: DataFrame, day: str) -> DataFrame:
    """What edges (person_id, rel, dst_kind, dst_id, at) weigh on ``day``, by what decides how much they count for a question: person_id, kind, topics, country, total, events, day.

    ``docs``: id, topics, country, doc_type. Edges to documents have the document's set of topics and its country, for a question counts an edge once however many topics it
    shares; edges to topics have that topic alone. Edges to documents that ``docs`` lacks weigh nothing.
    """
    base = lookup(config.RELATION, F.col("rel"), config.RELATION_ELSE) * _decay(day, F.col("at"))
    topics = F.sort_array(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>"))))
    d = docs.select(F.col("id").alias("dst_id"), topics.alias("topics"), "country", channel(F.col("doc_type")).alias("_c"))
    on_docs = edges.where("dst_kind = 'doc'").join(d, "dst_id").where(F.size("topics") > 0).select("person_id", F.lit("doc").alias("kind"), "topics", "country", (base * F.col("_c")).alias("w"))
    on_topics = edges.where("dst_kind = 'topic'").select("person_id", F.lit("topic").alias("kind"), F.array("dst_id").alias("topics"), F.lit(None).cast("string").alias("country"), base.alias("w"))
    rows = spread(on_docs.unionByName(on_topics), "person_id", rows=edges.count()).groupBy(*KEY).agg(F.sum("w").alias("total"), F.count("*").alias("events"))
    return rows.withColumn("day", F.lit(day).cast("date"))


def removed(state: DataFrame) -> DataFrame:
    """What takes ``state`` back when it is merged: for edges that went, or whose document has other topics now."""
    return state.withColumn("total", -F.col("total")).withColumn("events", -F.col("events"))


def merged(states: list[DataFrame], day: str) -> DataFrame:
    """Sums of several states, each of any day, as of ``day``. What has no events left is dropped. States are counted, so they should be written."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    rows = rows.withColumn("total", F.col("total") * _decay(day, F.col("day")))
    rows = spread(rows, "person_id").groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("events").alias("events"))
    return rows.where("events <> 0").withColumn("day", F.lit(day).cast("date"))


def scored(state: DataFrame, asks: DataFrame, people: DataFrame, day: str) -> DataFrame:
    """Standing for what is asked (ask_id, topics, country, and person_id where one person is meant) on ``day``: ask_id, person_id, raw, normalised, events.

    ``people``: id, seniority_years. Only people with an event on a topic that is asked about have a row. A document's edges count .3 where both countries are known and differ.
    """
    one = asks.select(*asks.columns, F.explode(F.array_distinct("topics")).alias("_topic")).withColumnsRenamed({"topics": "_asked", "country": "_country"})
    rows = state.withColumn("_topic", F.explode("topics"))
    met = spread(rows.join(one, ["_topic", "person_id"] if "person_id" in asks.columns else "_topic"), "person_id", rows=state.count()).dropDuplicates(["ask_id", *KEY])
    far = (F.col("kind") == "doc") & F.col("_country").isNotNull() & F.col("country").isNotNull() & (F.col("_country") != F.col("country"))
    w = F.col("total") * _decay(day, F.col("day")) * F.when(far, 0.3).otherwise(1.0)
    sums_ = met.groupBy("ask_id", "person_id").agg(F.sum(w).alias("s"), F.sum("events").alias("events"))
    known = sums_.join(people.select(F.col("id").alias("person_id"), "seniority_years"), "person_id")
    raw = F.col("s") * (1 + F.least(F.coalesce("seniority_years", F.lit(0)), F.lit(10)) * 0.015)
    return known.select("ask_id", "person_id", raw.alias("raw"), (1 - F.exp(-raw / 2.5)).alias("normalised"), "events")
