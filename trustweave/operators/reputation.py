"""Reputation of people from typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..scratch import spread
from .trust import channel, lookup


def weigh(edges: DataFrame, docs: DataFrame, as_of: str) -> DataFrame:
    """Weights of edges (person_id, rel, dst_kind, dst_id, at, topics, country: what is asked).

    Document edges need a shared topic and count by channel, and .3 where the countries differ; topic edges need the topic.
    """
    decay = F.pow(F.lit(0.5), F.datediff(F.lit(as_of).cast("date"), F.col("at")) / 365)
    base = lookup(config.RELATION, F.col("rel"), config.RELATION_ELSE) * decay
    d = docs.select(F.col("id").alias("dst_id"), F.col("topics").alias("doc_topics"), F.col("country").alias("doc_country"), "doc_type")
    on_docs = edges.where("dst_kind = 'doc'").join(d, "dst_id").where(F.arrays_overlap("topics", "doc_topics"))
    same = F.col("country").isNull() | F.col("doc_country").isNull() | (F.col("country") == F.col("doc_country"))
    on_docs = on_docs.select("person_id", "rel", "dst_id", (base * F.when(same, 1.0).otherwise(0.3) * channel(F.col("doc_type"))).alias("w"))
    on_topics = edges.where("dst_kind = 'topic'").where(F.array_contains("topics", F.col("dst_id"))).select("person_id", "rel", "dst_id", base.alias("w"))
    return on_docs.unionByName(on_topics)


def reputation(weights: DataFrame, people: DataFrame) -> DataFrame:
    """Score of each person (id, seniority_years, ...): person columns, raw, normalised, events, reasons (top 8)."""
    what = weights.select("person_id", "w", F.concat_ws(" ", "rel", "dst_id").alias("what"))
    best = what.withColumn("_r", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("w"), F.desc("what")))).where("_r <= 8")  # eight a task and person are shuffled
    best = best.groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("w", "what")), asc=False).alias("reasons"))
    sums = weights.groupBy("person_id").agg(F.sum("w").alias("s"), F.count("*").alias("events")).join(best, "person_id")
    raw = F.col("s") * (1 + F.least(F.col("seniority_years"), F.lit(10)) * 0.015)
    joined = people.join(sums, people.id == sums.person_id, "left").drop("person_id")
    joined = joined.withColumn("raw", F.coalesce(raw, F.lit(0.0))).withColumn("events", F.coalesce("events", F.lit(0)))
    return joined.withColumn("normalised", 1 - F.exp(-F.col("raw") / 2.5)).drop("s")


def experts(scored: DataFrame, limit: int = 4) -> DataFrame:
    """Active people with events, no shared mailboxes, best first."""
    shared = F.lower("role").contains("team") & (F.col("seniority_years") == 0)
    found = scored.where(F.col("active") & ~shared & (F.col("events") > 0)).withColumn("score", F.round(100 * F.col("normalised")).cast("int"))
    return found.orderBy(F.desc("score"), "id").limit(limit)


def provenance(links: DataFrame, people: DataFrame) -> DataFrame:
    """Who stands behind a document: its person links (doc_id, person_id, rel, at) by person, newest last."""
    acts = F.transform(F.sort_array(F.collect_list(F.struct("at", "rel"))), lambda x: F.concat_ws(" ", x["rel"], x["at"].cast("string")))
    known = people.select(F.col("id").alias("person_id"), "name", "active")
    return links.groupBy("doc_id", "person_id").agg(acts.alias("acts")).join(known, "person_id")


def merge_experts(sections: DataFrame, limit: int = 4) -> DataFrame:
    """Experts of a question over its sections (question_id, person_id, score, in_country): best score of each, the first four."""
    best = sections.groupBy("question_id", "person_id").agg(F.max_by("in_country", "score").alias("in_country"), F.max("score").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "person_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def prefer_local(found: DataFrame) -> DataFrame:
    """Experts in the country that is asked about, or all of a question where none is; unknown counts as in the country."""
    here = F.coalesce(F.col("in_country"), F.lit(True))
    any_ = F.max(here).over(Window.partitionBy("question_id"))
    return found.withColumn("_any", any_).where(here | ~F.col("_any")).drop("_any")


def answer_graph(cited: DataFrame, edges: DataFrame, docs: DataFrame, asked: DataFrame, people: DataFrame, experts_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of an answer: its documents with their roles, and all links between people, documents and topics.

    ``cited``: question_id, doc_id, role; ``edges``: person_id, rel, dst_kind, dst_id, at; ``docs``: id, topics; ``asked``: question_id, topic;
    ``people``: id; ``experts_``: question_id, person_id. People are linked to cited documents; experts to the topics that are asked about; documents
    to those topics. Returns (question_id, doc_id, roles) and distinct (question_id, src, rel, dst).
    """
    n = cited.count()
    nodes = spread(cited, "question_id", rows=n).groupBy("question_id", "doc_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    named = edges.join(people.select(F.col("id").alias("person_id")).distinct(), "person_id", "left_semi")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    by_doc = named.where("dst_kind = 'doc'").join(spread(nodes.select("question_id", F.col("doc_id").alias("dst_id")), "dst_id", rows=n), "dst_id")
    by_topic = named.where("dst_kind = 'topic'").join(asked.select("question_id", F.col("topic").alias("dst_id")), "dst_id").join(experts_.select("question_id", "person_id").distinct(), ["question_id", "person_id"], "left_semi")
    about = spread(nodes, "doc_id", rows=n).join(docs.select(F.col("id").alias("doc_id"), F.explode("topics").alias("topic")), "doc_id").join(asked, ["question_id", "topic"], "left_semi")
    links = by_doc.select("question_id", node("person", "person_id").alias("src"), "rel", node("doc", "dst_id").alias("dst"))
    links = links.unionByName(by_topic.select("question_id", node("person", "person_id").alias("src"), "rel", node("topic", "dst_id").alias("dst")))
    links = links.unionByName(about.select("question_id", node("doc", "doc_id").alias("src"), F.lit("about").alias("rel"), node("topic", "topic").alias("dst")))
    # people, documents and topics of a citation make some three links
    return nodes, spread(links, "question_id", rows=3 * n).distinct()
