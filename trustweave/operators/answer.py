"""Answers from judged candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..scratch import spread
from .trust import confidence


def status(parts: DataFrame) -> DataFrame:
    """Status and confidence of sub-questions from what was found for them.

    Needs strong (count; none where a disclaimer is about as relevant), disclaimed, conflicts (count), informal, related
    (count), confidence, trust. A disclaimer stands in the way of related passages and leaves the part missing.
    """
    some = F.col("strong") > 0
    s = (
        F.when(some & (F.col("conflicts") > 0), "contested")
        .when(some & F.col("informal"), "informal")
        .when(some, "answered")
        .when((F.col("related") > 0) & ~F.col("disclaimed"), "partial")
        .otherwise("missing")
    )
    c = F.col("confidence")
    value = F.when(s == "contested", c - 0.15).when(s == "informal", c - 0.10).when(s == "partial", 0.3 * F.col("trust")).when(s == "missing", 0.0).otherwise(c)
    return parts.withColumn("status", s).withColumn("confidence", F.greatest(F.lit(0.0), value))


def verdict(parts: DataFrame) -> DataFrame:
    """Overall confidence and verdict of each question from (question_id, status, confidence)."""
    is_ = lambda *names: F.col("status").isin(*names)
    agg = parts.groupBy("question_id").agg(
        F.round(F.avg("confidence"), 2).alias("confidence"),
        F.count("*").alias("n_parts"),
        F.bool_and(is_("answered")).alias("all_answered"),
        F.bool_or(is_("answered", "contested", "informal")).alias("any_found"),
        F.bool_or(is_("missing", "partial")).alias("gaps"),
        F.bool_or(is_("contested")).alias("any_contested"),
        F.bool_or(is_("informal")).alias("any_informal"),
        F.bool_and(is_("missing")).alias("none"),
    )
    # The verdicts, in order of precedence.
    v = (
        F.when(F.col("all_answered"), "Grounded answer")
        .when(F.col("any_found") & F.col("gaps"), "Partial answer, gap highlighted")
        .when(F.col("any_contested"), "Grounded answer, conflict flagged")
        .when(F.col("any_informal"), "Answer from informal sources")
        .when(F.col("none"), "No grounded answer found")
        .otherwise("Low confidence answer")
    )
    return agg.select("question_id", "confidence", "n_parts", v.alias("verdict"))


def segments(found: DataFrame) -> DataFrame:
    """Extra segments of answers: the next three strong passages of a part, one for each document that isn't the primary's.

    Needs sub_id, chunk_id, doc_id, score, is_primary, supports (chunk_id or null), updated_at, doc_type. Adds rank and kind:
    earlier (an older informal text in support), confirms, or supporting.
    """
    order = Window.partitionBy("sub_id").orderBy(F.desc("score"), "chunk_id")
    first = found.where("is_primary").select("sub_id", F.col("chunk_id").alias("_chunk"), F.col("doc_id").alias("_doc"), F.col("updated_at").alias("_at"))
    extra = found.where("NOT is_primary").withColumn("rank", F.row_number().over(order)).where("rank <= 3").join(first, "sub_id").where("doc_id <> _doc")
    extra = once(extra, ["sub_id", "doc_id"], ["rank"])
    older = (F.col("updated_at") < F.col("_at")) & F.col("doc_type").isin(*config.INFORMAL)
    kind = F.when(F.col("supports") == F.col("_chunk"), F.when(older, "earlier").otherwise("confirms")).otherwise("supporting")
    return extra.withColumn("kind", kind).drop("_chunk", "_doc", "_at")


def once(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each ``by``; review lists name a document once a question."""
    return rows.withColumn("_once", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_once = 1").drop("_once")


def stale(found: DataFrame) -> DataFrame:
    """Documents past their review among the first three strong passages (question_id, sub_id, chunk_id, doc_id, score, stale) of any part."""
    order = Window.partitionBy("question_id", "sub_id").orderBy(F.desc("score"), "chunk_id")
    top = found.withColumn("rank", F.row_number().over(order)).where("rank <= 3 AND stale")
    return once(top, ["question_id", "doc_id"], ["sub_id", "rank"])


def undocumented(parts: DataFrame) -> DataFrame:
    """Parts that only informal sources answer, for the list of what should be written down."""
    return parts.where("status = 'informal'")


def version_notes(parts: DataFrame, outdated: DataFrame) -> DataFrame:
    """Notes for parts (sub_id, question) that ask about versions and have outdated ones (sub_id, doc_id, title, updated_at, relevance)."""
    item = F.struct((-F.col("relevance")).alias("r"), "doc_id", F.concat("title", F.lit(" ("), F.year("updated_at"), F.lit(")")).alias("said"))
    old = outdated.groupBy("sub_id").agg(F.sort_array(F.collect_list(item)).alias("o"))
    asks = parts.where(F.col("question").rlike(r"(?i)\bversions?\b")).join(old, "sub_id")
    # Fixed value: the sentence of the note.
    said = F.concat(
        F.lit("Yes: "), F.size("o"), F.lit(" older version(s) still exist and are excluded from answers: "), F.array_join(F.transform("o", lambda x: x["said"]), ", "), F.lit(".")
    )
    return asks.select("sub_id", said.alias("note"))


def strong(candidates: DataFrame) -> DataFrame:
    """Candidates that can answer: on topic, stating something, relevant and trusted."""
    return candidates.where(F.col("on_topic") & F.col("asserts") & (F.col("relevance") >= config.ANSWERS) & (F.col("trust") >= config.TRUSTED))


def cite(rows: DataFrame, by: str, order: list[str], doc: str, prefix: str = "E") -> DataFrame:
    """Numbers of cited documents in order of their first citation."""
    w = Window.partitionBy(by).orderBy(*order)
    firsts = spread(rows, by).withColumn("_at", F.row_number().over(w)).withColumn("_first", F.min("_at").over(Window.partitionBy(by, doc)))
    number = F.dense_rank().over(Window.partitionBy(by).orderBy("_first"))
    return firsts.withColumn("cite_id", F.concat(F.lit(prefix), number.cast("string"))).drop("_at", "_first")


def render(sections: DataFrame) -> DataFrame:
    """Plain text of answers from (question_id, pos, text)."""
    return sections.groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("answer"))


def primary(strong_: DataFrame) -> DataFrame:
    """The passage that leads each part: among formal, owned ones near the first in relevance the most official, newest, trusted.

    Needs sub_id, chunk_id, score, relevance, owner, channel, official, updated_at, trust. Where none is fit, the first by score.
    """
    w = Window.partitionBy("sub_id").orderBy(F.desc("score"), "chunk_id")
    least = F.greatest(F.lit(config.ANSWERS), F.first("relevance").over(w) - 0.35)
    fit = (F.col("relevance") >= least) & (F.col("owner") == 1) & (F.col("channel") >= config.FORMAL)
    rows = strong_.withColumn("_fit", fit)
    keys = [F.desc("_fit"), *(F.when(F.col("_fit"), F.col(c)).desc() for c in ("official", "updated_at", "trust", "relevance")), F.desc("score"), F.col("chunk_id")]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("sub_id").orderBy(*keys))).where("_r = 1").drop("_r", "_fit")


def answered(candidates: DataFrame, disclaimers: DataFrame, subs: DataFrame) -> DataFrame:
    """Status, confidence and leading passage of every sub-question (``subs``: sub_id) from its candidates and disclaimers.

    ``candidates`` needs what ``strong`` and ``primary`` do, doc_type and contested; ``disclaimers``: sub_id, chunk_id, relevance.
    Strong passages give way to a disclaimer that is about as relevant as the first of them (.05 less at most). Returns sub_id, status,
    confidence, chunk_id (the primary, the first related passage or the first disclaimer; null if nothing was found).
    """
    score = 0.5 * F.col("relevance") + 0.5 * F.col("trust")
    rows = candidates.withColumn("score", score)
    able = strong(rows)
    first = able.groupBy("sub_id").agg(F.max_by("relevance", F.struct("score", (-F.col("chunk_id")).alias("i"))).alias("top"), F.count("*").alias("n"))
    lead = primary(able).select("sub_id", F.struct("chunk_id", "relevance", "trust", "doc_type", "contested").alias("lead"))
    near = rows.where(F.col("on_topic") & F.col("asserts") & (F.col("relevance") >= config.RELEVANT) & ((F.col("relevance") < config.ANSWERS) | (F.col("trust") < config.TRUSTED)))
    near = near.groupBy("sub_id").agg(F.max_by(F.struct("chunk_id", "trust"), F.struct("score", (-F.col("chunk_id")).alias("i"))).alias("near"), F.count("*").alias("related"))
    says_no = disclaimers.groupBy("sub_id").agg(F.max("relevance").alias("denies"), F.max_by("chunk_id", F.struct("relevance", (-F.col("chunk_id")).alias("i"))).alias("denial"))
    parts = subs.select("sub_id")
    for more in (first, lead, near, says_no):
        parts = parts.join(more, "sub_id", "left")
    gives_way = F.coalesce(F.col("denies") >= F.col("top") - 0.05, F.lit(False))
    leads = F.col("lead")
    parts = parts.select(
        "sub_id", F.when(gives_way, 0).otherwise(F.coalesce("n", F.lit(0))).alias("strong"), F.col("denies").isNotNull().alias("disclaimed"), F.coalesce("related", F.lit(0)).alias("related"),
        F.coalesce(leads["contested"], F.lit(False)).cast("int").alias("conflicts"), F.coalesce(leads["doc_type"].isin(*config.INFORMAL), F.lit(False)).alias("informal"),
        (0.5 * F.least(F.lit(1.0), leads["relevance"] / 0.8) + 0.5 * leads["trust"]).alias("confidence"), F.col("near.trust").alias("trust"),
        leads["chunk_id"].alias("_lead"), F.col("near.chunk_id").alias("_near"), "denial",
    )
    chunk = F.when(F.col("strong") > 0, F.col("_lead")).when(F.col("status") == "partial", F.col("_near")).otherwise(F.col("denial"))
    return status(parts).select("sub_id", "status", "confidence", chunk.alias("chunk_id"))


def review_count(review: DataFrame) -> DataFrame:
    """Items for review of each question (question_id, ...)."""
    return review.groupBy("question_id").agg(F.count("*").alias("review_count"))


def cards(chunks: DataFrame, people: DataFrame) -> DataFrame:
    """Evidence cards of candidates: names and role of owner and author, country in words, staleness as told, confidence.

    Needs owner_id, author_id, country, relevance, trust, date_known; people: id, name, role, active. Other columns stay.
    """
    names = F.create_map(*[F.lit(x) for kv in config.COUNTRY_NAMES.items() for x in kv])
    rows = chunks
    for side in ("owner", "author"):
        who = people.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side), *([F.col("role").alias("owner_role"), F.col("active").alias("owner_active")] if side == "owner" else []))
        rows = rows.join(who, f"{side}_id", "left")
    known = F.coalesce("date_known", F.lit(True))
    label = F.when(F.col("country").isNull(), "Global").otherwise(F.try_element_at(names, "country"))
    return rows.withColumn("country_name", label).withColumn("date_known", known).withColumn("confidence", confidence(F.col("relevance"), F.col("trust")))
