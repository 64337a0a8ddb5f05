"""Trust signals as columns. Dates are judged as of a day that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config


def lookup(values: dict, key: Column, otherwise: float) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def channel(doc_type: Column) -> Column:
    return lookup(config.CHANNEL, doc_type, config.CHANNEL_ELSE)


def half_life(doc_type: Column) -> Column:
    return lookup(config.HALF_LIFE, doc_type, config.HALF_LIFE_ELSE)


def review_period(doc_type: Column) -> Column:
    return lookup({k: int(v * 1.2) for k, v in config.HALF_LIFE.items()}, doc_type, config.HALF_LIFE_ELSE)


def age(as_of: Column, *dates: Column) -> Column:
    """Days since the latest of the dates."""
    return F.datediff(as_of, F.greatest(*dates) if len(dates) > 1 else dates[0])


def freshness(days: Column, half_life_days: Column, known: Column | None = None) -> Column:
    fresh = F.pow(F.lit(0.5), days / half_life_days)
    return fresh if known is None else F.when(known, fresh).otherwise(F.lit(0.2))


def owner(owner_active: Column, author_active: Column) -> Column:
    """Active owner 1, inactive owner .35, else active author .55, else .15; null means there is none."""
    return F.when(owner_active, 1.0).when(owner_active.isNotNull(), 0.35).when(author_active, 0.55).otherwise(F.lit(0.15))


def scope(doc_country: Column, asked: Column, same_client: Column) -> Column:
    """0 for another country, 1 for the same, .8 for a global document, .7 where none was asked; .1 more for the same client."""
    base = F.when(doc_country.isNull(), 0.8).when(asked.isNull(), 0.7).when(doc_country == asked, 1.0).otherwise(F.lit(0.0))
    return F.when(base == 0, 0.0).otherwise(F.least(F.lit(1.0), base + F.when(same_client, 0.1).otherwise(0.0)))


def authority(normalised: Column) -> Column:
    return F.least(F.lit(1.0), 0.3 + 0.7 * F.coalesce(normalised, F.lit(0.0)))


def total(fresh: Column, own: Column, auth: Column, chan: Column, supersession: Column, in_scope: Column) -> Column:
    score = 0.30 * fresh + 0.20 * own + 0.15 * auth + 0.15 * chan + 0.20 * supersession
    return F.round(F.when(in_scope, score).otherwise(0.0), 3)


def confidence(relevance: Column, trust: Column) -> Column:
    return F.round(0.5 * F.least(F.lit(1.0), relevance / 0.8) + 0.5 * trust, 2)


def relevance(similarity: Column, lexical: Column, on_topic: Column, boost: Column) -> Column:
    """Weighted sum with at most 1, rounded before anything is compared with it."""
    return F.round(F.least(F.lit(1.0), 0.45 * similarity + 0.35 * lexical + F.when(on_topic, 0.2).otherwise(0.0) + boost), 3)


def bucket(disclaims: Column, relevance_: Column, in_scope: Column, unofficial: Column, superseded: Column, on_topic: Column) -> Column:
    """Where a candidate goes; null if it is dropped."""
    review = (relevance_ >= config.RELEVANT) & on_topic
    kind = lambda name: F.when(review, F.lit(name))
    return (
        F.when(disclaims & (relevance_ >= config.RELEVANT) & in_scope, F.lit("disclaimer"))
        .when(unofficial, kind("unofficial"))
        .when(~in_scope, kind("out_of_scope"))
        .when(superseded, kind("outdated"))
        .otherwise(F.lit("usable"))
    )


def superseded(docs: DataFrame) -> DataFrame:
    """Adds supersession: .15 where any document names this one (id) as the one it supersedes, whatever its status; else 1."""
    older = docs.where("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("id")).distinct().withColumn("_old", F.lit(0.15))
    return docs.join(older, "id", "left").withColumn("supersession", F.coalesce("_old", F.lit(1.0))).drop("_old")


def unofficial(has_owner: Column, has_author: Column, date_known: Column) -> Column:
    """Neither owner nor author nor date: never an official source."""
    return ~has_owner & ~has_author & ~date_known


def signals(docs: DataFrame, people: DataFrame, as_of: str) -> DataFrame:
    """All trust signals of documents for what is asked (asked_country, asked_client) with the standing of who answers for them (normalised).

    Needs id, doc_type, country, client, owner_id, author_id, updated_at, validated_at, date_known, supersedes_id (or, where the rows are not all documents, supersession as from
    ``superseded``). Adds freshness, owner, scope,
    authority, channel, supersession, trust, in_scope, stale, unofficial. Ids of nobody in ``people`` count as none.
    """
    who = people.select("id", "active")
    rows = docs if "supersession" in docs.columns else superseded(docs)
    for side in ("owner", "author"):
        rows = rows.join(who.select(F.col("id").alias(f"{side}_id"), F.col("active").alias(f"_{side}")), f"{side}_id", "left")
    days = age(F.lit(as_of).cast("date"), F.col("updated_at"), F.col("validated_at"))
    known = F.coalesce("date_known", F.lit(True))
    rows = rows.withColumn("freshness", freshness(days, half_life(F.col("doc_type")), known)).withColumn("stale", known & (days > review_period(F.col("doc_type"))))
    rows = rows.withColumn("owner", owner(F.col("_owner"), F.col("_author"))).withColumn("channel", channel(F.col("doc_type")))
    rows = rows.withColumn("scope", scope(F.col("country"), F.col("asked_country"), F.coalesce(F.col("client") == F.col("asked_client"), F.lit(False))))
    rows = rows.withColumn("in_scope", F.col("scope") > 0)
    nobody = F.col("_owner").isNull() & F.col("_author").isNull()
    rows = rows.withColumn("authority", F.when(nobody, 0.3).otherwise(authority(F.col("normalised"))))
    rows = rows.withColumn("unofficial", unofficial(F.col("_owner").isNotNull(), F.col("_author").isNotNull(), known))
    return rows.withColumn("trust", total(*(F.col(c) for c in ("freshness", "owner", "authority", "channel", "supersession", "in_scope")))).drop("_owner", "_author")
