"""Ingest with change detection: pure functions from a batch and the current snapshot to new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as t
from ..scratch import spread
from ..sources import connectors
from . import understand


def body(title, sections):
    """Document body: title, blank line, then each section's heading, sentences a line each, and a blank line."""
    part = F.transform(F.filter(sections, lambda s: F.size(s["sentences"]) > 0), lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n"), F.array_join(s["sentences"], "\n"), F.lit("\n")))
    return F.concat(title, F.lit("\n\n"), F.array_join(part, "\n"))


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each non-empty section of (id, title, topics, sections): with its lines in the body and a content hash."""
    kept = docs.withColumn("sections", F.filter("sections", lambda s: F.size(s["sentences"]) > 0))
    rows = kept.select("id", "title", "topics", F.posexplode("sections").alias("pos", "s"))
    size = F.size("s.sentences")
    before = F.coalesce(F.sum(size + 2).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("line_start", (before + 4).cast("int")).withColumn("text", F.array_join("s.sentences", " "))
    return rows.select(
        F.col("id").alias("document_id"), "pos", F.col("s.heading").alias("section"), "line_start", (F.col("line_start") + size - 1).alias("line_end"), "text", "topics",
        F.sha1(F.concat_ws(". ", "title", "s.heading", "text")).alias("content_hash"),
    )


def classify(batch: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``batch`` (id, content_hash, ...) with change inserted, updated or unchanged, and the status that follows.

    Changed content brings archived and outdated documents back; retracted ones stay retracted, and unchanged ones keep their status.
    """
    old = current.select("id", F.col("content_hash").alias("old_hash"), F.col("status").alias("old_status"))
    rows = spread(batch, "id", rows=batch.count() + current.count()).join(old, "id", "left")
    change = F.when(F.col("old_hash").isNull(), "inserted").when(F.col("old_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    back = F.col("old_status").isNull() | ((change == "updated") & F.col("old_status").isin("archived", "needs_update"))
    return rows.withColumn("change", change).withColumn("status", F.when(back, "active").otherwise(F.col("old_status"))).drop("old_hash", "old_status")


def apply(batch: DataFrame, current: DataFrame, seen_at: str | None = None) -> DataFrame:
    """The new snapshot: changed rows replace their predecessors, all others stay; with ``seen_at`` all rows of the batch get it as last_seen_at."""
    if seen_at is None:
        changed = classify(batch, current).where("change <> 'unchanged'").drop("change")
        return current.join(changed.select("id"), "id", "left_anti").unionByName(changed, allowMissingColumns=True)
    at = F.lit(seen_at).cast("timestamp")
    judged = classify(batch, current)
    changed = judged.where("change <> 'unchanged'").drop("change").withColumn("last_seen_at", at)
    marks = judged.select("id", (F.col("change") == "unchanged").alias("_same"))
    kept = current.join(marks, "id", "left").where("_same IS NULL OR _same")
    old = F.col("last_seen_at") if "last_seen_at" in current.columns else F.lit(None).cast("timestamp")
    kept = kept.withColumn("last_seen_at", F.when(F.col("_same"), at).otherwise(old)).drop("_same")
    return kept.unionByName(changed, allowMissingColumns=True)


def counts(classified: DataFrame) -> DataFrame:
    """Rows of a run by what became of them."""
    is_ = lambda c: F.count_if(F.col("change") == c).alias(c)
    return classified.agg(F.count("*").alias("fetched"), is_("inserted"), is_("updated"), is_("unchanged"))


def tombstones(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Active rows of ``current`` that a full sync did not see, as archived; none if it saw nothing at all."""
    some = seen.select(F.lit(True).alias("_some")).limit(1)
    gone = current.where("status = 'active'").join(seen.select("id"), "id", "left_anti")
    return gone.crossJoin(F.broadcast(some)).drop("_some").withColumn("status", F.lit("archived"))


def next_versions(changed: DataFrame, versions: DataFrame) -> DataFrame:
    """Version numbers for changed documents: one more than the last."""
    last = versions.groupBy("document_id").agg(F.max("version_no").alias("last"))
    rows = changed.select(F.col("id").alias("document_id"), "body", "content_hash", F.col("owner_id").alias("changed_by"))
    return rows.join(last, "document_id", "left").withColumn("version_no", F.coalesce("last", F.lit(0)) + 1).drop("last")


def supersession(docs: DataFrame) -> DataFrame:
    """(id, supersedes_id): the next older document of the same title stem and (null-safe) country; chat and the like never."""
    rows = docs.where((F.col("status") != "retracted") & ~F.col("doc_type").isin(*config.NO_REVIEW)).withColumn("stem", t.title_stem(F.col("title")))
    older = F.lag("id").over(Window.partitionBy("stem", "country").orderBy("updated_at", "id"))
    return rows.withColumn("supersedes_id", older).where("supersedes_id IS NOT NULL").select("id", "supersedes_id")


def change_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changed between two versions, by section: added, facts gone -> new, wording changed, removed."""
    o = old.select(F.col("document_id"), "section", F.col("text").alias("a"), F.col("pos").alias("pa"))
    n = new.select(F.col("document_id"), "section", F.col("text").alias("b"), F.col("pos").alias("pb"))
    gone, come = F.array_except(t.numeric_facts(F.col("a")), t.numeric_facts(F.col("b"))), F.array_except(t.numeric_facts(F.col("b")), t.numeric_facts(F.col("a")))
    said = (
        F.when(F.col("a").isNull(), F.concat(F.col("section"), F.lit(": added")))
        .when(F.col("b").isNull(), F.concat(F.col("section"), F.lit(": removed")))
        .when((F.size(gone) > 0) | (F.size(come) > 0), F.concat(F.col("section"), F.lit(": "), F.array_join(gone, ", "), F.lit(" → "), F.array_join(come, ", ")))
        .when(F.col("a") != F.col("b"), F.concat(F.col("section"), F.lit(": wording changed")))
    )
    rows = o.join(n, ["document_id", "section"], "full").withColumn("said", said).where("said IS NOT NULL")
    order = F.struct(F.col("pb").isNull().alias("x"), F.coalesce("pb", "pa").alias("y"), "said")
    out = rows.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["said"]), "; ").alias("summary"))
    return new.select("document_id").distinct().join(out, "document_id", "left").withColumn("summary", F.coalesce("summary", F.lit("content changed")))


def embeddings(new_chunks: DataFrame, old_chunks: DataFrame, embed) -> DataFrame:
    """Embeddings of new chunks: that of an old chunk of the same document and hash, else ``embed(text)``."""
    known = old_chunks.dropDuplicates(["document_id", "content_hash"]).select("document_id", "content_hash", F.col("embedding").alias("old"))
    return new_chunks.join(known, ["document_id", "content_hash"], "left").withColumn("embedding", F.coalesce("old", embed(F.col("text")))).drop("old")


def enrich(batch: DataFrame, people: DataFrame) -> DataFrame:
    """Owner and author ids of (owner_email, author_email, ...) by lower-case e-mail; who has no author is its owner's work.

    Of people with one e-mail the smallest id counts.
    """
    known = people.groupBy(F.lower("email").alias("_email")).agg(F.min("id").alias("_id"))
    rows = batch
    for side in ("owner", "author"):
        who = known.select(F.col("_email").alias(f"_{side}"), F.col("_id").alias(f"{side}_id"))
        rows = rows.join(who, F.lower(f"{side}_email") == F.col(f"_{side}"), "left").drop(f"_{side}")
    return rows.withColumn("author_id", F.coalesce("author_id", "owner_id"))


def enrich_text(batch: DataFrame, topics: list[tuple[str, str]], clients: list[tuple[int, str, str]], employees: list[tuple[int, str, str]], teams: list[tuple[int, str, str]]) -> DataFrame:
    """Topics, client, country and team of documents (title, body, topics, client, country, team), as given or, where missing, as title and body say.

    ``topics``: (topic, keyword); ``clients``: (priority, name, country); ``employees``: (priority, employee, client); ``teams``: (priority, team, keyword), of which the
    team with most keywords anywhere in the text counts, the first of equals. All other columns stay.
    """
    text = F.concat_ws(" ", "title", "body")
    said = understand.placed(text, clients, employees)
    found = understand.topics_of(text, topics)
    rows = batch.withColumn("_said", said).withColumn("topics", F.when(F.size(F.coalesce("topics", F.array().cast("array<string>"))) > 0, F.col("topics")).otherwise(found))
    rows = rows.withColumn("country", F.coalesce("country", "_said.country")).withColumn("client", F.coalesce("client", "_said.client"))
    return rows.withColumn("team", F.coalesce("team", understand.most_of(text, teams)["code"])).drop("_said")


def pushed(units: DataFrame, registry: DataFrame) -> DataFrame:
    """Units handed over by callers (source, external_id, title, sections, ...) as documents for ``classify`` and ``apply``: id, body and content_hash are added.

    Units without sections are left out. Of units with one id the last in the order of body counts, so that a batch has one row a document.
    """
    rows = connectors.identity(units.where(F.size("sections") > 0), registry)
    rows = rows.withColumn("id", t.slug(F.concat("id_prefix", F.lit("-")), F.col("external_id").cast("string"))).withColumn("body", body(F.col("title"), F.col("sections")))
    rows = rows.withColumn("content_hash", F.sha1("body"))
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "body").alias("r")).select("id", "r.*")


def replace_edges(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (person_id, rel, document_id) after documents (id, owner_id, author_id, attendee_ids) were written again.

    Their owns, authored and attended edges are made anew (an owner doesn't attend as well); all other edges stay.
    """
    again = docs.select(F.col("id").alias("document_id")).withColumn("_again", F.lit(True)).distinct()
    stay = edges.join(again, "document_id", "left").where("_again IS NULL OR rel NOT IN ('owns', 'authored', 'attended')").drop("_again")
    one = lambda who, rel: F.array(F.struct(F.col(who).alias("person_id"), F.lit(rel).alias("rel")))
    guests = F.filter(F.coalesce("attendee_ids", F.array().cast("array<bigint>")), lambda x: ~x.eqNullSafe(F.col("owner_id")))
    said = F.concat(one("owner_id", "owns"), one("author_id", "authored"), F.transform(F.array_distinct(guests), lambda x: F.struct(x.alias("person_id"), F.lit("attended").alias("rel"))))
    fresh = docs.select(F.col("id").alias("document_id"), F.explode(said).alias("e")).select("e.person_id", "e.rel", "document_id").where("person_id IS NOT NULL")
    return stay.select("person_id", "rel", "document_id").unionByName(fresh)


def edited(classified: DataFrame, at: str) -> DataFrame:
    """Edges that updated documents with an owner leave."""
    rows = classified.where("change = 'updated' AND owner_id IS NOT NULL")
    return rows.select(F.col("owner_id").alias("person_id"), F.lit("edited").alias("rel"), F.col("id").alias("document_id"), F.lit(at).cast("date").alias("at"))


def added(notes: DataFrame, docs: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and edges of texts added directly (seq, title, text, doc_type, owner_id, topics).

    Ids are USR- and a number of four digits or more, which goes on from the ids in ``docs``. Numbers follow seq: they are counted within
    ranges of seq and the ranges' sizes added up, so no task holds all notes. One section, Note (Decisions for meetings), with the sentences of the text.
    """
    spans = notes.withColumn("_r", F.floor(F.col("seq") / 4096))
    sizes = spans.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    so_far = docs.where("id LIKE 'USR-%'").agg(F.count("*").alias("_old"))
    own = F.row_number().over(Window.partitionBy("_r").orderBy("seq", "title"))
    rows = spans.withColumn("_own", own).join(sizes, "_r").crossJoin(so_far)  # one row
    n = (F.col("_old") + F.col("_before") + F.col("_own")).cast("string")
    rows = rows.withColumn("id", F.concat(F.lit("USR-"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)))
    rows = rows.withColumn("section", F.when(F.col("doc_type") == "meeting", "Decisions").otherwise("Note")).withColumn("sentences", t.sentences_any(F.col("text")))
    made = rows.select("id", "title", "doc_type", "owner_id", F.col("owner_id").alias("author_id"), "topics", F.concat_ws("\n", "title", F.lit(""), F.concat(F.lit("## "), "section"), F.array_join("sentences", "\n")).alias("body"), F.lit("active").alias("status"), F.lit(at).cast("date").alias("updated_at"))
    parts = rows.select(F.col("id").alias("document_id"), "section", F.lit(4).alias("line_start"), (F.size("sentences") + 3).alias("line_end"), F.array_join("sentences", " ").alias("text"), "topics")
    rels = F.explode(F.array(F.lit("owns"), F.lit("authored"))).alias("rel")
    edges = rows.where("owner_id IS NOT NULL").select(F.col("owner_id").alias("person_id"), rels, F.col("id").alias("document_id"), F.lit(at).cast("date").alias("at"))
    return made, parts, edges


def rebuild(docs: DataFrame, people: DataFrame, edges: DataFrame, folder: str) -> dict[str, DataFrame]:
    """All tables of a corpus written anew under ``folder``: people, documents (with bodies), chunks, edges (owns, authored and those given).

    Needs docs id, title, topics, sections, owner_id, author_id, created_at, updated_at; edges person_id, rel, dst, at.
    """
    derived = F.array(F.struct(F.col("owner_id").alias("person_id"), F.lit("owns").alias("rel"), F.col("updated_at").alias("at")), F.struct(F.col("author_id").alias("person_id"), F.lit("authored").alias("rel"), F.col("created_at").alias("at")))
    own = docs.select(F.explode(derived).alias("e"), F.concat(F.lit("doc:"), "id").alias("dst")).where("e.person_id IS NOT NULL").select("e.person_id", "e.rel", "dst", "e.at")
    made = {"people": people, "documents": docs.withColumn("body", body(F.col("title"), F.col("sections"))).drop("sections"), "chunks": chunks(docs), "edges": own.unionByName(edges.select("person_id", "rel", "dst", "at"))}
    out = {}
    for name, table in made.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")
    return out
