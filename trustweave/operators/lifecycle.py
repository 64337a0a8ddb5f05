"""Review dates, tasks, actions and overviews over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from .trust import age, review_period


def latest(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def due(docs: DataFrame, as_of: str) -> DataFrame:
    """Adds age and review_due by the later of updated_at and validated_at."""
    days = age(F.lit(as_of).cast("date"), F.col("updated_at"), F.col("validated_at"))
    return docs.withColumn("age", days).withColumn("review_due", days > review_period(F.col("doc_type")))


def sweep(docs: DataFrame, people: DataFrame, tasks: DataFrame, as_of: str) -> DataFrame:
    """New tasks for active documents: reassign_owner (left open to anybody) where the owner is known to be inactive, else confirm_valid for the owner or author.

    Needs id, status, doc_type, owner_id, author_id, updated_at, validated_at; people: id, active; tasks: document_id, kind, done. An owner whom ``people`` doesn't know is
    not inactive, and is asked nothing. No task is made where one of its kind is open. Returns kind, document_id, assignee_id and note.
    """
    who = people.select(F.col("id").alias("owner_id"), F.col("active").alias("owner_active"))
    open_ = tasks.where("NOT done AND kind IN ('reassign_owner', 'confirm_valid')").select(F.col("document_id").alias("id"), "kind").distinct()
    rows = due(docs.where(F.col("status").isin("active", "needs_update") & ~F.col("doc_type").isin(*config.NO_REVIEW)), as_of).join(who, "owner_id", "left")
    left = F.col("owner_id").isNotNull() & ~F.coalesce("owner_active", F.lit(True))
    asked = F.coalesce("owner_active", F.lit(False)) | (F.col("owner_id").isNull() & F.col("author_id").isNotNull())
    kind = F.when(left, "reassign_owner").when(F.col("review_due") & asked, "confirm_valid")
    new = rows.withColumn("kind", kind).where("kind IS NOT NULL").join(open_, ["id", "kind"], "left_anti")
    # The notes of the tasks.
    overdue = F.concat(F.lit("Not edited or confirmed for "), "age", F.lit(" days (review period "), review_period(F.col("doc_type")), F.lit(" days). Still valid?"))
    note = F.when(F.col("kind") == "reassign_owner", "Owner has left the company; document needs a new owner").otherwise(overdue)
    return new.select("kind", F.col("id").alias("document_id"), F.when(F.col("kind") == "confirm_valid", F.coalesce("owner_id", "author_id")).alias("assignee_id"), note.alias("note"))


def current_status(actions: DataFrame) -> DataFrame:
    """Status of each document from its log of (document_id, seq, action)."""
    to = F.when(F.col("action") == "retract", "retracted").when(F.col("action") == "archive", "archived").when(F.col("action") == "request_update", "needs_update").when(F.col("action").isin("restore", "validate"), "active")
    return actions.withColumn("status", to).where("status IS NOT NULL").groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))


def act(docs: DataFrame, tasks: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a log of review actions (document_id, seq, action, actor_id, assignee_id, at) leaves: documents, tasks and edges.

    Documents (id, status, owner_id, author_id, validated_at) take the status of their last action and the day of their last validation. Tasks
    (document_id, kind, assignee_id, seq, done): a request asks who is named, else the owner, else the author; a restore later than a task closes it, a
    validation those that ask for one. Validations leave a reviewed edge of the actor or owner. Actions on unknown documents have no effect.
    """
    log = actions.join(docs.select(F.col("id").alias("document_id"), "owner_id", "author_id"), "document_id")
    last = current_status(log).withColumnRenamed("status", "_status")
    valid = log.where("action = 'validate'").groupBy("document_id").agg(F.max_by("at", "seq").alias("_valid"))
    closes = log.where("action IN ('restore', 'validate')").groupBy("document_id").agg(F.max(F.when(F.col("action") == "restore", F.col("seq"))).alias("_restored"), F.max(F.when(F.col("action") == "validate", F.col("seq"))).alias("_checked"))
    out = docs.join(last.withColumnRenamed("document_id", "id"), "id", "left").join(valid.withColumnRenamed("document_id", "id"), "id", "left")
    out = out.withColumn("status", F.coalesce("_status", "status")).withColumn("validated_at", F.coalesce("_valid", "validated_at")).drop("_status", "_valid")
    asked = log.where("action = 'request_update'").select("document_id", F.lit("request_update").alias("kind"), F.coalesce("assignee_id", "owner_id", "author_id").alias("assignee_id"), "seq", F.lit(False).alias("done")).where("assignee_id IS NOT NULL")
    all_ = tasks.select("document_id", "kind", "assignee_id", "seq", "done").unionByName(asked).join(closes, "document_id", "left")
    closed = F.coalesce(F.col("_restored") > F.col("seq"), F.lit(False)) | ((F.col("kind") == "confirm_valid") & F.coalesce(F.col("_checked") > F.col("seq"), F.lit(False)))
    all_ = all_.withColumn("done", F.col("done") | closed).drop("_restored", "_checked")
    edges = log.where("action = 'validate'").select(F.coalesce("actor_id", "owner_id").alias("person_id"), F.lit("reviewed").alias("rel"), "document_id", "at").where("person_id IS NOT NULL")
    return out, all_, edges


def overview(docs: DataFrame, tasks: DataFrame, as_of: str, versions: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Counts over documents that aren't retracted: all, fresh (180 days), overdue (chat and the like never), open tasks in all and by kind; with
    ``versions`` how many are recorded, with ``runs`` (finished_at) the last sync."""
    rows = docs.where("status <> 'retracted'") if "status" in docs.columns else docs
    late = F.col("review_due") & ~F.col("doc_type").isin(*config.NO_REVIEW)
    d = due(rows, as_of).agg(F.count("*").alias("documents"), F.count_if(F.col("age") <= 180).alias("fresh"), F.count_if(late).alias("overdue"))
    open_ = tasks.where("NOT done")
    out = d.crossJoin(open_.agg(F.count("*").alias("open_tasks")))  # one row each
    if "kind" in tasks.columns:
        kinds = open_.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
        out = out.crossJoin(kinds)
    if versions is not None:
        out = out.crossJoin(versions.agg(F.count("*").alias("versions_recorded")))
    return out if runs is None else out.crossJoin(runs.agg(F.max("finished_at").alias("last_sync")))


def people_list(people: DataFrame) -> DataFrame:
    """People by name."""
    return people.orderBy("name", "id")


def open_tasks(tasks: DataFrame, docs: DataFrame, people: DataFrame) -> DataFrame:
    d = docs.select(F.col("id").alias("document_id"), "title")
    p = people.select(F.col("id").alias("assignee_id"), F.col("name").alias("assignee"))
    return tasks.where("NOT done").join(d, "document_id").join(p, "assignee_id", "left").orderBy(F.desc("created_at"), "document_id", "kind")


def close_tasks(tasks: DataFrame, classified: DataFrame) -> DataFrame:
    """Tasks with requests and confirmations done for documents (id, change, owner_id) that were updated."""
    hit = classified.where("change = 'updated' AND owner_id IS NOT NULL").select(F.col("id").alias("document_id"), F.lit(True).alias("_hit")).distinct()
    closes = F.coalesce("_hit", F.lit(False)) & F.col("kind").isin("request_update", "confirm_valid")
    return tasks.join(hit, "document_id", "left").withColumn("done", F.col("done") | closes).drop("_hit")


def high_water(runs: DataFrame, since: str | None = None, full: bool = False) -> DataFrame:
    """The day from which each connector's next sync reads: ``since`` where it is given, nothing (all) for a full sync, else that of its last finished run."""
    if full or since is not None:
        return runs.select("connector").distinct().withColumn("since", F.lit(None if full else since).cast("date"))
    return runs.where("finished_at IS NOT NULL").groupBy("connector").agg(F.to_date(F.max("finished_at")).alias("since"))


def sync_status(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """The latest run of each connector and the number of its documents (connector, status) that aren't retracted."""
    held = docs.where("status <> 'retracted'").groupBy("connector").agg(F.count("*").alias("documents"))
    rows = latest(runs, ["connector"], [F.desc("finished_at"), F.desc("run_id")]).join(held, "connector", "left")
    return rows.withColumn("documents", F.coalesce("documents", F.lit(0)))


def detail(docs: DataFrame, people: DataFrame, versions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Documents (id, owner_id, author_id, supersedes_id, body) with names, successor, versions (newest first), open tasks and lines."""
    rows = docs.withColumn("lines", F.split("body", "\n"))
    for side in ("owner", "author"):
        rows = rows.join(people.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(side)), f"{side}_id", "left")
    after = docs.where("supersedes_id IS NOT NULL").groupBy(F.col("supersedes_id").alias("id")).agg(F.min("id").alias("successor"))
    old = versions.groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list("version_no"), asc=False).alias("versions"))
    due_ = tasks.where("NOT done").groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("open_tasks"))
    return rows.join(after, "id", "left").join(old, "id", "left").join(due_, "id", "left").withColumn("open_tasks", F.coalesce("open_tasks", F.lit(0)))
