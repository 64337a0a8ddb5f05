"""Parsers from raw connector payloads to ingest units: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_space, sentences
from ..scratch import cut

SECTION = "array<struct<heading:string,sentences:array<string>>>"


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of payloads, by a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def strip_tags(c: Column) -> Column:
    return clean_space(F.regexp_replace(c, r"<[^>]+>", " "))


def _section(heading: Column, text: Column) -> Column:
    return F.struct(heading.alias("heading"), sentences(text).alias("sentences"))


def _full(sections: Column) -> Column:
    return F.filter(sections, lambda s: F.size(s["sentences"]) > 0)


def sharepoint(items: DataFrame) -> DataFrame:
    """id, name, path, content -> title, type and country by folder, sections at '## ' lines."""
    folders = F.split(F.lower("path"), "/")
    kinds = F.filter(folders, lambda x: x.isin("policies", "procedures", "checklists", "manuals"))
    kind = F.when(F.get(kinds, F.lit(0)) == "policies", "policy").otherwise(F.coalesce(F.regexp_replace(F.get(kinds, F.lit(0)), "s$", ""), F.lit("wiki")))
    country = F.upper(F.get(F.filter(folders, lambda x: x.rlike("^[a-z]{2}$")), F.lit(0)))
    parts = F.split("content", r"\n(?=## )")
    section = F.transform(parts, lambda p: F.when(p.startswith("## "), _section(F.regexp_extract(p, r"^## ([^\n]*)", 1), F.regexp_replace(p, r"^## [^\n]*", ""))).otherwise(_section(F.lit("Overview"), p)))
    return items.select(F.col("id").alias("external_id"), F.regexp_replace("name", r"\.[A-Za-z0-9]+$", "").alias("title"), kind.alias("doc_type"), country.alias("country"), _full(section).alias("sections"))


def confluence(items: DataFrame) -> DataFrame:
    """id, title, labels, html -> sections between h2 headings, type and country by label."""
    heads = F.regexp_extract_all("html", F.lit(r"(?s)<h2[^>]*>(.*?)</h2>"), 1)
    texts = F.slice(F.split("html", r"(?s)<h2[^>]*>.*?</h2>"), 2, 10_000)
    lead = _section(F.lit("Overview"), strip_tags(F.get(F.split("html", r"(?s)<h2[^>]*>.*?</h2>"), F.lit(0))))
    rest = F.zip_with(heads, texts, lambda h, x: _section(strip_tags(h), strip_tags(x)))
    kind = F.coalesce(F.get(F.filter("labels", lambda x: x.isin("policy", "procedure", "manual", "checklist", "analysis")), F.lit(0)), F.lit("wiki"))
    country = F.upper(F.get(F.filter("labels", lambda x: x.rlike("^[a-z]{2}$")), F.lit(0)))
    return items.select(F.col("id").alias("external_id"), "title", kind.alias("doc_type"), country.alias("country"), _full(F.concat(F.array(lead), rest)).alias("sections"))


def rich_texts(items: DataFrame, tree: str, into: str) -> DataFrame:
    """``items`` with the text of the rich-text tree (JSON) in column ``tree`` added as ``into``: the texts of its nodes, a node's before its children's, with single blanks between.

    Null and broken JSON are empty; ``content`` that is no list and ``text`` that is no string don't count. The trees are taken apart level by level, all rows at once: a row carries the
    nodes of its next level and the texts found so far, so nothing is joined or shuffled. There is a pass for each level of the deepest tree, and only rows with a level left are written again.
    """
    root = F.try_parse_json(F.col(tree))
    nodes = F.filter(F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("node"))), lambda n: n["node"].isNotNull())
    level = cut(items.drop(into).withColumn("_nodes", nodes).withColumn("_texts", F.array().cast("array<struct<path:array<int>,text:string>>")))

    def text(n):
        said = F.try_variant_get(n["node"], "$.text", "variant")
        return F.struct(n["path"].alias("path"), F.when(F.schema_of_variant(said) == "STRING", F.try_variant_get(n["node"], "$.text", "string")).alias("text"))

    def children(n):
        found = F.coalesce(F.try_variant_get(n["node"], "$", "array<variant>"), F.try_variant_get(n["node"], "$.content", "array<variant>"), F.array().cast("array<variant>"))
        return F.filter(F.transform(found, lambda c, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), c.alias("node"))), lambda x: x["node"].isNotNull())

    done = None
    while True:
        ready = level.where(F.size("_nodes") == 0)
        done = ready if done is None else done.unionByName(ready)
        left = level.where(F.size("_nodes") > 0)
        if left.isEmpty():
            break
        own = F.filter(F.transform("_nodes", text), lambda x: x["text"].isNotNull())
        level = cut(left.withColumns({"_texts": F.concat("_texts", own), "_nodes": F.flatten(F.transform("_nodes", children))}))
    words = F.array_join(F.transform(F.sort_array("_texts"), lambda x: x["text"]), " ")
    return done.withColumn(into, F.trim(F.regexp_replace(words, r"(?U)\s+", " "))).drop("_nodes", "_texts")


def jira(items: DataFrame) -> DataFrame:
    """key, summary, description (JSON tree), status, labels -> a ticket with description and status sections."""
    country = F.upper(F.get(F.filter("labels", lambda x: x.rlike("^[a-z]{2}$")), F.lit(0)))
    client = F.regexp_extract(F.array_join("labels", " "), r"(?:^| )client-(\S+)", 1)
    items = rich_texts(items, "description", "_said")
    sections = F.array(_section(F.lit("Description"), F.col("_said")), _section(F.lit("Status"), F.concat(F.lit("Status: "), F.col("status"), F.lit("."))))
    return items.select(F.col("key").alias("external_id"), F.col("summary").alias("title"), F.lit("ticket").alias("doc_type"), country.alias("country"), F.nullif(client, F.lit("")).alias("client"), _full(sections).alias("sections"))


def teams(items: DataFrame, least: int = 60) -> DataFrame:
    """id, channel, content -> chat messages of at least 60 characters."""
    rows = items.withColumn("text", strip_tags(F.col("content"))).where(F.length("text") >= least)
    return rows.select(F.col("id").alias("external_id"), F.concat(F.lit("Teams message in #"), "channel").alias("title"), F.lit("chat").alias("doc_type"), F.array(_section(F.lit("Message"), F.col("text"))).alias("sections"))


def outlook(items: DataFrame) -> DataFrame:
    """id, subject, sender, content, preview -> mails; the sender owns and wrote them."""
    text = strip_tags(F.coalesce(F.nullif("content", F.lit("")), "preview"))
    return items.select(F.col("id").alias("external_id"), F.col("subject").alias("title"), F.lit("email").alias("doc_type"), F.col("sender").alias("owner_email"), F.col("sender").alias("author_email"), _full(F.array(_section(F.lit("Message"), text))).alias("sections"))


# What lines of a transcript say, after an optional time and speaker; tried in this order.
DECISION = r"(?iU)^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?(?:[\w .'-]+:\s*)?(?:decision|decided|we agreed|agreed)\s*[:\-–]?\s*(.+)$"
ACTION = r"(?iU)^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?(?:[\w .'-]+:\s*)?(?:action|todo|to do|next step)\s*(?:\(([^)]+)\))?\s*[:\-–]\s*(.+)$"
SPEAKER = r"(?U)^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?([A-Z][\w .'-]+?):\s*(.+)$"


def vtt(transcript: Column) -> Column:
    """A transcript without the marks of WebVTT."""
    named = F.regexp_replace(transcript, r"<v ([^>]+)>", "$1: ")
    lines = F.filter(F.split(F.regexp_replace(named, r"</v>", ""), "\n"), lambda x: ~x.rlike(r"^\s*$|^WEBVTT|-->|^\d+$"))
    return F.array_join(lines, "\n")


def meetings(items: DataFrame) -> DataFrame:
    """id, subject, transcript -> decisions, actions, speakers and a summary of three sentences, as sections.

    Lines that decide or ask for an action (with its owner in brackets) are told first; of the others those of a speaker lose the name, and all of them are
    what the summary is taken from.
    """
    lines = F.filter(F.transform(F.split("transcript", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    full = lambda x: F.concat(F.regexp_replace(x, r"\.+$", ""), F.lit("."))

    def judged(x):
        owner, named = F.regexp_extract(x, ACTION, 1), F.regexp_extract(x, SPEAKER, 1)
        action = F.concat(F.lit("Action"), F.when(owner != "", F.concat(F.lit(" ("), owner, F.lit(")"))).otherwise(""), F.lit(": "), full(F.regexp_extract(x, ACTION, 2)))
        decides, asks, speaks = x.rlike(DECISION), x.rlike(ACTION), x.rlike(SPEAKER)
        kind = F.when(decides, "decision").when(asks, "action").otherwise("said")
        text = F.when(decides, F.concat(F.lit("Decision: "), full(F.regexp_extract(x, DECISION, 1)))).when(asks, action).when(speaks, F.regexp_extract(x, SPEAKER, 2)).otherwise(x)
        return F.struct(kind.alias("kind"), text.alias("text"), F.when(~decides & ~asks & speaks, named).alias("speaker"))

    rows = items.withColumn("lines", F.transform(lines, judged))
    pick = lambda kind: F.transform(F.filter("lines", lambda x: x["kind"] == kind), lambda x: x["text"])
    rows = rows.withColumn("decisions", pick("decision")).withColumn("actions", pick("action")).withColumn("speakers", F.array_distinct(F.array_compact(F.transform("lines", lambda x: x["speaker"]))))
    summary = F.slice(sentences(F.array_join(pick("said"), " ")), 1, 3)
    named = lambda name, items_: F.struct(F.lit(name).alias("heading"), items_.alias("sentences"))
    return rows.select(F.col("id").alias("external_id"), F.col("subject").alias("title"), F.lit("meeting").alias("doc_type"), "decisions", "actions", "speakers", _full(F.array(named("Decisions", F.col("decisions")), named("Actions", F.col("actions")), named("Summary", summary))).alias("sections"))


def identity(units: DataFrame, registry: DataFrame, source: str = "source") -> DataFrame:
    """``units`` with the connector, source_system and id_prefix that their ``source`` names, so that what is pushed meets what a sync brings.

    ``registry``: name, label, source_system, id_prefix of connectors (a handful). A source is told by any of the three in any case, the first name of several; an unknown one is
    a connector of its own, with a prefix of API- and eight of its letters and digits.
    """
    said = F.lower(source)
    names = registry.select(F.explode(F.array(F.lower("name"), F.lower("label"), F.lower("source_system"))).alias("_said"), F.struct("name", "source_system", "id_prefix").alias("_c"))
    names = names.groupBy("_said").agg(F.min("_c").alias("_c"))
    rows = units.join(F.broadcast(names), said == F.col("_said"), "left")
    own = F.concat(F.lit("API-"), F.substring(F.regexp_replace(F.upper(source), r"(?U)[^\p{Alnum}]", ""), 1, 8))
    rows = rows.withColumn("connector", F.coalesce(F.col("_c.name"), F.concat(F.lit("push:"), said)))
    rows = rows.withColumn("source_system", F.coalesce(F.col("_c.source_system"), F.col(source))).withColumn("id_prefix", F.coalesce(F.col("_c.id_prefix"), own))
    return rows.drop("_said", "_c")


def push(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Documents handed over by a caller."""
    return spark.createDataFrame(rows, schema)
