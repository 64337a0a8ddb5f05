"""Queries of parsers, ingest, understanding and review over the shared tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions import text as t
from ..functions import vectors as v
from ..operators import analyse, answer, ingest, lifecycle, reputation, retrieve, search, search_index, trust, understand
from ..scratch import cut
from ..scratch import folder as scratch_folder
from ..sources import connectors
from .queries import _t, query

_CLEAN = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _headings():
    return F.array_join(F.transform("sections", lambda s: s["heading"]), ",").alias("headings")


def _said():
    return F.array_join(F.flatten(F.transform("sections", lambda s: s["sentences"])), " ")


@query(r"""SELECT doc_id AS external_id, 'note ' || doc_id AS title, CASE doc_id % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'procedure' WHEN 2 THEN 'manual' ELSE 'wiki' END AS doc_type, upper(lang) AS country,
'Overview,' || CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' THEN 'Scope,' ELSE '' END || 'End' AS headings FROM documents""")
def folder_units(spark, d):
    """S3: files of a folder tree as units with sections."""
    kind = F.element_at(F.array(*map(F.lit, ("Policies", "Procedures", "Manuals", "Other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    items = _t(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("note "), F.col("doc_id"), F.lit(".md")).alias("name"), F.concat_ws("/", F.lit("Shared"), kind, "lang").alias("path"),
        F.concat(F.lit("Intro.\n## Scope\n"), "text", F.lit("\n## End\nDone.")).alias("content"),
    )
    return connectors.sharepoint(items).select("external_id", "title", "doc_type", "country", _headings())


@query(f"""WITH p AS (SELECT page_id, {_CLEAN.format("split_part(html, '<h1>', 1)")} AS lead, {_CLEAN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h, {_CLEAN.format("substr(html, strpos(html, '</h1>') + 5)")} AS rest FROM pages)
SELECT page_id AS external_id, CASE page_id % 3 WHEN 0 THEN 'policy' ELSE 'wiki' END AS doc_type, CASE page_id % 3 WHEN 1 THEN 'DE' END AS country, concat_ws(',', CASE WHEN lead <> '' THEN 'Overview' END, CASE WHEN rest <> '' THEN h END) AS headings FROM p""")
def wiki_units(spark, d):
    """Wiki pages as units with the sections between their headings."""
    label = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("policy"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("de"))).otherwise(F.array(F.lit("x")))
    html = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<h2>")), F.lit("</h1>"), F.lit("</h2>"))
    items = _t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), label.alias("labels"), html.alias("html"))
    return connectors.confluence(items).select("external_id", "doc_type", "country", _headings())


@query("""SELECT o_orderkey AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'FR' END AS country, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS client,
'Order of customer ' || o_custkey || ' is late. Status: ' || o_orderstatus || '.' AS said FROM orders""")
def ticket_units(spark, d):
    """Tickets with rich-text trees as units."""
    tree = F.format_string('{"type":"doc","content":[{"content":[{"text":"Order of"},{"text":"customer %s"}]},{"content":[{"content":[{"text":"is late."}]}]}]}', F.col("o_custkey").cast("string"))
    labels = F.array_compact(F.array(F.when(F.col("o_orderkey") % 2 == 0, "fr"), F.lit("open"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("client-c"), "o_custkey"))))
    items = _t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("summary"), tree.alias("description"), F.col("o_orderstatus").alias("status"), labels.alias("labels"))
    return connectors.jira(items).select("external_id", "title", "country", "client", _said().alias("said"))


@query(f"WITH m AS (SELECT conv_id || '.' || turn AS external_id, 'Teams message in #' || role AS title, {_CLEAN.format("'<p>' || text || '</p>'")} AS said FROM conversations) SELECT external_id, title, length(said) AS n_chars FROM m WHERE length(said) >= 60")
def chat_units(spark, d):
    """Chat messages of at least 60 characters."""
    c = _t(spark, d, "conversations")
    items = c.select(F.concat_ws(".", "conv_id", "turn").alias("id"), F.col("role").alias("channel"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("content"))
    return connectors.teams(items).select("external_id", "title", F.length(_said()).cast("long").alias("n_chars"))


@query(f"""SELECT item_id AS external_id, 'u' || item_id % 7 || '@example.com' AS owner_email, length({_CLEAN.format("CASE WHEN item_id % 2 = 0 THEN '<b>' || text || '</b>' ELSE text END")}) AS n_chars FROM benchmark""")
def mail_units(spark, d):
    """Mails, by their preview where the body is empty."""
    body = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("<b>"), "text", F.lit("</b>"))).otherwise("")
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("mail").alias("subject"), F.concat(F.lit("u"), F.col("item_id") % 7, F.lit("@example.com")).alias("sender"), body.alias("content"), F.col("text").alias("preview"))
    return connectors.outlook(items).select("external_id", "owner_email", F.length(_said()).cast("long").alias("n_chars"))


@query(r"SELECT conv_id, string_agg(role || ': ' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def caption_cleanup(spark, d):
    """Transcripts without caption marks."""
    cue = F.concat(F.lit("\n"), F.col("turn") + 1, F.lit("\n00:00:01.000 --> 00:00:02.000\n<v "), "role", F.lit(">"), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("</v>"))
    raw = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n").alias("raw"))
    return raw.select("conv_id", connectors.vtt(F.concat(F.lit("WEBVTT\n"), "raw")).alias("transcript"))


@query("""WITH s AS (SELECT conv_id, turn, role, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS x FROM conversations), k AS (SELECT *, len(x)::INT AS n FROM s WHERE len(x) > 0),
l AS (SELECT *, (4 + coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line_start FROM k)
SELECT conv_id AS document_id, role AS section, line_start, line_start + n - 1 AS line_end, sha1('conversation. ' || role || '. ' || array_to_string(x, ' ')) AS content_hash FROM l""")
def chunk_sections(spark, d):
    """Sections of documents with their lines and hashes."""
    sentences = F.filter(F.split("text", "\n"), lambda x: x != "")
    s = _t(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.struct("turn", F.col("role").alias("heading"), sentences.alias("sentences")).alias("s"))
    docs = s.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("sections")).withColumn("title", F.lit("conversation")).withColumn("topics", F.array().cast("array<string>"))
    return ingest.chunks(docs).select("document_id", "section", "line_start", "line_end", "content_hash")


@query("""WITH x AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 4 <> 0 AS o, o_orderkey % 5 <> 0 AS n, o_orderkey % 7 + 2 AS a, o_orderkey % 7 + 2 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS b, o_orderkey % 3 = 1 AS w FROM orders),
s AS (SELECT c, k, n, CASE WHEN NOT o AND NOT n THEN NULL WHEN NOT o THEN 'S' || k || ': added' WHEN NOT n THEN 'S' || k || ': removed' WHEN a <> b THEN 'S' || k || ': ' || a || ' days → ' || b || ' days' WHEN w THEN 'S' || k || ': wording changed' END AS said FROM x),
g AS (SELECT c, string_agg(said, '; ' ORDER BY NOT n, k) AS summary FROM s WHERE said IS NOT NULL GROUP BY 1)
SELECT DISTINCT x.c AS document_id, coalesce(summary, 'content changed') AS summary FROM x LEFT JOIN g ON x.c = g.c WHERE x.n""")
def change_summaries(spark, d):
    """What changed between two versions, section by section."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), k, F.concat(F.lit("S"), k).alias("section"), k.alias("pos"))
    old = o.withColumn("text", F.concat(F.lit("It takes "), k % 7 + 2, F.lit(" days.")))
    days = k % 7 + 2 + F.when(k % 3 == 0, 1).otherwise(0)
    new = o.withColumn("text", F.concat(F.when(k % 3 == 1, "Now it takes ").otherwise("It takes "), days, F.lit(" days.")))
    return ingest.change_summary(old.where("o_orderkey % 4 <> 0"), new.where("o_orderkey % 5 <> 0")).select("document_id", "summary")


@query("""SELECT c_custkey AS document_id, coalesce(max(o_orderkey % 10), 0)::BIGINT + 1 AS version_no FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def version_numbers(spark, d):
    """U8: the next version of each document."""
    changed = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("body"), F.sha1("c_name").alias("content_hash"), F.col("c_nationkey").alias("owner_id"))
    versions = _t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 10).alias("version_no"))
    return ingest.next_versions(changed, versions).select("document_id", F.col("version_no").cast("long").alias("version_no"))


@query("""SELECT o_orderkey AS id, CASE WHEN b.id IS NULL THEN o_orderstatus ELSE 'x' || o_orderstatus END AS content FROM orders LEFT JOIN (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0) b ON o_orderkey = b.id
UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0""")
def snapshot_merge(spark, d):
    """The snapshot after a batch of new and changed documents."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"))
    with_hash = lambda x: x.withColumn("content_hash", F.sha1("content"))
    batch = o.where("id % 3 = 0").withColumn("content", F.concat(F.lit("x"), "content")).unionByName(o.where("id % 7 = 0").withColumn("id", -1 - F.col("id")))
    return ingest.apply(with_hash(batch), with_hash(o).withColumn("status", F.lit("active"))).select("id", "content")


@query("""SELECT o_orderkey, o_custkey AS owner_id, CASE WHEN o_orderkey % 3 = 0 THEN c.c_custkey ELSE o_custkey END AS author_id FROM orders LEFT JOIN customer c ON o_orderkey % 3 = 0 AND c.c_custkey = o_orderkey % 100 + 1""")
def owner_lookup(spark, d):
    """Owners and authors by e-mail."""
    k = F.col("o_orderkey")
    mail = lambda key: F.format_string("C%s@Example.com", key.cast("string"))
    batch = _t(spark, d, "orders").select(k, mail(F.col("o_custkey")).alias("owner_email"), F.when(k % 3 == 0, mail(k % 100 + 1)).otherwise("?").alias("author_email"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lower(mail(F.col("c_custkey"))).alias("email"))
    return ingest.enrich(batch, people).select("o_orderkey", "owner_id", "author_id")


@query("""WITH e AS (SELECT l_suppkey AS person_id, CASE l_linenumber % 4 WHEN 0 THEN 'owns' WHEN 1 THEN 'attended' WHEN 2 THEN 'edited' ELSE 'reviewed' END AS rel, l_orderkey AS document_id FROM lineitem),
n AS (SELECT o_orderkey, o_custkey, o_custkey % 5 AS g FROM orders WHERE o_orderkey % 2 = 0)
SELECT person_id, rel, document_id FROM e WHERE NOT (rel IN ('owns', 'attended') AND document_id IN (SELECT o_orderkey FROM n))
UNION ALL SELECT o_custkey, 'owns', o_orderkey FROM n UNION ALL SELECT g, 'authored', o_orderkey FROM n UNION ALL SELECT x, 'attended', o_orderkey FROM (SELECT DISTINCT o_orderkey, o_custkey, unnest([g, g + 1, o_custkey]) AS x FROM n) WHERE x <> o_custkey""")
def edge_replacement(spark, d):
    """The edges of documents that were written again."""
    rel = F.element_at(F.array(*map(F.lit, ("owns", "attended", "edited", "reviewed"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    edges = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), rel.alias("rel"), F.col("l_orderkey").alias("document_id"))
    g = F.col("o_custkey") % 5
    docs = _t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), g.alias("author_id"), F.array(g, g + 1, F.col("o_custkey")).alias("attendee_ids"))
    return ingest.replace_edges(edges, docs)


_TASK = """k AS (SELECT o_orderkey AS document_id, CASE o_orderkey % 3 WHEN 0 THEN 'request_update' WHEN 1 THEN 'confirm_valid' ELSE 'reassign_owner' END AS kind, o_orderkey % 4 = 0 AS done, o_custkey AS assignee_id, o_orderdate::DATE AS created_at FROM orders)"""


def _tasks(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "request_update").when(k % 3 == 1, "confirm_valid").otherwise("reassign_owner")
    return _t(spark, d, "orders").select(k.alias("document_id"), kind.alias("kind"), (k % 4 == 0).alias("done"), F.col("o_custkey").alias("assignee_id"), F.to_date("o_orderdate").alias("created_at"))


def _updates(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k.alias("id"), F.when(k % 2 == 0, "updated").otherwise("unchanged").alias("change"), F.when(k % 5 != 0, F.col("o_custkey")).alias("owner_id"))


@query(f"WITH {_TASK} SELECT document_id, kind, done OR (document_id % 2 = 0 AND document_id % 5 <> 0 AND kind <> 'reassign_owner') AS done FROM k")
def task_closing(spark, d):
    """Requests that an update settles."""
    return lifecycle.close_tasks(_tasks(spark, d), _updates(spark, d)).select("document_id", "kind", "done")


@query("SELECT o_custkey AS person_id, 'edited' AS rel, o_orderkey AS document_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0")
def edited_edges(spark, d):
    """Edges that updates leave."""
    return ingest.edited(_updates(spark, d), "2001-12-31").select("person_id", "rel", "document_id")


@query("SELECT event_type AS connector, max(ts)::DATE AS since FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def delta_mark(spark, d):
    """From where the next delta sync reads."""
    runs = _t(spark, d, "events").select(F.col("event_type").alias("connector"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("finished_at"))
    return lifecycle.high_water(runs)


@query("""WITH r AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1), h AS (SELECT event_type, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY 1)
SELECT r.event_type AS connector, r.event_id AS run_id, coalesce(n, 0) AS documents FROM r LEFT JOIN h USING (event_type)""")
def connector_status(spark, d):
    """The latest run of each connector and what it holds."""
    e = _t(spark, d, "events").withColumnRenamed("event_type", "connector")
    docs = e.select("connector", F.when(F.col("user_id") % 3 == 0, "retracted").otherwise("active").alias("status"))
    return lifecycle.sync_status(e.select("connector", F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at")), docs).select("connector", "run_id", "documents")


@query(r"""WITH s AS (SELECT item_id, 'When is ' || text || CASE item_id % 3 WHEN 0 THEN ', and what applies and who owns it?' WHEN 1 THEN '? Where is it?' ELSE '' END AS q FROM benchmark),
x AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(q, '(?i)[,;]? and (which|what|how|who|where|when|is|are|does|do)\b', chr(1) || '\1', 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '') AS a, list_filter(list_transform(string_split(q, '?'), lambda y: trim(y)), lambda y: y <> '') AS b FROM s)
SELECT item_id, array_to_string(CASE WHEN len(a) = 1 AND len(b) > 1 THEN b ELSE a END, ' | ') AS parts FROM x""")
def question_parts(spark, d):
    """Q6: questions of several parts."""
    k = F.col("item_id")
    q = F.concat(F.lit("When is "), "text", F.when(k % 3 == 0, ", and what applies and who owns it?").when(k % 3 == 1, "? Where is it?").otherwise(""))
    return _t(spark, d, "benchmark").withColumn("q", q).select("item_id", F.array_join(understand.parts(F.col("q")), " | ").alias("parts"))


@query("""SELECT p_partkey, array_to_string(list_slice(list_filter([p_type || ' a', p_type || ' b', p_brand, CASE WHEN p_size % 3 <> 0 THEN p_name END], lambda x: x IS NOT NULL), 1, 4), ' | ') AS rewrites FROM part WHERE p_size % 2 = 0
UNION ALL SELECT p_partkey, p_type || ' a | ' || p_type || ' b | ' || p_brand || ' | ' || p_brand || ' c' FROM part WHERE p_size % 2 = 1""")
def question_rewrites(spark, d):
    """Q7: at most four rewrites of a question."""
    first = F.array(*(F.concat("p_type", F.lit(x)) for x in (" a", " b", " c")))
    second = F.when(F.col("p_size") % 2 == 0, F.array("p_brand")).otherwise(F.array(F.col("p_brand"), F.concat("p_brand", F.lit(" c"))))
    found = understand.rewrites(F.array(first, second, F.array(F.lit("never"))), F.when(F.col("p_size") % 3 != 0, F.col("p_name")))
    return _t(spark, d, "part").select("p_partkey", F.array_join(found, " | ").alias("rewrites"))


@query("""WITH r AS (SELECT o_custkey, nullif(o_orderstatus, 'P') AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 7919 % 1000 DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey AS question_id, CASE WHEN count(DISTINCT c) = 1 THEN max(CASE WHEN r = 1 THEN c END) END AS country FROM r WHERE r <= 3 GROUP BY 1""")
def country_inference(spark, d):
    """Q8: a country on which the best candidates agree."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") * 7919 % 1000).alias("relevance"), F.nullif("o_orderstatus", F.lit("P")).alias("country"))
    return understand.inferred_country(o)


@query("""SELECT o_orderkey, round(least(1.0, 0.45 * least(1.0, greatest(0.0, (greatest(0.0, (o_orderkey % 97) / 97.0::DOUBLE) - 0.45) / 0.4)) + 0.35 * ((o_orderkey % 89) / 89.0::DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.15 ELSE 0 END), 3) AS relevance FROM orders""")
def relevance_scores(spark, d):
    """Relevance from similarity, words, topic and intent."""
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k, trust.relevance(v.rescale((k % 97) / 97), (k % 89) / 89, k % 2 == 0, F.when(k % 3 == 0, 0.15).otherwise(0.0)).alias("relevance"))


@query("""SELECT o_orderkey, round(least(1.0, 0.3 + 0.7 * (o_orderkey % 83) / 83.0::DOUBLE), 6) AS authority, round(0.5 * least(1.0, (o_orderkey % 97) / 97.0::DOUBLE / 0.8) + 0.5 * ((o_orderkey % 89) / 89.0::DOUBLE), 2) AS confidence FROM orders""")
def authority_confidence(spark, d):
    """Authority from reputation, confidence from relevance and trust."""
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(k, F.round(trust.authority((k % 83) / 83), 6).alias("authority"), trust.confidence((k % 97) / 97, (k % 89) / 89).alias("confidence"))


@query("""WITH e AS (SELECT o_custkey AS p, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'owns' WHEN 'O' THEN 'edited' ELSE 'seen' END AS rel, o_orderkey % 200 + 1 AS doc, o_orderkey % 5 AS topic, o_orderkey % 4 = 0 AS on_topic,
CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS country, CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 1.5 ELSE 0.5 END * pow(0.5, date_diff('day', o_orderdate::DATE, DATE '2001-12-31') / 365.0::DOUBLE) AS b FROM orders),
x AS (SELECT p, rel, b * CASE WHEN country IS NULL OR p_size % 3 = 2 OR country = CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END THEN 1.0 ELSE 0.3 END * CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 0.5 END AS w FROM e JOIN part ON doc = p_partkey AND topic = p_partkey % 3 WHERE NOT on_topic
UNION ALL SELECT p, rel, b FROM e WHERE on_topic AND topic < 3)
SELECT p AS person_id, rel, count(*) AS n, round(sum(w), 6) AS weight FROM x GROUP BY 1, 2""")
def edge_weights(spark, d):
    """Weights of edges to documents and topics."""
    k = F.col("o_orderkey")
    country = lambda c: F.when(c % 3 == 0, "A").when(c % 3 == 1, "B")
    on_topic = k % 4 == 0
    # topic edges name the topic itself where it is below 3, and another one else
    dst = F.when(on_topic, F.when(k % 5 < 3, F.concat(F.lit("t"), k % 5)).otherwise("none")).otherwise((k % 200 + 1).cast("string"))
    edges = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") == "F", "owns").when(F.col("o_orderstatus") == "O", "edited").otherwise("seen").alias("rel"),
        F.when(on_topic, "topic").otherwise("doc").alias("dst_kind"), dst.alias("dst_id"), F.to_date("o_orderdate").alias("at"), F.array(F.concat(F.lit("t"), k % 5)).alias("topics"), country(k).alias("country"),
    )
    p = F.col("p_partkey")
    docs = _t(spark, d, "part").select(p.cast("string").alias("id"), F.array(F.concat(F.lit("t"), p % 3)).alias("topics"), country(F.col("p_size")).alias("country"), F.when(p % 2 == 0, "policy").otherwise("chat").alias("doc_type"))
    return reputation.weigh(edges, docs, "2001-12-31").groupBy("person_id", "rel").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("weight"))


_CAND = """c AS (SELECT o_custkey AS sub_id, o_orderkey AS chunk_id, o_orderkey % 3 AS doc_id, (o_orderkey * 7919 % 997) / 997.0::DOUBLE AS relevance, (o_orderkey * 31 % 991) / 991.0::DOUBLE AS trust, o_orderkey % 2 AS owner,
CASE o_orderkey % 5 WHEN 0 THEN 0.5 ELSE 0.9 END AS channel, o_orderkey % 7 = 0 AS official, o_orderdate::DATE AS updated_at, o_orderstatus <> 'P' AS on_topic, o_orderkey % 11 <> 0 AS asserts FROM orders)"""


def _candidates(spark, d):
    k = F.col("o_orderkey")
    return _t(spark, d, "orders").select(
        F.col("o_custkey").alias("sub_id"), k.alias("chunk_id"), (k % 3).alias("doc_id"), (k * 7919 % 997 / 997).alias("relevance"), (k * 31 % 991 / 991).alias("trust"), (k % 2).alias("owner"),
        F.when(k % 5 == 0, 0.5).otherwise(0.9).alias("channel"), (k % 7 == 0).alias("official"), F.to_date("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") != "P").alias("on_topic"), (k % 11 != 0).alias("asserts"),
    )


@query(f"WITH {_CAND} SELECT sub_id, doc_id, chunk_id FROM c QUALIFY row_number() OVER (PARTITION BY sub_id, doc_id ORDER BY relevance DESC, chunk_id) = 1")
def best_per_document(spark, d):
    """The most relevant passage of each document."""
    return analyse.best_per_document(_candidates(spark, d)).select("sub_id", "doc_id", "chunk_id")


@query(f"WITH {_CAND} SELECT sub_id, chunk_id FROM c WHERE on_topic AND asserts AND relevance >= 0.5 AND trust >= 0.35")
def strong_candidates(spark, d):
    """K2: passages that can answer."""
    return answer.strong(_candidates(spark, d)).select("sub_id", "chunk_id")


@query(f"""WITH {_CAND}, s AS (SELECT *, 0.5 * relevance + 0.5 * trust AS score FROM c), f AS (SELECT *, relevance >= greatest(0.5, first_value(relevance) OVER (PARTITION BY sub_id ORDER BY score DESC, chunk_id) - 0.35) AND owner = 1 AND channel >= 0.75 AS fit FROM s)
SELECT sub_id, chunk_id FROM f QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY fit DESC, CASE WHEN fit THEN official END DESC NULLS LAST, CASE WHEN fit THEN updated_at END DESC NULLS LAST, CASE WHEN fit THEN trust END DESC NULLS LAST, score DESC, chunk_id) = 1""")
def primary_passage(spark, d):
    """K3: the passage that leads each part of an answer."""
    c = _candidates(spark, d).withColumn("score", 0.5 * F.col("relevance") + 0.5 * F.col("trust"))
    return answer.primary(c).select("sub_id", "chunk_id")


@query("SELECT l_orderkey AS question_id, string_agg('Line ' || l_linenumber || ': part ' || l_partkey, chr(10) ORDER BY l_linenumber, 'Line ' || l_linenumber || ': part ' || l_partkey) AS answer FROM lineitem GROUP BY 1")
def answer_text(spark, d):
    """Answers as plain text."""
    rows = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("Line "), "l_linenumber", F.lit(": part "), "l_partkey").alias("text"))
    return answer.render(rows)


@query(f"WITH {_TASK} SELECT document_id, kind, 'order ' || document_id AS title, c_name AS assignee, created_at FROM k LEFT JOIN customer ON assignee_id = c_custkey WHERE NOT done")
def open_task_list(spark, d):
    """Tasks that are open."""
    docs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), "o_orderkey").alias("title"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return lifecycle.open_tasks(_tasks(spark, d), docs, people).select("document_id", "kind", "title", "assignee", "created_at")


@query(f"""WITH {_TASK}, p AS (SELECT o_orderkey AS id, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS older FROM orders), n AS (SELECT older AS id, min(id) AS successor FROM p WHERE older IS NOT NULL GROUP BY 1),
l AS (SELECT l_orderkey AS id, string_agg(l_linenumber, ',' ORDER BY l_linenumber DESC) AS versions FROM lineitem GROUP BY 1)
SELECT p.id, o.c_name AS owner, a.c_name AS author, successor, versions, (CASE WHEN done THEN 0 ELSE 1 END)::BIGINT AS open_tasks, 2::BIGINT AS n_lines FROM p LEFT JOIN customer o ON p.o_custkey = o.c_custkey LEFT JOIN customer a ON a.c_custkey = p.id % 100 LEFT JOIN n ON p.id = n.id LEFT JOIN l ON p.id = l.id JOIN k ON k.document_id = p.id""")
def document_detail(spark, d):
    """Documents with people, successor, versions and tasks."""
    o = _t(spark, d, "orders")
    older = F.expr("lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    docs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), (F.col("o_orderkey") % 100).alias("author_id"), older.alias("supersedes_id"), F.concat_ws("\n", "o_orderstatus", "o_orderpriority").alias("body"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    versions = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version_no"))
    out = lifecycle.detail(docs, people, versions, _tasks(spark, d))
    return out.select("id", "owner", "author", "successor", F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"), "open_tasks", F.size("lines").cast("long").alias("n_lines"))


@query(r"""WITH s AS (SELECT page_id, 'web-' || trim(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), '-') AS w, url FROM pages) SELECT page_id, CASE WHEN length(w) <= 40 THEN w ELSE left(w, 31) || '-' || left(sha1(url), 8) END AS id FROM s""")
def document_ids(spark, d):
    """Ids from the ids of sources."""
    return _t(spark, d, "pages").select("page_id", t.slug("web-", F.col("url")).alias("id"))


@query("""WITH o AS (SELECT doc_id, sha1(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, sha1(CASE WHEN doc_id % 4 = 0 THEN text || '.' ELSE text END) AS h FROM documents)
SELECT n.doc_id AS document_id, CASE WHEN o.h IS NULL THEN 'new' ELSE 'old' END AS embedding FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.h = o.h""")
def embedding_reuse(spark, d):
    """Only changed passages are embedded again."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    new = docs.withColumn("text", F.when(F.col("document_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).withColumn("content_hash", F.sha1("text"))
    old = docs.where("document_id % 3 <> 0").select("document_id", F.sha1("text").alias("content_hash"), F.lit("old").alias("embedding"))
    return ingest.embeddings(new, old, lambda text: F.lit("new")).select("document_id", "embedding")


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_event_windows(spark, d):
    """Windows of a day over a stream of events."""
    return _t(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query()
def passage_rank(spark, d):
    """The dozen best passages of each whole benchmark item, taken as a search, among all documents, by cover density (tested against plain loops)."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    ranks = search.ranked(items, cut(search.postings(docs, wanted=search.terms(items))), docs).select("question_id", "passage_id", F.round("rank", 6).alias("density"))
    return retrieve.top(ranks, ["question_id"], [F.desc("density"), "passage_id"], 12).select("question_id", "passage_id", F.col("density").alias("rank"))


# Fixed kinds of searches: both words, a phrase or a word, a word without another, a word or a phrase without a third.
_SEARCHES = """CASE item_id % 4 WHEN 0 THEN w[1] || ' ' || w[2] WHEN 1 THEN '"' || w[1] || ' ' || w[2] || '" OR ' || w[3] WHEN 2 THEN w[1] || ' -' || w[2] ELSE w[1] || '-' || w[2] || ' or "' || w[3] || ' ' || w[4] || '" -' || w[5] END"""
_SAID = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda z: z <> 'or')"


@query(f"""WITH q AS (SELECT item_id, {_SAID} AS w FROM benchmark), p AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))
SELECT item_id AS question_id, doc_id AS passage_id FROM q, p WHERE CASE item_id % 4 WHEN 0 THEN list_contains(p.w, q.w[1]) AND list_contains(p.w, q.w[2]) WHEN 1 THEN contains(t, ' ' || q.w[1] || ' ' || q.w[2] || ' ') OR list_contains(p.w, q.w[3])
WHEN 2 THEN list_contains(p.w, q.w[1]) AND NOT list_contains(p.w, q.w[2]) ELSE contains(t, ' ' || q.w[1] || ' ' || q.w[2] || ' ') OR (contains(t, ' ' || q.w[3] || ' ' || q.w[4] || ' ') AND NOT list_contains(p.w, q.w[5])) END""")
def boolean_search(spark, d):
    """R2: searches with phrases, alternatives and exclusions over all documents."""
    said = F.filter(fulltext.words(F.col("text")), lambda z: z != "or")
    w = lambda i: F.get("w", F.lit(i - 1))
    k, quote = F.col("item_id") % 4, F.lit('"')
    asked = F.when(k == 0, F.concat_ws(" ", w(1), w(2))).when(k == 1, F.concat(quote, w(1), F.lit(" "), w(2), quote, F.lit(" OR "), w(3))).when(k == 2, F.concat(w(1), F.lit(" -"), w(2)))
    asked = asked.otherwise(F.concat(w(1), F.lit("-"), w(2), F.lit(" or "), quote, w(3), F.lit(" "), w(4), quote, F.lit(" -"), w(5)))
    searches = _t(spark, d, "benchmark").select("item_id", said.alias("w")).select(F.col("item_id").alias("question_id"), asked.alias("text"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    asked = cut(search.terms(searches, fulltext.simple))
    found = search.matches(asked, cut(search.postings(docs, fulltext.simple, asked)), docs)
    return found.select("question_id", "passage_id").distinct()


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' seen again' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS stem FROM d)
SELECT stem, count(DISTINCT doc_id) AS df, count(*) AS n FROM w GROUP BY stem""")
def kept_index(spark, d):
    """R2: a kept index after batches that add, rewrite and remove passages, with a merge between: how many passages hold each word, and how often."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")
    folder, k = f"{scratch_folder(spark)}/{uuid.uuid4().hex}", F.col("passage_id")
    batches = [(docs.where(k % 3 != 0), None), (docs.where(k % 3 == 0), None), (docs.where(k % 5 == 0).withColumn("text", F.concat("text", F.lit(" seen again"))), docs.where(k % 7 == 0).where(k % 5 != 0)), (docs.limit(0), docs.where(k % 35 == 0))]
    for n, (changed, gone) in enumerate(batches):
        search_index.update(spark, folder, n, changed, gone, fulltext.simple, merge=2)
    rows = search_index.postings(spark, folder, len(batches), merge=2)
    return rows.groupBy("stem").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("n"))
