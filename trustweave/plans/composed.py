"""Queries that run composed operators from end to end over the shared tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as t
from ..functions import vectors as v
from ..operators import analyse, answer, ask, cells, ingest, lifecycle, phrases, reputation, retrieve, standing, trust, understand
from ..scratch import cut as scratch_cut
from ..scratch import folder as scratch_folder
from ..sources import connectors
from .extended import _CAND, _candidates
from .queries import _CONTENT, _LINES, AS_OF, _calls, _t, query

_ASK = """CASE item_id % 8 WHEN 0 THEN 'Who owns item ' WHEN 1 THEN 'How do I set up item ' WHEN 2 THEN 'What did we decide on item ' WHEN 3 THEN 'Is there a ticket on item ' WHEN 4 THEN 'What is item '
WHEN 5 THEN 'Undecided, unchanged: item ' WHEN 6 THEN 'Which Belgian item is ' ELSE 'Item ' END || item_id"""


@query("SELECT item_id AS id, CASE item_id % 8 WHEN 0 THEN 'contact' WHEN 1 THEN 'procedure' WHEN 2 THEN 'decision' WHEN 3 THEN 'status' ELSE 'rule' END AS code FROM benchmark")
def question_intent(spark, d):
    """Q5: what kind of answer a question wants, a rule where nothing tells."""
    return understand.intent(_t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.expr(_ASK).alias("text")))


_PLACE = """CASE item_id % 8 WHEN 0 THEN 'Holiday pay at Acme Foods in France?' WHEN 1 THEN 'What does joan doe earn?' WHEN 2 THEN 'Rules in the Dutch office, not Germany' WHEN 3 THEN 'Rules for a germanyish office' WHEN 4 THEN 'acmes and bolt, please'
WHEN 5 THEN 'UK or British rules' ELSE 'Any rule' END"""


@query("""SELECT item_id AS question_id, CASE item_id % 8 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Bolt' WHEN 4 THEN 'Bolt' END AS client, CASE item_id % 8 WHEN 0 THEN 'BE' WHEN 1 THEN 'DE' WHEN 2 THEN 'NL' WHEN 4 THEN 'DE' WHEN 5 THEN 'UK' ELSE CASE WHEN item_id % 3 = 0 THEN 'FR' END END AS country,
CASE item_id % 8 WHEN 0 THEN 'client Acme is a Belgium account' WHEN 1 THEN 'Joan Doe is an employee of client Bolt (Germany), per the HR system' WHEN 2 THEN 'mentioned in the question' WHEN 4 THEN 'client Bolt is a Germany account' WHEN 5 THEN 'mentioned in the question'
ELSE CASE WHEN item_id % 3 = 0 THEN 'inferred from your profile (Kim)' END END AS country_source FROM benchmark""")
def question_context(spark, d):
    """Q3: client and country of a question: named client, employee's client, country word, profile."""
    k = F.col("item_id")
    q = _t(spark, d, "benchmark").select(k.alias("question_id"), F.expr(_PLACE).alias("question"), F.when(k % 3 == 0, "FR").alias("profile_country"), F.lit("Kim").alias("profile_name"))
    clients = [(1, "Acme", "BE"), (2, "Bolt", "DE"), (3, "Acme Foods", "NL")]
    return understand.context(q, clients, [(1, "joan doe", "Bolt"), (2, "doe", "Acme")]).select("question_id", "client", "country", "country_source")


_BOUND = [(1, "north", "the"), (2, "south", "on"), (3, "east", "in"), (4, "east", "for"), (5, "west", "la"), (6, "west", "und"), (7, "south", "de")]
_BOUND_SQL = ", ".join(f"({p}, '{c}', '{k}')" for p, c, k in _BOUND)


@query(f"""WITH r(priority, code, keyword) AS (VALUES {_BOUND_SQL}),
h AS (SELECT doc_id, code, count(*) AS hits, min(priority) AS p FROM documents, r WHERE regexp_matches(lower(text), '(^|[^a-z])' || keyword || '([^a-z]|$)') GROUP BY 1, 2)
SELECT doc_id AS id, code, hits FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, p) = 1""")
def team_by_phrase(spark, d):
    """Q4: code with most keywords between non-letters, the first of equals."""
    return understand.most_hits(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _BOUND, bounded=True)


@query(r"""WITH r AS (SELECT DISTINCT keyword FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS keyword FROM benchmark)),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS keyword FROM documents)
SELECT doc_id AS id, count(*) AS met, min(keyword) AS first FROM d JOIN r USING (keyword) GROUP BY 1""")
def many_phrases(spark, d):
    """Q1/Q2/Q4 for large rule tables: every word of the benchmark as a phrase, looked for in all documents by automata."""
    keyword = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("keyword")
    table = _t(spark, d, "benchmark").select(keyword).distinct().select(F.lit(1).alias("priority"), F.lit("word").alias("code"), "keyword")
    found = phrases.met(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table)
    return found.groupBy("id").agg(F.count("*").alias("met"), F.min("keyword").alias("first"))


@query()
def near_cells(spark, d):
    """V5: the nearest chunks of every hundredth one, looked for in the cells of an index over all of them (tested for recall against ``knn``)."""
    chunks = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    made = cells.fit(chunks)
    asked = chunks.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return cells.search(asked, cells.build(chunks, made), made).select("query_id", "chunk_id", "sim", F.col("rank").cast("long").alias("rank"))


_NEAR = """q AS (SELECT vec_id - vec_id % 100 AS sub_id, vec_id % 100 AS query_no, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 < 2),
e AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS x, label FROM embeddings WHERE vec_id % 5 NOT IN (1, 3)),
a AS (SELECT sub_id, query_no, chunk_id, round(list_dot_product(v, x) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(x, x))), 6) AS sim,
 CASE WHEN chunk_id % 50 = 7 * query_no AND label = (sub_id // 100) % 4 THEN round(1 / (1.0::DOUBLE + abs(chunk_id - sub_id) % 97), 6) END AS words FROM q, e),
n AS (SELECT *, row_number() OVER (PARTITION BY sub_id, query_no ORDER BY sim DESC, chunk_id) AS place FROM a),
c AS (SELECT sub_id, query_no, chunk_id, sim, coalesce(words, 0) AS fts FROM n WHERE place <= 15 OR words IS NOT NULL),
f AS (SELECT *, CASE WHEN query_no = 0 THEN 1.0 ELSE 0.6 END::DOUBLE AS wt, row_number() OVER (PARTITION BY sub_id, query_no ORDER BY sim DESC NULLS LAST, chunk_id) - 1 AS rs, row_number() OVER (PARTITION BY sub_id, query_no ORDER BY fts DESC NULLS LAST, chunk_id) - 1 AS rf FROM c),
r AS (SELECT sub_id, chunk_id, round(sum(wt / (20 + rs) + CASE WHEN fts > 0 THEN wt / (20 + rf) ELSE 0 END), 9) AS rrf, max(sim) AS sim FROM f GROUP BY 1, 2)"""


def _found(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    queries = e.where("chunk_id % 100 < 2").select(F.col("chunk_id").alias("query_id"), "vector")
    k, q = F.col("chunk_id"), F.col("query_id")
    sub = q - q % 100
    asked = queries.select("query_id", (7 * (q % 100)).alias("r"), (F.floor(q / 100) % 4).alias("label"))
    ranked = e.withColumn("r", k % 50).join(asked, ["r", "label"]).select("query_id", "chunk_id", F.round(1 / (1 + F.abs(k - sub) % 97), 6).alias("fts"))
    status = F.when(k % 5 == 1, "archived").when(k % 5 == 3, "retracted").when(k % 5 == 2, "needs_update").otherwise("active")
    docs = e.select(k.alias("document_id"), status.alias("status"))
    found = retrieve.candidates(queries, e.select("chunk_id", k.alias("document_id"), "vector"), docs, ranked)
    return retrieve.reciprocal(found.select(sub.alias("sub_id"), (q % 100).alias("query_no"), "chunk_id", "sim", "fts"))


@query(f"WITH {_NEAR} SELECT sub_id, chunk_id, rrf, sim FROM r")
def candidate_scan(spark, d):
    """Candidates of questions and their rewrites by words or nearness, in active documents, fused."""
    return _found(spark, d)


@query(f"""WITH {_NEAR}, x AS (SELECT r.*, sub_id // 100 % 5 AS it, CASE chunk_id % 6 WHEN 0 THEN 'policy' WHEN 1 THEN 'procedure' WHEN 2 THEN 'wiki' WHEN 3 THEN 'meeting' WHEN 4 THEN 'ticket' ELSE 'chat' END AS dt,
 chunk_id % 7 = 0 AS decided, chunk_id % 7 = 1 AS steps, chunk_id % 7 = 2 OR chunk_id % 11 = 0 AS person, (chunk_id * 31 % 97) / 97.0::DOUBLE AS lex, chunk_id % 4 = 0 AND sub_id % 300 = 0 AS shared, chunk_id % 3 = 0 AS on_topic FROM r),
y AS (SELECT *, CASE it WHEN 0 THEN 'contact' WHEN 1 THEN 'procedure' WHEN 2 THEN 'decision' WHEN 3 THEN 'status' ELSE 'rule' END AS intent FROM x),
z AS (SELECT *, CASE WHEN (intent = 'contact' AND dt IN ('procedure', 'wiki', 'policy')) OR (intent = 'procedure' AND dt IN ('procedure', 'wiki')) OR (intent = 'decision' AND dt IN ('meeting', 'chat')) OR (intent = 'status' AND dt IN ('ticket', 'chat')) OR (intent = 'rule' AND dt IN ('policy', 'wiki')) THEN 0.05::DOUBLE ELSE 0 END
 + CASE WHEN intent = 'decision' AND decided THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN intent = 'procedure' AND (steps OR dt = 'procedure') THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN intent = 'contact' AND person THEN 0.2::DOUBLE ELSE 0 END AS boost FROM y),
s AS (SELECT sub_id, chunk_id, rrf, round(least(1.0, 0.45::DOUBLE * least(1.0, greatest(0.0, (greatest(0.0, sim) - 0.45::DOUBLE) / 0.4::DOUBLE)) + 0.35::DOUBLE * CASE WHEN shared THEN least(1.0, lex + 0.4::DOUBLE) ELSE lex END + CASE WHEN on_topic THEN 0.2 ELSE 0 END::DOUBLE + boost::DOUBLE), 3) AS relevance FROM z)
SELECT sub_id, chunk_id, relevance, row_number() OVER (PARTITION BY sub_id ORDER BY relevance DESC, rrf DESC, chunk_id) AS rank FROM s QUALIFY rank <= 12""")
def retrieved(spark, d):
    """The dozen most relevant candidates of each question, with key facts and intents counted."""
    k, sub = F.col("chunk_id"), F.col("sub_id")
    kinds = F.array(*map(F.lit, ("policy", "procedure", "wiki", "meeting", "ticket", "chat")))
    intents = F.array(*map(F.lit, ("contact", "procedure", "decision", "status", "rule")))
    section = F.when(k % 7 == 0, "Decisions").when(k % 7 == 1, "Next steps").when(k % 7 == 2, "Contact").otherwise("Rules")
    text = F.when((k % 11 == 0) & (k % 4 == 0), "Go to Kim; runs are free of charge.").when(k % 11 == 0, "Go to Kim.").when(k % 4 == 0, "Runs are free of charge.").otherwise("Nothing.")
    asked = F.when(sub % 300 == 0, "Is a run charged?").otherwise("What then?")
    rows = _found(spark, d).withColumn("intent", F.get(intents, (F.floor(sub / 100) % 5).cast("int"))).withColumn("doc_type", F.get(kinds, (k % 6).cast("int")))
    rows = rows.withColumn("section", section).withColumn("text", text).withColumn("lex", (k * 31 % 97) / 97)
    lex = retrieve.key_boost(F.col("lex"), t.fact_keys(asked), t.fact_keys(F.col("text")))
    boost = retrieve.intent_boost(F.col("intent"), F.col("doc_type"), F.col("section"), F.col("text"))
    rows = rows.withColumn("relevance", trust.relevance(v.rescale(F.col("sim")), lex, k % 3 == 0, boost))
    return retrieve.pooled(rows).select("sub_id", "chunk_id", "relevance", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH x AS (SELECT p_partkey, {_CONTENT.format("p_name || ' of the ' || p_type")} AS q, {_CONTENT.format("p_brand || ' ' || p_type || ' ' || p_name || ' x'")} AS c, {_CONTENT.format("p_type")} AS k FROM part)
SELECT p_partkey, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, CASE WHEN p_partkey % 2 = 0 THEN c ELSE k END)) / len(q)::DOUBLE ELSE 0 END, 6) AS overlap FROM x""")
def passage_overlap(spark, d):
    """Share of a question's words in the section, text and title of a passage."""
    even = F.col("p_partkey") % 2 == 0
    at = lambda c: F.when(even, F.col(c))
    share = retrieve.overlap(F.concat("p_name", F.lit(" of the "), "p_type"), at("p_brand"), F.when(even, F.concat("p_type", F.lit(" x"))).otherwise(F.col("p_type")), at("p_name"))
    return _t(spark, d, "part").select("p_partkey", F.round(share, 6).alias("overlap"))


_KIND2 = "CASE o_orderkey % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'chat' WHEN 2 THEN 'meeting' ELSE 'report' END"


@query(f"""WITH x AS (SELECT o_orderkey AS k, o_custkey AS c, {_KIND2} AS dt, CASE o_custkey % 3 WHEN 0 THEN 'BE' WHEN 1 THEN 'NL' END AS country, CASE WHEN o_custkey % 2 = 0 THEN 'BE' END AS asked, o_orderkey % 9 = 0 AS same, o_orderdate::DATE AS u, CASE WHEN o_orderkey % 8 = 0 THEN o_orderdate::DATE + 90 END AS vd,
 o_orderkey % 5 <> 0 AS known, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS older, o_orderkey % 3 <> 0 AS owned, o_orderkey % 7 <> 0 AS written, o_orderkey % 6 AS who FROM orders),
y AS (SELECT x.*, p.alive AS oa, a.alive AS aa, k IN (SELECT older FROM x WHERE older IS NOT NULL) AS gone, date_diff('day', greatest(u, coalesce(vd, u)), DATE '2001-12-31') AS age, CASE dt WHEN 'policy' THEN 720 WHEN 'chat' THEN 90 WHEN 'meeting' THEN 180 ELSE 365 END AS hl, CASE dt WHEN 'policy' THEN 864 WHEN 'chat' THEN 108 WHEN 'meeting' THEN 216 ELSE 365 END AS period
 FROM x LEFT JOIN (SELECT c_custkey, c_acctbal >= 0 AS alive FROM customer) p ON owned AND p.c_custkey = x.c LEFT JOIN (SELECT c_custkey, c_acctbal >= 0 AS alive FROM customer) a ON written AND a.c_custkey = who),
z AS (SELECT *, CASE WHEN known THEN pow(0.5, age / hl::DOUBLE) ELSE 0.2 END::DOUBLE AS f, CASE WHEN oa THEN 1.0 WHEN oa IS NOT NULL THEN 0.35 WHEN aa THEN 0.55 ELSE 0.15 END::DOUBLE AS o, CASE dt WHEN 'policy' THEN 1.0 WHEN 'chat' THEN 0.5 WHEN 'meeting' THEN 0.75 ELSE 0.6 END::DOUBLE AS ch,
 CASE WHEN country IS NULL THEN 0.8 WHEN asked IS NULL THEN 0.7 WHEN country = asked THEN 1.0 ELSE 0 END::DOUBLE AS sc, CASE WHEN gone THEN 0.15 ELSE 1.0 END::DOUBLE AS s, CASE WHEN oa IS NULL AND aa IS NULL THEN 0.3::DOUBLE ELSE least(1.0, 0.3::DOUBLE + 0.7::DOUBLE * ((k % 83) / 83.0::DOUBLE)) END AS au FROM y)
SELECT k AS id, round(f, 4) AS freshness, o AS owner, round(CASE WHEN sc = 0 THEN 0 ELSE least(1.0, sc + CASE WHEN same THEN 0.1::DOUBLE ELSE 0 END) END, 4)::DOUBLE AS scope, round(au, 4) AS authority, s AS supersession, sc > 0 AS in_scope, known AND age > period AS stale, oa IS NULL AND aa IS NULL AND NOT known AS unofficial,
round(CASE WHEN sc > 0 THEN 0.3::DOUBLE * f + 0.2::DOUBLE * o + 0.15::DOUBLE * au + 0.15::DOUBLE * ch + 0.2::DOUBLE * s ELSE 0 END, 3)::DOUBLE AS trust FROM z""")
def trust_signals(spark, d):
    """Every signal of trust from documents, people and what supersedes what."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = _t(spark, d, "orders")
    docs = o.select(
        k.alias("id"), F.expr(_KIND2).alias("doc_type"), F.when(c % 3 == 0, "BE").when(c % 3 == 1, "NL").alias("country"), F.when(c % 2 == 0, "BE").alias("asked_country"), F.when(k % 9 == 0, "Acme").alias("client"), F.lit("Acme").alias("asked_client"),
        F.to_date("o_orderdate").alias("updated_at"), F.when(k % 8 == 0, F.date_add(F.to_date("o_orderdate"), 90)).alias("validated_at"), F.when(k % 5 == 0, False).alias("date_known"),
        F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("supersedes_id"), F.when(k % 3 != 0, c).alias("owner_id"), F.when(k % 7 != 0, k % 6).alias("author_id"), ((k % 83) / 83).alias("normalised"),
    )
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("active"))
    out = trust.signals(docs, people, "2001-12-31")
    r = lambda x, n=4: F.round(F.col(x).cast("double"), n).alias(x)
    return out.select("id", r("freshness"), r("owner"), r("scope"), r("authority"), r("supersession"), "in_scope", "stale", "unofficial", "trust")


_JUDGED = """e0 AS (SELECT o_custkey AS sub_id, o_orderkey AS k, o_orderkey % 7 AS dd, o_orderkey % 4 AS ww, o_orderkey % 5 = 0 AS asks, round(((o_orderkey * 7919) % 1000) / 1000.0, 3)::DOUBLE AS rel, (o_orderkey * 31 % 991) / 991.0::DOUBLE AS tr, o_orderkey % 2 AS ow, CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0.9 END AS ch, o_orderkey % 7 = 0 AS off, o_orderdate::DATE AS day,
 o_orderstatus <> 'F' OR o_orderkey % 2 = 0 AS scoped, o_orderstatus <> 'P' AS topical FROM orders),
e1 AS (SELECT *, CASE WHEN scoped AND rel >= 0.35 AND topical THEN k % 2 END AS cl, list_distinct(['pay', 'is', dd::VARCHAR, 'days', 'and', ww::VARCHAR, 'weeks']) AS tk FROM e0),
g AS (SELECT *, rel >= 0.5 AND rel >= max(rel) OVER (PARTITION BY sub_id, cl) - 0.2::DOUBLE AND ow = 1 AND ch >= 0.75 AS fit FROM e1 WHERE cl IS NOT NULL),
w AS (SELECT sub_id, cl, k AS wk, dd AS wd, ww AS wwk, tk AS wt FROM g QUALIFY row_number() OVER (PARTITION BY sub_id, cl ORDER BY fit DESC, CASE WHEN fit THEN off::INT ELSE 0.5 * rel + 0.5 * tr END DESC, CASE WHEN fit THEN epoch(day) ELSE 0 END DESC, CASE WHEN fit THEN tr ELSE 0 END DESC, CASE WHEN fit THEN rel ELSE 0 END DESC, k) = 1),
m AS (SELECT e1.*, wk, CASE WHEN wk IS NULL THEN 'alone' WHEN wk = k THEN 'winner' WHEN len(list_intersect(tk, wt))::DOUBLE / len(list_distinct(list_concat(tk, wt))) >= 0.75 THEN 'duplicate' WHEN NOT asks AND (dd <> wd OR ww <> wwk) THEN 'conflict' ELSE 'supporting' END AS verdict FROM e1 LEFT JOIN w ON e1.sub_id = w.sub_id AND e1.cl = w.cl)"""


@query(f"""WITH {_JUDGED}, x AS (SELECT *, verdict = 'winner' AND bool_or(verdict = 'conflict') OVER (PARTITION BY sub_id, cl) AS contested, verdict IN ('winner', 'supporting', 'alone') AS usable FROM m)
SELECT sub_id, k AS chunk_id, verdict, contested OR k % 17 = 0 AS contested, CASE WHEN verdict = 'supporting' THEN wk END AS supports, CASE WHEN usable THEN row_number() OVER (PARTITION BY sub_id, usable ORDER BY 0.5::DOUBLE * rel + 0.5::DOUBLE * tr DESC, k) END AS rank FROM x""")
def cluster_evidence(spark, d):
    """What can cluster, who wins, duplicates, conflicts and support, and the order of the evidence."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Pay is "), k % 7, F.lit(" days and "), k % 4, F.lit(" weeks"), F.when(k % 5 == 0, "?").otherwise("."))
    rows = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("sub_id"), k.alias("chunk_id"), text.alias("text"), F.round(((k * 7919) % 1000) / 1000, 3).alias("relevance"), (k * 31 % 991 / 991).alias("trust"), (k % 2).alias("owner"), F.when(k % 3 == 0, 0.5).otherwise(0.9).alias("channel"), (k % 7 == 0).alias("official"),
        F.to_date("o_orderdate").alias("updated_at"), ((F.col("o_orderstatus") != "F") | (k % 2 == 0)).alias("in_scope"), (F.col("o_orderstatus") != "P").alias("on_topic"),
    )
    rows = analyse.clusterable(rows).withColumn("cluster", F.when(F.col("clusterable"), F.col("chunk_id") % 2))
    inner = rows.where(F.col("chunk_id") % 17 == 0).select("sub_id", "chunk_id")  # passages that their own document contradicts
    return analyse.evidence(rows, inner).select("sub_id", "chunk_id", "verdict", "contested", "supports", F.col("rank").cast("long").alias("rank"))


_KIND3 = "CASE chunk_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'policy' WHEN 2 THEN 'email' ELSE 'wiki' END"


@query(f"""WITH {_CAND}, b AS (SELECT *, 0.5::DOUBLE * relevance + 0.5::DOUBLE * trust AS score, {_KIND3} AS dt, chunk_id % 3 = 0 AS contested FROM c),
dis AS (SELECT sub_id, max(relevance) AS denies, arg_min(chunk_id, (-relevance, chunk_id)) AS denial FROM c WHERE chunk_id % 13 = 0 GROUP BY 1), a AS (SELECT * FROM b WHERE chunk_id % 13 <> 0),
s AS (SELECT *, first_value(relevance) OVER (PARTITION BY sub_id ORDER BY score DESC, chunk_id) AS top FROM a WHERE on_topic AND asserts AND relevance >= 0.5 AND trust >= 0.35),
p AS (SELECT *, relevance >= greatest(0.5, top - 0.35) AND owner = 1 AND channel >= 0.75 AS fit FROM s), q AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY fit DESC, CASE WHEN fit THEN official END DESC NULLS LAST, CASE WHEN fit THEN updated_at END DESC NULLS LAST, CASE WHEN fit THEN trust END DESC NULLS LAST, CASE WHEN fit THEN relevance END DESC NULLS LAST, score DESC, chunk_id) = 1),
n AS (SELECT sub_id, chunk_id AS near, trust AS nt FROM a WHERE on_topic AND asserts AND relevance >= 0.35 AND (relevance < 0.5 OR trust < 0.35) QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY score DESC, chunk_id) = 1),
x AS (SELECT u.sub_id, q.chunk_id AS lead, q.relevance, q.trust, q.dt, q.contested, near, nt, denies, denial, q.chunk_id IS NOT NULL AND NOT coalesce(denies >= q.top - 0.05, false) AS strong FROM (SELECT DISTINCT sub_id FROM c) u LEFT JOIN q ON u.sub_id = q.sub_id LEFT JOIN n ON u.sub_id = n.sub_id LEFT JOIN dis ON u.sub_id = dis.sub_id),
y AS (SELECT *, CASE WHEN strong AND contested THEN 'contested' WHEN strong AND dt IN ('chat', 'email', 'ticket') THEN 'informal' WHEN strong THEN 'answered' WHEN near IS NOT NULL AND denies IS NULL THEN 'partial' ELSE 'missing' END AS status FROM x)
SELECT sub_id, status, round(greatest(0.0, CASE status WHEN 'missing' THEN 0 WHEN 'partial' THEN 0.3::DOUBLE * nt ELSE 0.5::DOUBLE * least(1.0, relevance / 0.8::DOUBLE) + 0.5::DOUBLE * trust - CASE status WHEN 'contested' THEN 0.15::DOUBLE WHEN 'informal' THEN 0.1::DOUBLE ELSE 0 END END), 6) AS confidence,
CASE WHEN strong THEN lead WHEN status = 'partial' THEN near ELSE denial END AS chunk_id FROM y""")
def answer_status(spark, d):
    """K2/K3/K5: status, confidence and leading passage of each part, from candidates and disclaimers."""
    c = _candidates(spark, d).withColumn("doc_type", F.expr(_KIND3)).withColumn("contested", F.col("chunk_id") % 3 == 0)
    out = answer.answered(c.where("chunk_id % 13 <> 0"), c.where("chunk_id % 13 = 0"), c.select("sub_id").distinct())
    return out.select("sub_id", "status", F.round("confidence", 6).alias("confidence"), "chunk_id")


@query("SELECT sub_id % 50 AS question_id, count(*) AS review_count FROM (SELECT o_custkey AS sub_id, o_orderstatus FROM orders) WHERE o_orderstatus <> 'O' GROUP BY 1")
def review_counts(spark, d):
    """K9: items for review."""
    return answer.review_count(_t(spark, d, "orders").where("o_orderstatus <> 'O'").select((F.col("o_custkey") % 50).alias("question_id")))


@query("SELECT o_orderkey AS sub_id, 'Who pays order ' || o_orderkey || '?' AS question FROM orders WHERE o_orderstatus = 'O'")
def undocumented_parts(spark, d):
    """K7: parts that only informal sources answer."""
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(k.alias("sub_id"), F.concat(F.lit("Who pays order "), k, F.lit("?")).alias("question"), F.when(F.col("o_orderstatus") == "O", "informal").otherwise("answered").alias("status"))
    return answer.undocumented(rows).select("sub_id", "question")


@query("""SELECT o_orderkey AS chunk_id, o.c_name AS owner, 'role ' || o.c_mktsegment AS owner_role, o.c_acctbal >= 0 AS owner_active, a.c_name AS author, CASE o_orderkey % 4 WHEN 0 THEN 'Belgium' WHEN 1 THEN 'Germany' WHEN 2 THEN 'Global' END AS country_name, o_orderkey % 5 <> 0 AS date_known,
round(0.5::DOUBLE * least(1.0, (o_orderkey % 97) / 97.0::DOUBLE / 0.8::DOUBLE) + 0.5::DOUBLE * ((o_orderkey % 89) / 89.0::DOUBLE), 2) AS confidence FROM orders LEFT JOIN customer o ON o_orderkey % 3 <> 0 AND o.c_custkey = o_custkey LEFT JOIN customer a ON a.c_custkey = o_orderkey % 100""")
def evidence_cards(spark, d):
    """Evidence with the names of people and countries."""
    k = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select(
        k.alias("chunk_id"), F.when(k % 3 != 0, F.col("o_custkey")).alias("owner_id"), (k % 100).alias("author_id"), F.when(k % 4 == 0, "BE").when(k % 4 == 1, "DE").when(k % 4 == 3, "XX").alias("country"),
        (k % 97 / 97).alias("relevance"), (k % 89 / 89).alias("trust"), F.when(k % 5 == 0, False).alias("date_known"),
    )
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("role "), "c_mktsegment").alias("role"), (F.col("c_acctbal") >= 0).alias("active"))
    return answer.cards(rows, people).select("chunk_id", "owner", "owner_role", "owner_active", "author", "country_name", "date_known", "confidence")


@query(rf"""WITH q AS (SELECT item_id, {_CONTENT.format('b.text')} AS qt, trim(regexp_replace(d.text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
s AS (SELECT item_id, qt, list_filter(string_split(regexp_replace(x, '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda y: y <> '') AS s FROM q),
u AS (SELECT item_id, qt, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM s),
z AS (SELECT item_id, sentence, pos, len(list_intersect({_CONTENT.format('sentence')}, qt)) + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.5 ELSE 0 END AS score FROM u)
SELECT b.item_id, z.sentence FROM (SELECT item_id FROM q) b LEFT JOIN z ON b.item_id = z.item_id QUALIFY row_number() OVER (PARTITION BY b.item_id ORDER BY score DESC, pos) = 1""")
def lead_sentences(spark, d):
    """K1: the sentence of a text that shares most with a question, half a point for a digit."""
    b = _t(spark, d, "benchmark").select("item_id", t.content_tokens(F.col("text")).alias("q"))
    rows = b.join(_t(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return rows.select("item_id", t.lead_sentence(F.col("q"), F.col("text")).alias("sentence"))


_STANDING = """e AS (SELECT o_custkey AS p, CASE o_orderstatus WHEN 'F' THEN 'owns' WHEN 'O' THEN 'edited' ELSE 'seen' END AS rel, o_orderkey % 200 + 1 AS doc, o_orderkey % 5 AS topic, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS country,
 CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 1.5 ELSE 0.5 END * pow(0.5, date_diff('day', o_orderdate::DATE, DATE '2001-12-31') / 365.0::DOUBLE) AS b FROM orders),
x AS (SELECT p, b * CASE WHEN country IS NULL OR p_size % 3 = 2 OR country = CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END THEN 1.0 ELSE 0.3 END * CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 0.5 END AS w FROM e JOIN part ON doc = p_partkey AND topic = p_partkey % 3),
s AS (SELECT p, sum(w) AS s, count(*) AS events FROM x GROUP BY 1),
r AS (SELECT c_custkey AS id, c_acctbal >= 0 AS active, c_custkey % 4 = 0 AND c_custkey % 3 = 0 AS shared, coalesce(s.s, 0) * (1 + least(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 13 END, 10) * 0.015::DOUBLE) AS raw, coalesce(events, 0) AS events FROM customer LEFT JOIN s ON c_custkey = s.p)"""


def _standing(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    country = lambda x: F.when(x % 3 == 0, "A").when(x % 3 == 1, "B")
    edges = _t(spark, d, "orders").select(
        F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") == "F", "owns").when(F.col("o_orderstatus") == "O", "edited").otherwise("seen").alias("rel"), F.lit("doc").alias("dst_kind"), (k % 200 + 1).cast("string").alias("dst_id"),
        F.to_date("o_orderdate").alias("at"), F.array(F.concat(F.lit("t"), k % 5)).alias("topics"), country(k).alias("country"),
    )
    p = F.col("p_partkey")
    docs = _t(spark, d, "part").select(p.cast("string").alias("id"), F.array(F.concat(F.lit("t"), p % 3)).alias("topics"), country(F.col("p_size")).alias("country"), F.when(p % 2 == 0, "policy").otherwise("chat").alias("doc_type"))
    people = _t(spark, d, "customer").select(c.alias("id"), F.when(c % 3 == 0, "Payroll Team").otherwise("Clerk").alias("role"), F.when(c % 4 == 0, 0).otherwise(c % 13).cast("int").alias("seniority_years"), (F.col("c_acctbal") >= 0).alias("active"))
    return reputation.reputation(reputation.weigh(edges, docs, "2001-12-31"), people)


@query(f"WITH {_STANDING} SELECT id, events, round(raw, 6) AS raw, round(1 - exp(-raw / 2.5::DOUBLE), 6) AS normalised FROM r")
def reputations(spark, d):
    """The standing of people from their edges, with seniority."""
    return _standing(spark, d).select("id", "events", F.round("raw", 6).alias("raw"), F.round("normalised", 6).alias("normalised"))


@query(f"WITH {_STANDING} SELECT id, round(100 * (1 - exp(-raw / 2.5::DOUBLE)))::INT AS score FROM r WHERE active AND NOT shared AND events > 0 ORDER BY score DESC, id LIMIT 4")
def experts_found(spark, d):
    """Whom to ask: active people with events, no shared mailboxes (a top-4 report)."""
    return reputation.experts(_standing(spark, d)).select("id", "score")


_GRAPH = """cited AS (SELECT l_orderkey AS q, l_partkey AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'evidence' WHEN 1 THEN 'conflict' ELSE 'outdated' END AS role FROM lineitem), nodes AS (SELECT DISTINCT q, doc FROM cited)"""


def _graph(spark, d):
    k, p = F.col("l_orderkey"), F.col("p_partkey")
    role = F.when(F.col("l_linenumber") % 3 == 0, "evidence").when(F.col("l_linenumber") % 3 == 1, "conflict").otherwise("outdated")
    cited = _t(spark, d, "lineitem").select(k.alias("question_id"), F.col("l_partkey").cast("string").alias("doc_id"), role.alias("role"))
    part = _t(spark, d, "part")
    on_docs = part.select((p % 100).alias("person_id"), F.lit("owns").alias("rel"), F.lit("doc").alias("dst_kind"), p.cast("string").alias("dst_id"))
    on_topics = part.select((p % 50).alias("person_id"), F.lit("listed").alias("rel"), F.lit("topic").alias("dst_kind"), F.concat(F.lit("t"), p % 5).alias("dst_id")).distinct()
    docs = part.select(p.cast("string").alias("id"), F.array(F.concat(F.lit("t"), p % 5), F.concat(F.lit("u"), p % 3)).alias("topics"))
    o = _t(spark, d, "orders")
    asked = o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("t"), F.col("o_orderkey") % 5).alias("topic"))
    found = o.select(F.col("o_orderkey").alias("question_id"), (F.col("o_custkey") % 50).alias("person_id"))
    people = _t(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"))
    return reputation.answer_graph(cited, on_docs.unionByName(on_topics), docs, asked, people, found)


@query(f"WITH {_GRAPH} SELECT q AS question_id, doc::VARCHAR AS doc_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM cited GROUP BY 1, 2")
def graph_documents(spark, d):
    """Documents of answers with the parts they play."""
    return _graph(spark, d)[0].select("question_id", "doc_id", F.array_join("roles", ",").alias("roles"))


@query(f"""WITH {_GRAPH}, people AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 10 <> 3)
SELECT q AS question_id, 'person:' || doc % 100 AS src, 'owns' AS rel, 'doc:' || doc AS dst FROM nodes WHERE doc % 100 IN (SELECT id FROM people)
UNION SELECT o_orderkey, 'person:' || o_custkey % 50, 'listed', 'topic:t' || o_orderkey % 5 FROM orders WHERE o_custkey % 50 IN (SELECT id FROM people) AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 50 = o_custkey % 50 AND p_partkey % 5 = o_orderkey % 5)
UNION SELECT q, 'doc:' || doc, 'about', 'topic:t' || doc % 5 FROM nodes JOIN orders ON q = o_orderkey AND doc % 5 = q % 5""")
def answer_links(spark, d):
    """Links between people, cited documents and topics that are asked about."""
    return _graph(spark, d)[1]


_LOG = "CASE o_orderpriority WHEN '1-URGENT' THEN 'retract' WHEN '2-HIGH' THEN 'archive' WHEN '3-MEDIUM' THEN 'request_update' WHEN '5-LOW' THEN 'validate' ELSE 'restore' END"


def _acted(spark, d):
    k = F.col("o_orderkey")
    docs = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("active").alias("status"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 7).alias("owner_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(99).cast("long")).alias("author_id"), F.lit(None).cast("date").alias("validated_at"))
    log = _t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), k.alias("seq"), F.expr(_LOG).alias("action"), F.when(k % 2 == 0, k % 5).alias("actor_id"), F.when(k % 4 == 0, F.lit(7).cast("long")).alias("assignee_id"), F.to_date("o_orderdate").alias("at"))
    tasks = _t(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 2 == 0, "confirm_valid").otherwise("reassign_owner").alias("kind"), F.lit(1).cast("long").alias("assignee_id"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("done"))
    return lifecycle.act(docs, tasks, log)


_ACTED = f"a AS (SELECT o_custkey AS d, o_orderkey AS seq, {_LOG} AS act, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 END AS actor, CASE WHEN o_orderkey % 4 = 0 THEN 7 END AS named, o_orderdate::DATE AS day, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 7 END AS owner, CASE WHEN o_custkey % 2 = 0 THEN 99 END AS author FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"""WITH {_ACTED} SELECT c_custkey AS id, coalesce((SELECT CASE arg_max(act, seq) WHEN 'retract' THEN 'retracted' WHEN 'archive' THEN 'archived' WHEN 'request_update' THEN 'needs_update' ELSE 'active' END FROM a WHERE d = c_custkey HAVING count(*) > 0), 'active') AS status,
(SELECT arg_max(day, seq) FROM a WHERE d = c_custkey AND act = 'validate') AS validated_at FROM customer""")
def review_effects(spark, d):
    """L4: documents after a log of review actions."""
    return _acted(spark, d)[0].select("id", "status", "validated_at")


@query(f"""WITH {_ACTED}, k AS (SELECT c_custkey AS d, CASE WHEN c_custkey % 2 = 0 THEN 'confirm_valid' ELSE 'reassign_owner' END AS kind, 1 AS who, 0 AS seq FROM customer UNION ALL SELECT d, 'request_update', coalesce(named, owner, author), seq FROM a WHERE act = 'request_update' AND coalesce(named, owner, author) IS NOT NULL),
m AS (SELECT d, max(seq) FILTER (act = 'restore') AS r, max(seq) FILTER (act = 'validate') AS v FROM a GROUP BY 1)
SELECT k.d AS document_id, kind, who::BIGINT AS assignee_id, k.seq::BIGINT AS seq, coalesce(r > k.seq, false) OR (kind = 'confirm_valid' AND coalesce(v > k.seq, false)) AS done FROM k LEFT JOIN m ON k.d = m.d""")
def review_tasks(spark, d):
    """L4: tasks that review actions open and close."""
    return _acted(spark, d)[1].select("document_id", "kind", F.col("assignee_id").cast("long").alias("assignee_id"), F.col("seq").cast("long").alias("seq"), "done")


@query(f"WITH {_ACTED} SELECT coalesce(actor, owner)::BIGINT AS person_id, 'reviewed' AS rel, d AS document_id, day AS \"at\" FROM a WHERE act = 'validate' AND coalesce(actor, owner) IS NOT NULL")
def review_edges(spark, d):
    """L4: edges that validations leave."""
    return _acted(spark, d)[2].select(F.col("person_id").cast("long").alias("person_id"), "rel", "document_id", "at")


@query(f"""WITH x AS (SELECT date_diff('day', o_orderdate::DATE, DATE '2001-12-31') AS age, {_KIND2} AS dt FROM orders WHERE o_orderkey % 6 <> 0), k AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'request_update' WHEN 1 THEN 'confirm_valid' ELSE 'reassign_owner' END AS kind FROM orders WHERE o_orderkey % 4 <> 0)
SELECT count(*) AS documents, count(*) FILTER (age <= 180) AS fresh, count(*) FILTER ((dt = 'policy' AND age > 864) OR (dt = 'report' AND age > 365)) AS overdue, (SELECT count(*) FROM k) AS open_tasks,
(SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM k GROUP BY 1)) AS by_kind, (SELECT count(*) FROM lineitem) AS versions_recorded, (SELECT max(ts) FROM events) AS last_sync FROM x""")
def corpus_overview(spark, d):
    """L3: counts over documents, tasks by kind, versions and the last sync."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders")
    docs = o.select(F.expr(_KIND2).alias("doc_type"), F.to_date("o_orderdate").alias("updated_at"), F.lit(None).cast("date").alias("validated_at"), F.when(k % 6 == 0, "retracted").otherwise("active").alias("status"))
    tasks = o.select(F.when(k % 3 == 0, "request_update").when(k % 3 == 1, "confirm_valid").otherwise("reassign_owner").alias("kind"), (k % 4 == 0).alias("done"))
    out = lifecycle.overview(docs, tasks, "2001-12-31", _t(spark, d, "lineitem"), _t(spark, d, "events").select(F.col("ts").alias("finished_at")))
    pairs = F.transform(F.array_sort(F.map_entries("by_kind")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("by_kind", F.array_join(pairs, ","))


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY name, id")
def people_by_name(spark, d):
    """People in the order of their names."""
    return lifecycle.people_list(_t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


_NOTE = "'Pay order ' || o_orderkey || '. Ask ' || o_custkey || '! Then rest'"


@query(f"""WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) + 2 AS n FROM orders WHERE o_orderstatus = 'P') SELECT 'USR-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Decisions' ELSE 'Note' END AS section, 4 AS line_start, 6 AS line_end,
{_NOTE} AS text, CASE WHEN o_orderkey % 3 <> 0 THEN 2 ELSE 0 END::BIGINT AS n_edges, 'T' || chr(10) || chr(10) || '## ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Decisions' ELSE 'Note' END || chr(10) || replace(replace({_NOTE}, '. ', '.' || chr(10)), '! ', '!' || chr(10)) AS body FROM n""")
def added_notes(spark, d):
    """Texts that are added directly, with ids, chunks and edges."""
    k = F.col("o_orderkey")
    notes = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(k.alias("seq"), F.lit("T").alias("title"), F.expr(_NOTE).alias("text"), F.when(k % 2 == 0, "meeting").otherwise("chat").alias("doc_type"), F.when(k % 3 != 0, F.col("o_custkey")).alias("owner_id"), F.array().cast("array<string>").alias("topics"))
    old = _t(spark, d, "nation").where("n_nationkey < 3").select(F.when(F.col("n_nationkey") == 0, "DOC-1").otherwise(F.concat(F.lit("USR-000"), "n_nationkey")).alias("id"))
    docs, chunks, edges = ingest.added(notes, old, "2001-12-31")
    n = edges.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n_edges"))
    rows = docs.select("id", "body").join(chunks.withColumnRenamed("document_id", "id"), "id").join(n, "id", "left")
    return rows.select("id", "section", "line_start", "line_end", "text", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), "body")


@query(f"""WITH {_LINES} SELECT conv_id, concat_ws(',', CASE WHEN bool_or(d) THEN 'Decisions' END, CASE WHEN bool_or(a AND NOT d) THEN 'Actions' END, CASE WHEN bool_or(NOT a AND NOT d) THEN 'Summary' END) AS headings,
string_agg(item, chr(10) ORDER BY turn, line) FILTER (d) AS decisions, string_agg(item, chr(10) ORDER BY turn, line) FILTER (a AND NOT d) AS actions FROM k GROUP BY 1""")
def meeting_units(spark, d):
    """Meetings as units with the sections that have content, and their texts."""
    out = connectors.meetings(_calls(spark, d))
    text = lambda name: F.nullif(F.array_join(F.get(F.filter("sections", lambda s: s["heading"] == name), F.lit(0))["sentences"], "\n"), F.lit(""))
    return out.select(F.col("external_id").alias("conv_id"), F.array_join(F.transform("sections", lambda s: s["heading"]), ",").alias("headings"), text("Decisions").alias("decisions"), text("Actions").alias("actions"))


_REGISTRY = [("meetings", "Meetings", "Meeting Recorder", "MT"), ("sharepoint", "SharePoint", "SharePoint Online", "SP")]


@query(f"""WITH {_LINES}, p AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'MEETING recorder' WHEN 1 THEN 'SharePoint' ELSE 'My notes, 2nd app' END AS source, count(*) AS n, conv_id % 5 = 0 AS known, conv_id % 10 = 0 AS same FROM k GROUP BY 1)
SELECT CASE conv_id % 3 WHEN 0 THEN 'MT-' WHEN 1 THEN 'SP-' ELSE 'API-MYNOTES2-' END || conv_id AS id, CASE conv_id % 3 WHEN 0 THEN 'meetings' WHEN 1 THEN 'sharepoint' ELSE 'push:my notes, 2nd app' END AS connector,
CASE WHEN NOT known THEN 'inserted' WHEN same THEN 'unchanged' ELSE 'updated' END AS change FROM p""")
def pushed_meetings(spark, d):
    """Transcripts pushed under the name of a source: parsed, named by the connector that the source is, and judged against what is there."""
    k = F.col("external_id")
    source = F.when(k % 3 == 0, "MEETING recorder").when(k % 3 == 1, "SharePoint").otherwise("My notes, 2nd app")
    units = connectors.meetings(_calls(spark, d)).withColumn("source", source)
    docs = ingest.pushed(units, spark.createDataFrame(_REGISTRY, "name string, label string, source_system string, id_prefix string"))
    # what an earlier push left: a tenth of the meetings as they are now, another tenth with other words
    old = docs.where(k % 5 == 0).select("id", F.when(k % 10 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"), F.lit("active").alias("status"))
    return ingest.classify(docs, old).select("id", "connector", "change")


@query("""WITH b AS (SELECT o_orderkey AS id, CASE WHEN c.k IS NULL THEN 'inserted' WHEN o_orderkey % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM orders LEFT JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0) c ON c.k = o_orderkey WHERE o_orderkey % 5 <> 0)
SELECT count(*) AS fetched, count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated, count(*) FILTER (change = 'unchanged') AS unchanged FROM b""")
def run_counts(spark, d):
    """U16: what became of a run's rows."""
    o = _t(spark, d, "orders")
    batch = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.sha1(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))).alias("content_hash"))
    current = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.sha1("o_orderstatus").alias("content_hash"), F.lit("active").alias("status"))
    return ingest.counts(ingest.classify(batch, current))


@query("""SELECT o_orderkey AS id, CASE WHEN c.k IS NULL THEN 'active' WHEN o_orderkey % 7 = 0 THEN 'active' ELSE 'archived' END AS status, true AS seen FROM orders LEFT JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 <> 0) c ON c.k = o_orderkey WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'archived', false FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0""")
def snapshot_seen(spark, d):
    """Archived documents seen again: changed ones come back, unchanged ones are only marked as seen."""
    o = _t(spark, d, "orders")
    batch = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.sha1(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))).alias("content_hash"))
    current = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.sha1("o_orderstatus").alias("content_hash"), F.lit("archived").alias("status"))
    return ingest.apply(batch, current, "2002-01-01 00:00:00").select("id", "status", F.col("last_seen_at").isNotNull().alias("seen"))


@query("SELECT DISTINCT event_type AS connector, DATE '2024-01-05' AS since, 'given' AS kind FROM events UNION ALL SELECT DISTINCT event_type, NULL, 'full' FROM events")
def sync_from(spark, d):
    """From where a sync reads whose day is given, and a full one."""
    runs = _t(spark, d, "events").select(F.col("event_type").alias("connector"), F.col("ts").alias("finished_at"))
    given = lifecycle.high_water(runs, "2024-01-05").withColumn("kind", F.lit("given"))
    return given.unionByName(lifecycle.high_water(runs, full=True).withColumn("kind", F.lit("full")))


@query(f"""WITH e AS (SELECT o_custkey AS p, CASE o_orderstatus WHEN 'F' THEN 'owns' WHEN 'O' THEN 'edited' ELSE 'seen' END AS rel, o_orderkey % 200 + 1 AS doc, o_orderkey % 4 = 0 AS on_topic, o_orderkey % 5 AS t, o_orderdate::DATE AS seen_at FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT *, CASE rel WHEN 'owns' THEN 2.0 WHEN 'edited' THEN 1.5 ELSE 0.5 END::DOUBLE * pow(0.5, date_diff('day', seen_at, DATE '{AS_OF}') / 365.0::DOUBLE) AS base FROM e),
a AS (SELECT * FROM (VALUES (1, ['t0', 't1'], 'A'), (2, ['t1'], NULL), (3, ['t2', 't3'], 'B')) AS a(ask_id, topics, country)),
d AS (SELECT p_partkey, list_distinct(['t' || p_partkey % 3, 't' || p_partkey % 2]) AS topics, CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS country, CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS ch FROM part),
w AS (SELECT ask_id, p, base * ch * CASE WHEN a.country IS NULL OR d.country IS NULL OR a.country = d.country THEN 1 ELSE 0.3 END::DOUBLE AS w FROM b JOIN d ON doc = p_partkey JOIN a ON len(list_intersect(a.topics, d.topics)) > 0 WHERE NOT on_topic
UNION ALL SELECT ask_id, p, base FROM b JOIN a ON list_contains(a.topics, 't' || t) WHERE on_topic)
SELECT ask_id, p AS person_id, count(*) AS events, round(1 - exp(-sum(w) * (1 + least(p % 14, 10) * 0.015::DOUBLE) / 2.5::DOUBLE), 6) AS normalised FROM w GROUP BY 1, 2""")
def kept_standing(spark, d):
    """Standing from sums kept over batches of different days, with edges taken back, instead of from all edges."""
    k, p = F.col("o_orderkey"), F.col("p_partkey")
    topic = k % 4 == 0
    edges = _t(spark, d, "orders").select(
        k, F.col("o_custkey").alias("person_id"), F.when(F.col("o_orderstatus") == "F", "owns").when(F.col("o_orderstatus") == "O", "edited").otherwise("seen").alias("rel"), F.when(topic, "topic").otherwise("doc").alias("dst_kind"),
        F.when(topic, F.concat(F.lit("t"), k % 5)).otherwise((k % 200 + 1).cast("string")).alias("dst_id"), F.to_date("o_orderdate").alias("at"),
    )
    country = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "B")
    docs = _t(spark, d, "part").select(p.cast("string").alias("id"), F.array(F.concat(F.lit("t"), p % 3), F.concat(F.lit("t"), p % 2)).alias("topics"), country.alias("country"), F.when(p % 2 == 0, "policy").otherwise("chat").alias("doc_type"))
    first, second = scratch_cut(standing.sums(edges.where("person_id % 2 = 0"), docs, "1996-05-01")), scratch_cut(standing.sums(edges.where("person_id % 2 = 1"), docs, "1999-01-31"))
    back = standing.removed(scratch_cut(standing.sums(edges.where(k % 11 == 0), docs, "2000-02-29")))
    state = scratch_cut(standing.merged([scratch_cut(standing.merged([first, second], "1999-06-30")), back], "2001-01-01"))
    asks = F.broadcast(spark.createDataFrame([(1, ["t0", "t1"], "A"), (2, ["t1"], None), (3, ["t2", "t3"], "B")], "ask_id int, topics array<string>, country string"))  # three rows: no sum is shuffled by its few topics
    people = edges.select(F.col("person_id").alias("id")).distinct().withColumn("seniority_years", (F.col("id") % 14).cast("int"))
    return standing.scored(state, asks, people, AS_OF).select("ask_id", "person_id", "events", F.round("normalised", 6).alias("normalised"))


def _corpus(spark, d):
    """Documents as a corpus: one passage each, customers for people, orders for what those did with documents."""
    docs, people, orders = (_t(spark, d, x) for x in ("documents", "customer", "orders"))
    n = people.agg(F.max("c_custkey")).first()[0] or 1
    k = F.col("doc_id")
    who = lambda x: (F.pmod(x, F.lit(n)) + 1).cast("string")
    kind = F.get(F.array(*map(F.lit, ("policy", "wiki", "chat", "procedure", "email", "meeting"))), (k % 6).cast("int"))
    place = F.when(F.col("lang") == "de", "DE").when(F.col("lang") == "fr", "FR").when(F.col("lang") == "en", "UK")
    topics = understand.topics_of(F.col("text"), _ASKED)
    rows = docs.select(
        k.cast("string").alias("id"), F.concat(F.lit("Note of "), "source").alias("title"), kind.alias("doc_type"), place.alias("country"), F.lit(None).cast("string").alias("client"), topics.alias("topics"),
        F.when(k % 7 != 0, who(k)).alias("owner_id"), F.when(k % 14 != 0, who(k * 31)).alias("author_id"), F.date_add(F.lit(config.AS_OF).cast("date"), -(k * 37 % 1500).cast("int")).alias("updated_at"), F.lit(None).cast("date").alias("validated_at"),
        (k % 14 != 0).alias("date_known"), F.when(k % 9 == 0, (k + 1).cast("string")).alias("supersedes_id"), F.when(k % 11 == 0, "archived").otherwise("active").alias("status"), "text", k.alias("chunk_id"),
    )
    rows = scratch_cut(rows)
    chunks = rows.select("chunk_id", F.col("id").alias("document_id"), F.lit("Text").alias("section"), F.coalesce("text", F.lit("")).alias("text"), "topics")
    staff = people.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("Consultant").alias("role"), (F.col("c_acctbal") >= 0).alias("active"), (F.col("c_custkey") % 14).cast("int").alias("seniority_years"))
    edges = orders.select(F.col("o_custkey").cast("string").alias("person_id"), F.when(F.col("o_orderstatus") == "F", "owns").otherwise("edited").alias("rel"), F.lit("doc").alias("dst_kind"), (F.col("o_orderkey") % 1000).cast("string").alias("dst_id"), F.to_date("o_orderdate").alias("at"))
    return ask.Corpus(chunks, rows.drop("text", "chunk_id"), staff, edges)


_ASKED = [("motion", "to"), ("place", "in"), ("german", "der"), ("german", "und"), ("french", "les"), ("spanish", "para"), ("grammar", "of the")]
#: Places of the vectors that stand for texts in ``asked_items``.
_PLACES = 256


@query()
def asked_items(spark, d):
    """SURVEY 3.1: every benchmark item asked as a question of all documents, from its context to status, confidence and leading passage (scenarios are tested on a corpus of their own)."""
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("profile_country"), F.lit(None).cast("string").alias("profile_name"))
    embed = lambda rows, key, text: v.hashed_embeddings(rows, key, text, _PLACES)
    out = ask.ask(items, _corpus(spark, d), ask.Rules(_ASKED), embed=embed)
    return out.sections.select("question_id", "sub_no", "status", F.round("confidence", 3).alias("confidence"), "doc_id", "chunk_id")


_CLIENTS, _STAFF, _TEAMS = [(1, "Les", "FR"), (2, "und", "DE")], [(1, "in the", "Les"), (2, "para", "und")], [(1, "A", "tion"), (1, "A", "ment"), (2, "B", "ung"), (2, "B", "der"), (3, "C", "que")]
_rows = lambda table: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in table)
_BOUNDED = "regexp_matches(lower(t), '(^|[^a-z])' || lower({0}) || '([^a-z]|$)')"


@query(f"""WITH d AS (SELECT doc_id, source || ' ' || text AS t, doc_id % 5 = 0 AS has_topics, doc_id % 4 = 0 AS has_country, doc_id % 6 = 0 AS has_client, doc_id % 3 = 0 AS has_team FROM documents),
tr AS (SELECT * FROM (VALUES {_rows(_ASKED)}) AS x(topic, keyword)), cl AS (SELECT * FROM (VALUES {_rows(_CLIENTS)}) AS x(p, client, country)), em AS (SELECT * FROM (VALUES {_rows(_STAFF)}) AS x(p, employee, client)),
co AS (SELECT * FROM (VALUES {_rows(understand.rules(config.COUNTRIES))}) AS x(p, country, keyword)), te AS (SELECT * FROM (VALUES {_rows(_TEAMS)}) AS x(p, team, keyword)),
t1 AS (SELECT doc_id, list(topic ORDER BY len DESC, topic DESC) AS topics FROM (SELECT doc_id, topic, max(length(keyword)) AS len FROM d, tr WHERE {_BOUNDED.format('keyword')} GROUP BY 1, 2) GROUP BY 1),
c1 AS (SELECT doc_id, arg_min(client, p) AS client FROM d, cl WHERE {_BOUNDED.format('client')} GROUP BY 1), e1 AS (SELECT doc_id, arg_min(client, p) AS client FROM d, em WHERE {_BOUNDED.format('employee')} GROUP BY 1),
k1 AS (SELECT doc_id, arg_min(country, p) AS country FROM d, co WHERE {_BOUNDED.format('keyword')} GROUP BY 1),
m1 AS (SELECT doc_id, arg_max(team, (hits, -p)) AS team FROM (SELECT doc_id, team, count(*) AS hits, min(p) AS p FROM d, te WHERE contains(lower(t), keyword) GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, CASE WHEN has_topics THEN 'given' ELSE array_to_string(coalesce(topics, []), ',') END AS topics, CASE WHEN has_client THEN 'C' ELSE coalesce(c1.client, e1.client) END AS client,
CASE WHEN has_country THEN 'XX' ELSE coalesce(cl.country, k1.country) END AS country, CASE WHEN has_team THEN 'T' ELSE team END AS team
FROM d LEFT JOIN t1 USING (doc_id) LEFT JOIN c1 USING (doc_id) LEFT JOIN e1 USING (doc_id) LEFT JOIN k1 USING (doc_id) LEFT JOIN m1 USING (doc_id) LEFT JOIN cl ON cl.client = coalesce(c1.client, e1.client)""")
def text_enrichment(spark, d):
    """Topics, client, country and team of documents from their texts where none are given."""
    k = F.col("doc_id")
    given = lambda n, x: F.when(k % n == 0, x)
    docs = _t(spark, d, "documents").select(k, F.col("source").alias("title"), F.col("text").alias("body"), given(5, F.array(F.lit("given"))).alias("topics"), given(6, "C").alias("client"), given(4, "XX").alias("country"), given(3, "T").alias("team"))
    return ingest.enrich_text(docs, _ASKED, _CLIENTS, _STAFF, _TEAMS).select("doc_id", F.array_join("topics", ",").alias("topics"), "client", "country", "team")


_PHRASES = ["Runs are free of charge.", "A run is charged.", "Correction runs are not available.", "A correction run can be requested.", "There are no exceptions.", "Exceptions are allowed.", "Only bank details can be handled after the cutoff.", "It costs extra, but is free.", ""]
_ADDED = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"
_sql = lambda x: "'" + x.replace("'", "''") + "'"
_FACTS_OF = ", ".join(f"CASE {' '.join(f'WHEN regexp_matches(lower(t), {_sql(p)}) THEN {_sql(key + chr(61) + value)}' for p, value in options)} END" for key, options in t.KEY_FACTS)


@query(f"""WITH d AS (SELECT doc_id, text || ' ' || {_ADDED} AS t FROM documents) SELECT doc_id, array_to_string(list_filter([{_FACTS_OF}], lambda x: x IS NOT NULL), ',') AS facts FROM d""")
def key_fact_extract(spark, d):
    """key facts that texts state, by the fixed table."""
    said = _t(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), F.expr(_ADDED)).alias("t"))
    return said.select("doc_id", F.array_join(t.key_facts(F.lower("t"), t.KEY_FACTS), ",").alias("facts"))


@query("""WITH p AS (SELECT count(*) AS n FROM customer), e AS (SELECT sum(CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) AS n FROM orders),
b AS (SELECT count(*) AS n, sum(length('order ' || o_orderkey || chr(10) || chr(10) || '## Status' || chr(10) || o_orderstatus || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '## Priority' || chr(10) || o_orderpriority || chr(10) ELSE '' END)) AS size, sum(1 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS chunks FROM orders)
SELECT 'people' AS name, n::BIGINT AS n, NULL::BIGINT AS size FROM p UNION ALL SELECT 'edges', n::BIGINT, NULL FROM e UNION ALL SELECT 'documents', n, size::BIGINT FROM b UNION ALL SELECT 'chunks', chunks::BIGINT, NULL FROM b""")
def rebuilt_tables(spark, d):
    """All tables of a corpus written anew, and read back."""
    k = F.col("o_orderkey")
    section = lambda head, c: F.struct(F.lit(head).alias("heading"), F.array(c).alias("sentences"))
    sections = F.array(section("Status", "o_orderstatus"), F.struct(F.lit("Priority").alias("heading"), F.when(k % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("sentences")))
    day = F.to_date("o_orderdate")
    docs = _t(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("order "), k).alias("title"), F.array(F.lit("t")).alias("topics"), sections.alias("sections"), F.when(k % 3 != 0, F.col("o_custkey")).alias("owner_id"), F.when(k % 4 != 0, F.col("o_custkey")).alias("author_id"), day.alias("created_at"), day.alias("updated_at"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    edges = _t(spark, d, "orders").where(k % 10 == 0).select(F.col("o_custkey").alias("person_id"), F.lit("listed").alias("rel"), F.lit("topic:t").alias("dst"), day.alias("at"))
    made = ingest.rebuild(docs, people, edges, f"{scratch_folder(spark)}/{uuid.uuid4().hex}")
    count = lambda name, size=None: made[name].agg(F.lit(name).alias("name"), F.count("*").alias("n"), (F.lit(None) if size is None else F.sum(size)).cast("long").alias("size"))
    return count("people").unionByName(count("edges")).unionByName(count("documents", F.length("body"))).unionByName(count("chunks")).select("name", "n", "size")
