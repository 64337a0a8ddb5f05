"""Queries of the engine's operators over the shared tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import vectors as v
from ..operators import analyse, answer, ingest, lifecycle, reputation, retrieve, trust, understand
from ..shipping import ship

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AS_OF = "2001-12-31"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


# Fixed value: the stop words as SQL.
_STOP = "string_split('a an the of for in on at to from by with and or is are was were be been do does did how many much what which who where when why can could should would i we you they it this that these those our their your as into about after before during under over per get gets give employee employees', ' ')"
_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9€£%]+'), lambda x: length(x) > 2 AND NOT list_contains(" + _STOP + ", x)))"
_ALL = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query("""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE trim(line) <> ''""")
def chunk_lines(spark, d):
    """U4: line-addressable passages."""
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return rows.where(F.trim("line") != "").select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents)
SELECT doc_id, len(list_filter(x, lambda y: y <> ''))::BIGINT AS n_sentences, list_max(list_transform(x, lambda y: length(y)))::BIGINT AS longest FROM s""")
def sentence_split(spark, d):
    """Sentences."""
    s = _t(spark, d, "documents").select("doc_id", t.sentences_any(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query(f"SELECT doc_id, len({_CONTENT.format('text')})::BIGINT AS n_content, len({_ALL.format('text')})::BIGINT AS n_all FROM documents")
def token_stats(spark, d):
    """Token sets."""
    return _t(spark, d, "documents").select("doc_id", F.size(t.content_tokens(F.col("text"))).cast("long").alias("n_content"), F.size(t.all_tokens(F.col("text"))).cast("long").alias("n_all"))


@query("SELECT sha1(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, d):
    """Unchanged content by hash."""
    return _t(spark, d, "documents").groupBy(F.sha1("text").alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""SELECT array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name || ' v' || p_size || ' final'), '\\b(copy|final|draft)\\b|\\bv(ersion)? ?\\d+(\\.\\d+)*\\b|\\b(19|20)\\d\\d\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x NOT IN ('v', 'version', '')), ' ') AS stem,
count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1""")
def title_stem_groups(spark, d):
    """Titles without version marks."""
    title = F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"), F.lit(" final"))
    return _t(spark, d, "part").groupBy(t.title_stem(title).alias("stem")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("""WITH b AS (SELECT o_orderkey AS id, sha1(o_orderstatus || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END) AS h FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_orderkey AS id, sha1(o_orderstatus) AS h, CASE o_orderkey % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'active' ELSE 'retracted' END AS status FROM orders WHERE o_orderkey % 4 <> 0)
SELECT CASE WHEN c.h IS NULL THEN 'inserted' WHEN c.h = b.h THEN 'unchanged' ELSE 'updated' END AS change, CASE WHEN c.h IS NULL THEN 'active' WHEN c.h <> b.h AND c.status = 'archived' THEN 'active' ELSE c.status END AS status, count(*) AS n FROM b LEFT JOIN c USING (id) GROUP BY 1, 2""")
def upsert_classify(spark, d):
    """Inserted, updated, unchanged."""
    o = _t(spark, d, "orders")
    new = F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(""))
    batch = o.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.sha1(new).alias("content_hash"))
    status = F.when(F.col("o_orderkey") % 3 == 0, "archived").when(F.col("o_orderkey") % 3 == 1, "active").otherwise("retracted")
    current = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.sha1("o_orderstatus").alias("content_hash"), status.alias("status"))
    return ingest.classify(batch, current).groupBy("change", "status").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, 'archived' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def tombstone_anti(spark, d):
    """What a full sync did not see."""
    current = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("active").alias("status"))
    return ingest.tombstones(current, _t(spark, d, "orders").where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("id")).distinct())


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    """Newest row of each key."""
    rows = lifecycle.latest(_t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT * FROM (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey, nullif(o_orderpriority, '1-URGENT') ORDER BY o_orderdate, o_orderkey) AS supersedes_id FROM orders) WHERE supersedes_id IS NOT NULL")
def supersession_chain(spark, d):
    """The next older row of the same title stem and country."""
    o = _t(spark, d, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("customer "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "abcdefghij")).alias("title"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("country"), F.lit("policy").alias("doc_type"), F.lit("active").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return ingest.supersession(docs)


@query("SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON nullif(a.n_regionkey, 0) IS NOT DISTINCT FROM nullif(b.n_regionkey, 0) AND a.n_nationkey < b.n_nationkey")
def null_safe_join(spark, d):
    """Null is a value of its own."""
    n = _t(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(0)).alias("r"))
    a, b = n.select(F.col("n_nationkey").alias("left_key"), F.col("r").alias("ra")), n.select(F.col("n_nationkey").alias("right_key"), F.col("r").alias("rb"))
    return a.join(b, F.col("ra").eqNullSafe(F.col("rb")) & (F.col("left_key") < F.col("right_key"))).select("left_key", "right_key")


_TOPICS = [("grammar", "the"), ("grammar", "of the"), ("motion", "to"), ("place", "in"), ("german", "der"), ("german", "und"), ("french", "les"), ("spanish", "para")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in _TOPICS)


@query(f"""WITH k(topic, keyword) AS (VALUES {_VALUES}),
h AS (SELECT item_id, topic, max(length(keyword)) AS len FROM benchmark, k WHERE regexp_matches(lower(text), '(^|[^a-z])' || keyword || '([^a-z]|$)') GROUP BY 1, 2)
SELECT item_id AS question_id, string_agg(topic, ',' ORDER BY len DESC, topic DESC) AS topics FROM h GROUP BY 1""")
def phrase_match_topics(spark, d):
    """Q1/Q2: topics by longest keyword."""
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = understand.topics(q, _TOPICS)
    return found.select("question_id", F.array_join("topics", ",").alias("topics"))


_TEAMS = [(1, "north", "th"), (2, "south", "on"), (3, "east", "er"), (4, "east", "ing"), (5, "west", "ch"), (6, "west", "qu")]
_TEAM_VALUES = ", ".join(f"({p}, '{c}', '{k}')" for p, c, k in _TEAMS)


@query(f"""WITH r(priority, code, keyword) AS (VALUES {_TEAM_VALUES}),
h AS (SELECT doc_id, code, count(*) AS hits, min(priority) AS p FROM documents, r WHERE contains(lower(text), keyword) GROUP BY 1, 2)
SELECT doc_id AS id, code, hits FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, p) = 1""")
def argmax_category(spark, d):
    """Code with most keywords anywhere in a text, the first of equals."""
    return understand.most_hits(_t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), _TEAMS)


@query(f"""WITH r(priority, code, keyword) AS (VALUES {_TEAM_VALUES}),
h AS (SELECT item_id, arg_min(code, priority) AS code FROM benchmark, r WHERE regexp_matches(lower(text), '(^|[^a-z])' || keyword || '([^a-z]|$)') GROUP BY 1)
SELECT b.item_id AS id, coalesce(h.code, 'none') AS code FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id""")
def priority_rule(spark, d):
    """Q3/Q5: first rule that is met."""
    return understand.first_hit(_t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), _TEAMS, "none")


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


_KNN = """SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) AS sim
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0"""


@query(f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM ({_KNN}) QUALIFY rank <= 15")
def knn_cosine_topk(spark, d):
    """V3-V5: exact nearest neighbours of every hundredth vector."""
    e = _vectors(spark, d)
    found = retrieve.knn(e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), e)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query("""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9€£%]+') AS w FROM benchmark),
h AS (SELECT item_id, md5(g) AS h FROM (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS g FROM t)),
c AS (SELECT item_id, ('0x' || h[1:8])::BIGINT AS a, ('0x' || h[9:16])::BIGINT AS b, ('0x' || h[17:24])::BIGINT AS c, ('0x' || h[25:32])::BIGINT AS d FROM h),
s AS (SELECT item_id, (((a % 768 * 256 + b) % 768 * 256 + c) % 768 * 256 + d) % 768 AS place, sum(CASE WHEN (d >> 20) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM c GROUP BY 1, 2),
n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY 1), i AS (SELECT item_id, unnest(range(768)) AS place FROM benchmark)
SELECT i.item_id, list(coalesce(x / CASE WHEN norm = 0 THEN 1 ELSE norm END, 0) ORDER BY i.place) AS vector FROM i LEFT JOIN s ON i.item_id = s.item_id AND i.place = s.place LEFT JOIN n ON n.item_id = i.item_id GROUP BY 1""")
def hashed_embedding(spark, d):
    """V2: hashed embeddings of the benchmark items (tested against a plain loop)."""
    return v.hashed_embeddings(_t(spark, d, "benchmark"), "item_id", "text")


@query(f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) - 1 AS r FROM ({_KNN}) QUALIFY r < 15),
l AS (SELECT s.query_id, s.chunk_id, row_number() OVER (PARTITION BY s.query_id ORDER BY e.label, s.chunk_id) - 1 AS r FROM s JOIN embeddings e ON e.vec_id = s.chunk_id WHERE e.label > 0)
SELECT query_id, chunk_id, round(sum(w / (20 + r)), 9) AS rrf FROM (SELECT query_id, chunk_id, r, 1.0::DOUBLE AS w FROM s UNION ALL SELECT query_id, chunk_id, r, 0.6::DOUBLE FROM l) GROUP BY 1, 2""")
def rrf_fusion(spark, d):
    """Reciprocal rank fusion of two rankings."""
    e = _vectors(spark, d)
    near = retrieve.knn(e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), e)
    labelled = near.join(e.select("chunk_id", "label"), "chunk_id").where("label > 0")
    second = labelled.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "chunk_id")) - 1)
    a = near.select("query_id", "chunk_id", (F.col("rank") - 1).alias("rank"), F.lit(1.0).alias("weight"))
    return retrieve.fuse(a.unionByName(second.select("query_id", "chunk_id", F.col("r").alias("rank"), F.lit(0.6).alias("weight"))))


_LEX = f"""WITH q AS (SELECT item_id, {_CONTENT.format('text')} AS t FROM benchmark), p AS (SELECT doc_id, {_CONTENT.format('text')} AS t FROM documents),
a AS (SELECT item_id, len(t) AS n, unnest(t) AS w FROM q), b AS (SELECT doc_id, unnest(t) AS w FROM p),
x AS (SELECT item_id AS question_id, doc_id AS passage_id, round(count(*) / any_value(n)::DOUBLE, 6) AS lexical FROM a JOIN b USING (w) GROUP BY 1, 2)"""


def _lexical(spark, d, k):
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), t.content_tokens(F.col("text")).alias("tokens"))
    p = _t(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), t.content_tokens(F.col("text")).alias("tokens"))
    return retrieve.lexical_top(q, p, k).withColumn("lexical", F.round("lexical", 6))


@query(_LEX + " SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, passage_id) AS rank FROM x QUALIFY rank <= 12")
def lexical_overlap_topk(spark, d):
    """Passages that hold most of a question's tokens."""
    return _lexical(spark, d, 12).select("question_id", "passage_id", "lexical", F.col("rank").cast("long").alias("rank"))


@query(_LEX + ", y AS (SELECT question_id, passage_id FROM x QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY lexical DESC, passage_id) = 1)"
       + f""", s AS (SELECT question_id, passage_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM y JOIN documents ON doc_id = passage_id),
z AS (SELECT s.*, len(list_intersect({_CONTENT.format('line')}, q.t)) AS score FROM s JOIN q ON q.item_id = s.question_id)
SELECT question_id, passage_id, line, score::BIGINT AS score FROM z QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) = 1""")
def lead_line(spark, d):
    """K1: the line of the best passage that shares most with the question."""
    best = _lexical(spark, d, 1).drop("rank")
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), t.content_tokens(F.col("text")).alias("q"))
    rows = best.join(_t(spark, d, "documents"), F.col("doc_id") == F.col("passage_id")).join(q, "question_id").select("question_id", "passage_id", "q", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("score", F.size(F.array_intersect(t.content_tokens(F.col("line")), "q")).cast("long"))
    return retrieve.top(rows, ["question_id"], [F.desc("score"), "pos"], 1).select("question_id", "passage_id", "line", "score")


_SAID = "list_distinct(list_concat(list_transform(range(5 + o_orderkey % 40), lambda i: 't' || ((o_orderkey % 3) * 6 + i)), list_transform(range(o_orderkey % 5), lambda i: 'own' || o_orderkey || 'x' || i)))"


@query(f"""WITH x AS (SELECT o_custkey AS c, o_orderkey AS k, {_SAID} AS t FROM orders), w AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY c ORDER BY k) = 1),
p AS (SELECT w.k AS id_a, x.k AS id_b, len(list_intersect(w.t, x.t)) AS m, len(w.t) AS na, len(x.t) AS nb FROM x JOIN w ON x.c = w.c AND x.k <> w.k)
SELECT id_a, id_b FROM p WHERE CASE WHEN least(na, nb) < 20 THEN m / (na + nb - m)::DOUBLE >= 0.75 ELSE m / (na + nb - m)::DOUBLE >= 0.5 OR m / least(na, nb)::DOUBLE >= 0.85 END""")
def duplicate_pairs(spark, d):
    """Texts that duplicate the first one of their group, by Jaccard or containment."""
    k = F.col("o_orderkey")
    words = F.concat(F.transform(F.sequence(F.lit(0), (4 + k % 40).cast("int")), lambda i: F.concat(F.lit("t"), (k % 3) * 6 + i)), F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < k % 5), lambda i: F.concat(F.lit("own"), k, F.lit("x"), i)))
    x = _t(spark, d, "orders").select("o_custkey", k, F.array_join(words, " ").alias("said"))
    first = lifecycle.latest(x, ["o_custkey"], ["o_orderkey"]).select("o_custkey", k.alias("id_a"), t.all_tokens(F.col("said")).alias("a"))
    rows = x.join(first, "o_custkey").where("o_orderkey <> id_a").select("id_a", k.alias("id_b"), "a", t.all_tokens(F.col("said")).alias("b"))
    return rows.where(t.is_duplicate(F.col("a"), F.col("b"))).select("id_a", "id_b")


@query()
def near_duplicate_pairs(spark, d):
    """duplicates among all documents of any length, source and language: classes of equal token sets and links between them (tested by brute force)."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), t.all_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return analyse.duplicate_links(docs)


_RENDER = "l_orderkey, l_linenumber, l_partkey, l_quantity::INT || ' days and ' || (l_quantity::INT % 3) || ' weeks' AS txt"


@query(f"""WITH r AS (SELECT {_RENDER} FROM lineitem) SELECT l_orderkey, l_linenumber, array_to_string(regexp_extract_all(txt, '\\d+ (?:days|weeks)'), '; ') AS facts FROM r""")
def fact_extract(spark, d):
    """numbers with units."""
    return _rendered(spark, d).select("l_orderkey", "l_linenumber", F.array_join(t.numeric_facts(F.col("txt")), "; ").alias("facts"))


def _rendered(spark, d):
    n = F.rint("l_quantity").cast("int")  # halves go to the even number, as in SQL
    txt = F.concat(n.cast("string"), F.lit(" days and "), (n % 3).cast("string"), F.lit(" weeks"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", txt.alias("txt"))


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity::INT AS dd, l_quantity::INT % 3 AS ww FROM lineitem),
w AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1)
SELECT r.l_partkey, r.l_orderkey, r.l_linenumber, (CASE WHEN r.dd <> w.dd THEN 1 ELSE 0 END + CASE WHEN r.ww <> w.ww THEN 1 ELSE 0 END)::BIGINT AS n_differ FROM r JOIN w ON r.l_partkey = w.l_partkey WHERE (r.dd <> w.dd OR r.ww <> w.ww) AND NOT (r.l_orderkey = w.l_orderkey AND r.l_linenumber = w.l_linenumber)""")
def contradiction_pairs(spark, d):
    """Statements whose values differ from the first one about the same part."""
    # a fact has no sign; here it counts
    signed = lambda unit, value: F.when(F.col("txt").contains(F.concat(F.lit("-"), value, F.lit(" "), unit)), F.concat(F.lit("-"), value)).otherwise(value)
    units = F.transform_values(t.by_unit(t.numeric_facts(F.col("txt"))), signed)
    rows = _rendered(spark, d).select("l_partkey", "l_orderkey", "l_linenumber", "txt")
    # nulls come last, and one row is the first even where keys repeat
    order = [x for k in ("l_orderkey", "l_linenumber") for x in (F.col(k).isNull().alias(f"{k}_none"), F.col(k))]
    first = rows.groupBy("l_partkey").agg(F.min(F.struct(*order, "txt")).alias("f"))
    w = first.select("l_partkey", F.col("f.l_orderkey").alias("wk"), F.col("f.l_linenumber").alias("wn"), F.col("f.txt").alias("txt")).withColumn("wu", units).drop("txt")
    r = rows.select("l_partkey", "l_orderkey", "l_linenumber", units.alias("u"))
    differs = F.size(t.contradictions(F.col("wu"), F.col("u"))).cast("long")
    return r.join(w, "l_partkey").where("NOT (l_orderkey = wk AND l_linenumber = wn)").select("l_partkey", "l_orderkey", "l_linenumber", differs.alias("n_differ")).where("n_differ > 0")


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_type LIKE 'PROMO%' THEN 'cost=free' WHEN p_type LIKE 'STANDARD%' THEN 'cost=charged' END, CASE WHEN p_size > 25 THEN 'size=large' END], lambda x: x IS NOT NULL), ',') AS keys FROM part")
def keyfacts_case(spark, d):
    """key facts by first matching pattern."""
    rules = [("cost", [("^PROMO", "free"), ("^STANDARD", "charged")]), ("size", [("(2[6-9]|[3-9][0-9])$", "large")])]
    txt = F.concat_ws(" ", "p_type", F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(t.key_facts(txt, rules), ",").alias("keys"))


_SPEECH = """CASE turn % 6 WHEN 0 THEN text || '?' WHEN 1 THEN 'The old file says 100% is paid.' WHEN 2 THEN 'Is it so? Yes, 5 days.' WHEN 3 THEN 'According to Ann. It is 5 days.' WHEN 4 THEN text || ' This is not covered by the guide.' ELSE text || ' I have not checked this.' END"""
_REPORTED = r"(?i)\b(?:say|says|said|claim|claims|told me|according to)\b[^.]{0,60}[0-9]"


def _speech(spark, d):
    """Turns as questions, reported speech, early questions, non-answers and doubts."""
    return _t(spark, d, "conversations").select("conv_id", "turn", F.expr(_SPEECH).alias("said"))


@query(rf"""WITH x AS (SELECT conv_id, turn, {_SPEECH} AS said FROM conversations), y AS (SELECT *, string_split(regexp_replace(regexp_replace(said, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM x)
SELECT conv_id, turn, said <> '' AND NOT ends_with(s[-1], '?') AND NOT contains(split_part(left(said, 120), '.', 1), '?') AND NOT regexp_matches(said, '{_REPORTED}') AS asserts FROM y""")
def question_detect(spark, d):
    """questions and reported numbers state nothing."""
    return _speech(spark, d).select("conv_id", "turn", t.asserts(F.col("said")).alias("asserts"))


@query(rf"""WITH x AS (SELECT conv_id, turn, lower({_SPEECH}) AS said FROM conversations)
SELECT conv_id, turn, regexp_matches(said, 'does not determine|do not determine|is not determined|not covered by|out of scope|does not cover|must not be used|cannot be used to|is not part of') AS non_answer,
regexp_matches(said, 'old (onboarding )?(note|file|document|material|version)|have not checked|previous process|not (yet )?verified|i believe') AS stale FROM x""")
def claim_flags(spark, d):
    """texts that say themselves that they settle nothing or rest on old material."""
    return _speech(spark, d).select("conv_id", "turn", t.non_answer(F.col("said")).alias("non_answer"), t.says_stale(F.col("said")).alias("stale"))


_HL = "CASE o_orderpriority WHEN '1-URGENT' THEN 90 WHEN '2-HIGH' THEN 120 WHEN '3-MEDIUM' THEN 180 ELSE 365 END"
_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'chat' WHEN '2-HIGH' THEN 'email' WHEN '3-MEDIUM' THEN 'meeting' ELSE 'wiki' END"


def _orders(spark, d):
    """Orders as documents: the priority stands for the type, customers for owners."""
    return _t(spark, d, "orders").withColumn("doc_type", F.expr(_KIND)).withColumn("updated_at", F.to_date("o_orderdate")).withColumn("validated_at", F.when(F.col("o_orderkey") % 4 == 0, F.date_add(F.to_date("o_orderdate"), 100)))


@query(f"SELECT o_orderkey, round(pow(0.5, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') / ({_HL})::DOUBLE), 6) AS freshness FROM orders")
def freshness_decay(spark, d):
    """Decay by half-life."""
    days = trust.age(F.lit(AS_OF).cast("date"), F.col("updated_at"))
    return _orders(spark, d).select("o_orderkey", F.round(trust.freshness(days, trust.half_life(F.col("doc_type"))), 6).alias("freshness"))


@query(f"""WITH a AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE + CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END, DATE '{AS_OF}')::BIGINT AS age, {_HL} AS hl FROM orders)
SELECT o_orderkey, age, age > CAST(floor(hl * 1.2) AS INT) AS review_due FROM a""")
def review_due(spark, d):
    """Effective dates and reviews."""
    return lifecycle.due(_orders(spark, d), AS_OF).select("o_orderkey", F.col("age").cast("long").alias("age"), "review_due")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 0.55 ELSE 0.15 END WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.35 END::DOUBLE AS owner FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def owner_score_case(spark, d):
    """Owners and authors."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") >= 0).alias("alive"))
    o = _t(spark, d, "orders").join(c, "o_custkey", "left")
    owner = F.when(F.col("o_orderkey") % 9 != 0, F.col("alive"))
    return o.select("o_orderkey", trust.owner(owner, F.when(F.col("o_orderkey") % 2 == 0, True)).cast("double").alias("owner"))


@query("""SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN least(1.0, 0.8 + x) WHEN n_regionkey = 1 THEN least(1.0, 1.0 + x) ELSE 0.0 END::DOUBLE AS scope FROM (SELECT c_custkey, n_regionkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1 ELSE 0.0 END AS x FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def scope_mask(spark, d):
    """Scope by country, region 0 standing for global and region 1 for what is asked."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.nullif("n_regionkey", F.lit(0)).alias("country"))
    c = _t(spark, d, "customer").join(n, "c_nationkey")
    return c.select("c_custkey", F.round(trust.scope(F.col("country"), F.lit(1), F.col("c_mktsegment") == "BUILDING"), 6).cast("double").alias("scope"))


_TRUST = f"""WITH x AS (SELECT o_orderkey, o_custkey, pow(0.5, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') / ({_HL})::DOUBLE) AS f,
CASE WHEN c_acctbal >= 0 THEN 1.0 ELSE 0.35 END::DOUBLE AS o, CASE {_KIND} WHEN 'chat' THEN 0.5 WHEN 'email' THEN 0.55 WHEN 'meeting' THEN 0.75 ELSE 0.8 END::DOUBLE AS c,
CASE WHEN o_orderstatus = 'F' THEN 0.15 ELSE 1.0 END::DOUBLE AS s, n_regionkey <> 4 AS ok FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
tr AS (SELECT o_orderkey, o_custkey, f, o, c, s, ok, round(CASE WHEN ok THEN 0.3::DOUBLE * f + 0.2::DOUBLE * o + 0.15::DOUBLE * 0.3::DOUBLE + 0.15::DOUBLE * c + 0.2::DOUBLE * s ELSE 0 END, 3) AS trust FROM x)"""


def _trusted(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") >= 0).alias("alive"), (F.col("n_regionkey") != 4).alias("ok"))
    o = _orders(spark, d).join(c, "o_custkey")
    f = trust.freshness(trust.age(F.lit(AS_OF).cast("date"), F.col("updated_at")), trust.half_life(F.col("doc_type")))
    s = F.when(F.col("o_orderstatus") == "F", 0.15).otherwise(F.lit(1.0))
    own = trust.owner(F.col("alive"), F.lit(None).cast("boolean"))
    return o.withColumn("owner", own).withColumn("channel", trust.channel(F.col("doc_type"))).withColumn("trust", trust.total(f, own, trust.authority(F.lit(None).cast("double")), F.col("channel"), s, F.col("ok")))


@query(_TRUST + " SELECT o_orderkey, trust FROM tr")
def trust_total(spark, d):
    """Weighted total under the mask of scope."""
    return _trusted(spark, d).select("o_orderkey", "trust")


_REL = "round(((o_orderkey * 7919) % 1000) / 1000.0, 3)::DOUBLE"


@query(_TRUST + f""", r AS (SELECT tr.*, {_REL} AS rel FROM tr) SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN rel >= 0.35 AND o_orderkey % 11 = 0 AND ok THEN 'disclaimer'
WHEN o_orderkey % 13 = 0 THEN CASE WHEN rel >= 0.35 AND o_orderkey % 2 = 0 THEN 'unofficial' END WHEN NOT ok THEN CASE WHEN rel >= 0.35 AND o_orderkey % 2 = 0 THEN 'out_of_scope' END
WHEN s < 1 THEN CASE WHEN rel >= 0.35 AND o_orderkey % 2 = 0 THEN 'outdated' END ELSE 'usable' END AS bucket FROM r) GROUP BY 1""")
def bucket_router(spark, d):
    """Where candidates go."""
    k = F.col("o_orderkey")
    rel = F.round(((k * 7919) % 1000) / 1000, 3)
    b = trust.bucket(k % 11 == 0, rel, F.col("ok"), k % 13 == 0, F.col("o_orderstatus") == "F", k % 2 == 0)
    return _trusted(spark, d).select(b.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(_TRUST + f""", r AS (SELECT tr.*, {_REL} AS rel, o_orderdate::DATE AS day FROM tr JOIN orders USING (o_orderkey)),
g AS (SELECT *, rel >= 0.5 AND rel >= max(rel) OVER (PARTITION BY tr_cust) - 0.2::DOUBLE AND o = 1 AND c >= 0.75 AS fit FROM (SELECT *, o_custkey AS tr_cust FROM r))
SELECT tr_cust AS o_custkey, o_orderkey FROM g QUALIFY row_number() OVER (PARTITION BY tr_cust ORDER BY fit DESC, CASE WHEN fit THEN (o_orderkey % 3 = 0)::INT ELSE 0.5 * rel + 0.5 * trust END DESC,
CASE WHEN fit THEN epoch(day) ELSE 0 END DESC, CASE WHEN fit THEN trust ELSE 0 END DESC, CASE WHEN fit THEN rel ELSE 0 END DESC, o_orderkey) = 1""".replace("FROM tr JOIN orders USING (o_orderkey))", "FROM tr JOIN (SELECT o_orderkey, o_orderdate FROM orders) USING (o_orderkey))"))
def winner_pick(spark, d):
    """C4: the winner of each cluster."""
    k = F.col("o_orderkey")
    rows = _trusted(spark, d).withColumn("relevance", F.round(((k * 7919) % 1000) / 1000, 3)).withColumn("official", k % 3 == 0).withColumn("chunk_id", k)
    return analyse.winners(rows, ["o_custkey"]).select("o_custkey", "o_orderkey")


_EV = "CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 1.0 ELSE 0.5 END::DOUBLE"


@query(f"SELECT user_id, count(*) AS events, round(sum({_EV} * pow(0.5, date_diff('day', ts::DATE, DATE '2024-01-31') / 365.0::DOUBLE)), 6) AS raw FROM events GROUP BY 1")
def reputation_events(spark, d):
    """Decayed weights of events."""
    return _reputation(spark, d).select("user_id", "events", F.round("s", 6).alias("raw"))


def _reputation(spark, d):
    w = trust.lookup({"purchase": 2.0, "click": 1.0}, F.col("event_type"), 0.5)
    decayed = w * F.pow(F.lit(0.5), F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) / 365)
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.sum(decayed).alias("s"))


@query(f"""WITH r AS (SELECT user_id, sum({_EV} * pow(0.5, date_diff('day', ts::DATE, DATE '2024-01-31') / 365.0::DOUBLE)) AS s FROM events GROUP BY 1)
SELECT user_id, round(100 * (1 - exp(-round(s, 6) / 2500)))::INT AS score FROM r ORDER BY score DESC, user_id LIMIT 20""")
def expert_ranking(spark, d):
    """The best by normalised reputation (a top-k report)."""
    score = F.round(100 * (1 - F.exp(-F.round(F.col("s"), 6) / 2500))).cast("int")
    return _reputation(spark, d).select("user_id", score.alias("score")).orderBy(F.desc("score"), "user_id").limit(20)


@query("""SELECT 'customer:' || o_custkey AS src, 'ordered' AS rel, 'order:' || o_orderkey AS dst FROM orders
UNION SELECT 'supplier:' || l_suppkey, 'supplied', 'part:' || l_partkey FROM lineitem UNION SELECT 'order:' || l_orderkey, 'holds', 'part:' || l_partkey FROM lineitem""")
def graph_links(spark, d):
    """Links of one hop."""
    node = lambda k, c: F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    a = o.select(node("customer", "o_custkey").alias("src"), F.lit("ordered").alias("rel"), node("order", "o_orderkey").alias("dst"))
    b = li.select(node("supplier", "l_suppkey").alias("src"), F.lit("supplied").alias("rel"), node("part", "l_partkey").alias("dst"))
    c = li.select(node("order", "l_orderkey").alias("src"), F.lit("holds").alias("rel"), node("part", "l_partkey").alias("dst"))
    return a.union(b.distinct()).union(c.distinct())


@query()
def leader_clusters(spark, d):
    """C11: greedy clusters of each hundred vectors' nearest neighbours, by vectors, words and key facts (tested against plain loops)."""
    e = _vectors(spark, d)
    near = retrieve.knn(e.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), e, 12)
    k = F.col("chunk_id")
    said = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), t.all_tokens(F.substring_index("text", "\n", 2)).alias("tokens"))
    # documents of two passages, topics of several labels, countries of some, and key facts of every fifth
    rows = near.join(e, "chunk_id").join(said, "chunk_id").select(
        F.col("query_id").alias("sub_id"), "chunk_id", F.floor(k / 2).alias("doc_id"), F.col("sim").alias("relevance"), F.array(F.lit("all"), F.col("label").cast("string")).alias("topics"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "BE").otherwise(F.when(k % 2 == 0, "BE").otherwise("NL")).alias("country"), "tokens", "vector", F.when(k % 5 == 0, F.array(F.lit("cost"))).otherwise(F.array().cast("array<string>")).alias("keys"),
    )
    return analyse.leader_clusters(rows)


_ST = "CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'contested' ELSE 'partial' END ELSE 'missing' END"


@query(f"""WITH s AS (SELECT o_custkey AS question_id, {_ST} AS status, o_orderkey % 100 AS c FROM orders)
SELECT question_id, round(avg(c), 2) AS confidence, count(*) AS n_parts, CASE WHEN bool_and(status = 'answered') THEN 'Grounded answer'
WHEN bool_or(status IN ('answered', 'contested', 'informal')) AND bool_or(status IN ('missing', 'partial')) THEN 'Partial answer, gap highlighted' WHEN bool_or(status = 'contested') THEN 'Grounded answer, conflict flagged'
WHEN bool_or(status = 'informal') THEN 'Answer from informal sources' WHEN bool_and(status = 'missing') THEN 'No grounded answer found' ELSE 'Low confidence answer' END AS verdict FROM s GROUP BY 1""")
def status_verdict(spark, d):
    """K5/K9: verdict over the statuses of parts."""
    s = _t(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), F.expr(_ST).alias("status"), (F.col("o_orderkey") % 100).alias("confidence"))
    return answer.verdict(s)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn FROM lineitem), a AS (SELECT *, min(rn) OVER (PARTITION BY l_orderkey, l_suppkey) AS f FROM n)
SELECT l_orderkey, l_linenumber, 'E' || dense_rank() OVER (PARTITION BY l_orderkey ORDER BY f) AS cite_id FROM a""")
def citation_ids(spark, d):
    """K6: citation numbers in order of first use."""
    return answer.cite(_t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_suppkey"], "l_suppkey").select("l_orderkey", "l_linenumber", "cite_id")


@query(f"""WITH x AS (SELECT o_orderkey AS k, CASE o_orderkey % 10 WHEN 3 THEN NULL WHEN 4 THEN -o_orderkey ELSE o_custkey END AS owner_id, CASE WHEN o_orderkey % 20 <> 3 THEN o_custkey END AS author_id,
date_diff('day', o_orderdate::DATE + CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END, DATE '{AS_OF}') AS age FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_orderkey % 9 NOT IN (0, 1)),
y AS (SELECT x.*, c_acctbal >= 0 AS alive FROM x LEFT JOIN customer ON owner_id = c_custkey),
z AS (SELECT *, CASE WHEN NOT alive THEN 'reassign_owner' WHEN age > 438 AND (alive OR (owner_id IS NULL AND author_id IS NOT NULL)) THEN 'confirm_valid' END AS kind FROM y)
SELECT kind, k AS document_id, CASE WHEN kind = 'confirm_valid' THEN coalesce(owner_id, author_id) END AS assignee_id,
CASE kind WHEN 'reassign_owner' THEN 'Owner has left the company; document needs a new owner' ELSE 'Not edited or confirmed for ' || age || ' days (review period 438 days). Still valid?' END AS note
FROM z WHERE kind IS NOT NULL AND NOT (k % 6 = 0 AND kind = 'reassign_owner') AND NOT (k % 6 = 1 AND kind = 'confirm_valid')""")
def sweep_tasks(spark, d):
    """L2: tasks for reviews and owners of active documents, without those of a kind that is open."""
    k = F.col("o_orderkey")
    status = F.when(k % 9 == 0, "archived").when(k % 9 == 1, "retracted").when(k % 9 == 2, "needs_update").otherwise("active")
    owner = F.when(k % 10 == 3, F.lit(None)).when(k % 10 == 4, -k).otherwise(F.col("o_custkey"))  # none, unknown, known
    author = F.when(k % 20 != 3, F.col("o_custkey"))
    docs = _orders(spark, d).select(k.alias("id"), status.alias("status"), owner.alias("owner_id"), author.alias("author_id"), "doc_type", "updated_at", "validated_at")
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") >= 0).alias("active"))
    open_ = docs.where("id % 6 < 2").select(F.col("id").alias("document_id"), F.when(F.col("id") % 6 == 0, "reassign_owner").otherwise("confirm_valid").alias("kind"), F.lit(False).alias("done"))
    return lifecycle.sweep(docs, people, open_, AS_OF)


@query(f"""WITH x AS (SELECT date_diff('day', o_orderdate::DATE + CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE 0 END, DATE '{AS_OF}') AS age, {_KIND} AS kind FROM orders)
SELECT count(*) AS documents, count(*) FILTER (age <= 180) AS fresh, count(*) FILTER (kind = 'wiki' AND age > 438) AS overdue, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_tasks FROM x""")
def freshness_overview(spark, d):
    """L3: counts over documents and tasks."""
    return lifecycle.overview(_orders(spark, d), _t(spark, d, "orders").select((F.col("o_orderstatus") != "O").alias("done")), AS_OF)


@query("SELECT o_custkey AS document_id, CASE arg_max(o_orderpriority, o_orderkey) WHEN '1-URGENT' THEN 'retracted' WHEN '2-HIGH' THEN 'archived' WHEN '3-MEDIUM' THEN 'needs_update' ELSE 'active' END AS status FROM orders GROUP BY 1")
def current_status(spark, d):
    """L4: the status that a log of actions leaves."""
    action = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'retract' WHEN '2-HIGH' THEN 'archive' WHEN '3-MEDIUM' THEN 'request_update' WHEN '5-LOW' THEN 'validate' ELSE 'restore' END")
    return lifecycle.current_status(_t(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("seq"), action.alias("action")))


@query("SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))::BIGINT AS n_stripped FROM pages")
def html_strip(spark, d):
    """Headings, paragraphs and text without tags."""
    from ..sources.connectors import strip_tags

    p = _t(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1).alias("h1"), (F.size(F.split("html", "<p>")) - 1).cast("long").alias("n_paragraphs"), F.length(strip_tags(F.col("html"))).cast("long").alias("n_stripped"))


# Lines of every kind that a transcript has: time and speaker before a decision, an owner in brackets, a speaker, an agreement, a dash, and words that only look like an action.
_LINE = """CASE turn % 6 WHEN 0 THEN '[00:01:02] Ann: Decision: ' || said WHEN 1 THEN 'Action (Bob K.): ' || said WHEN 2 THEN upper(role) || ': ' || said WHEN 3 THEN '9:15 Mary-Ann: we agreed ' || said WHEN 4 THEN 'to do - ' || said ELSE 'Action movies are fun, ' || said END"""
_TIME = r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?"
_LINES = f"""t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS said FROM conversations), l AS (SELECT conv_id, turn, trim({_LINE}) AS line FROM t WHERE said <> ''),
c AS (SELECT *, regexp_matches(line, '(?i){_TIME}(?:[\\w .''-]+:\\s*)?(?:decision|decided|we agreed|agreed)\\s*[:\\-–]?\\s*(.+)$') AS d, regexp_matches(line, '(?i){_TIME}(?:[\\w .''-]+:\\s*)?(?:action|todo|to do|next step)\\s*(?:\\(([^)]+)\\))?\\s*[:\\-–]\\s*(.+)$') AS a FROM l),
k AS (SELECT *, CASE WHEN d THEN 'Decision: ' || rtrim(regexp_extract(line, '(?i){_TIME}(?:[\\w .''-]+:\\s*)?(?:decision|decided|we agreed|agreed)\\s*[:\\-–]?\\s*(.+)$', 1), '.') || '.'
 WHEN a THEN 'Action' || CASE WHEN regexp_matches(line, '(?i){_TIME}(?:[\\w .''-]+:\\s*)?(?:action|todo|to do|next step)\\s*\\(') THEN ' (Bob K.)' ELSE '' END || ': ' || rtrim(regexp_extract(line, '(?i){_TIME}(?:[\\w .''-]+:\\s*)?(?:action|todo|to do|next step)\\s*(?:\\(([^)]+)\\))?\\s*[:\\-–]\\s*(.+)$', 2), '.') || '.' END AS item,
 CASE WHEN NOT d AND NOT a THEN nullif(regexp_extract(line, '{_TIME}([A-Z][\\w .''-]+?):\\s*(.+)$', 1), '') END AS speaker FROM c)"""


def _calls(spark, d):
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    lines = _t(spark, d, "conversations").select("conv_id", "turn", "role", said.alias("said")).where("said <> ''").select("conv_id", "turn", F.expr(_LINE).alias("line"))
    calls = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("transcript"))
    return calls.select(F.col("conv_id").alias("id"), F.lit("call").alias("subject"), "transcript")


@query(f"""WITH {_LINES} SELECT conv_id, count(*) FILTER (d) AS n_decisions, count(*) FILTER (a AND NOT d) AS n_actions, count(DISTINCT speaker) AS n_speakers FROM k GROUP BY 1""")
def transcript_extract(spark, d):
    """Decisions, actions and speakers of transcripts."""
    from ..sources.connectors import meetings

    out = meetings(_calls(spark, d))
    return out.select(F.col("external_id").alias("conv_id"), F.size("decisions").cast("long").alias("n_decisions"), F.size("actions").cast("long").alias("n_actions"), F.size("speakers").cast("long").alias("n_speakers"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS total FROM events GROUP BY 1")
def json_props(spark, d):
    """Values inside JSON."""
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("total"))


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events")
def health_counts(spark, d):
    """Row counts."""
    n = lambda name: _t(spark, d, name).agg(F.count("*").alias(name if name != "customer" else "customers"))
    return n("orders").crossJoin(n("customer")).crossJoin(n("documents")).crossJoin(n("events"))


_PASSAGE = """p AS (SELECT o_custkey AS sub_id, o_orderkey AS chunk_id, o_orderkey % 3 AS doc_id, o_orderpriority AS topic, o_orderstatus AS st, o_orderdate::DATE AS day, o_orderkey % 7 AS dd, o_orderkey % 4 AS ww,
  round(((o_orderkey * 7919) % 1000) / 1000.0, 3)::DOUBLE AS relevance FROM orders)"""
_DIFFER = "(CASE WHEN a.dd <> b.dd THEN 1 ELSE 0 END + CASE WHEN a.ww <> b.ww THEN 1 ELSE 0 END)::BIGINT"


def _passages(spark, d):
    """Orders as passages of their customer's question."""
    k = F.col("o_orderkey")
    text = F.concat((k % 7).cast("string"), F.lit(" days and "), (k % 4).cast("string"), F.lit(" weeks"))
    return _orders(spark, d).select(
        F.col("o_custkey").alias("sub_id"), k.alias("chunk_id"), (k % 3).alias("doc_id"), F.array("o_orderpriority").alias("topics"), F.col("o_orderstatus").alias("st"), text.alias("text"),
        F.round(((k * 7919) % 1000) / 1000, 3).alias("relevance"), "updated_at", "doc_type",
    )


@query(f"""WITH {_PASSAGE}, k AS (SELECT *, list_distinct([dd::VARCHAR, 'days', 'and', ww::VARCHAR, 'weeks']) AS tk FROM p),
m AS (SELECT a.sub_id, a.chunk_id, b.chunk_id AS resembles, len(list_intersect(a.tk, b.tk))::DOUBLE / len(list_distinct(list_concat(a.tk, b.tk))) AS j, {_DIFFER} AS n FROM k a JOIN k b ON a.sub_id = b.sub_id AND a.topic = b.topic WHERE a.st = 'P' AND b.st <> 'P'),
f AS (SELECT * FROM m WHERE j >= 0.2 QUALIFY row_number() OVER (PARTITION BY sub_id, chunk_id ORDER BY j DESC, resembles) = 1)
SELECT p.sub_id, p.chunk_id, resembles, round(j, 6) AS jaccard, n AS n_differ FROM p LEFT JOIN f ON p.sub_id = f.sub_id AND p.chunk_id = f.chunk_id WHERE p.st = 'P'""")
def unofficial_resemblance(spark, d):
    """What unofficial passages resemble, and where they differ."""
    p = _passages(spark, d)
    out = analyse.resemblance(p.where("st = 'P'"), p.where("st <> 'P'"))
    return out.select("sub_id", "chunk_id", "resembles", F.round("jaccard", 6).alias("jaccard"), F.when(F.col("differs").isNotNull(), F.size("differs")).cast("long").alias("n_differ"))


@query(f"""WITH {_PASSAGE}, m AS (SELECT a.sub_id, a.doc_id, a.chunk_id, b.chunk_id AS other_id, a.relevance, {_DIFFER} AS n FROM p a JOIN p b ON a.sub_id = b.sub_id AND a.doc_id = b.doc_id AND a.chunk_id <> b.chunk_id
WHERE a.st <> 'F' AND a.relevance >= 0.5 AND b.chunk_id % 11 <> 0), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY sub_id, doc_id, least(chunk_id, other_id), greatest(chunk_id, other_id) ORDER BY relevance DESC, chunk_id) = 1)
SELECT sub_id, doc_id, chunk_id, other_id, n AS n_differ FROM f WHERE n > 0 AND other_id % 5 <> 0""")
def document_contradictions(spark, d):
    """Contradictions inside a document."""
    k = F.col("chunk_id")
    p = _passages(spark, d).withColumn("usable", F.col("st") != "F").withColumn("disclaims", k % 11 == 0)
    p = p.withColumn("text", F.concat("text", F.when(k % 5 == 0, "?").otherwise(".")))
    return analyse.inside_document(p).select("sub_id", "doc_id", "chunk_id", "other_id", F.size("differs").cast("long").alias("n_differ"))


_TYPE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'policy' WHEN '2-HIGH' THEN 'wiki' WHEN '3-MEDIUM' THEN 'chat' ELSE 'manual' END"


@query(f"""WITH x AS (SELECT o_custkey, o_orderkey, {_TYPE} AS t, o_orderkey % 2 AS o, o_orderkey % 3 AS au, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS f, o_orderkey % 5 = 0 AS old FROM orders),
w AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
c AS (SELECT *, CASE t WHEN 'policy' THEN 1.0 WHEN 'wiki' THEN 0.8 WHEN 'chat' THEN 0.5 ELSE 0.9 END AS ch FROM x)
SELECT l.o_orderkey, 'Preferred because ' || coalesce(nullif(concat_ws(', ', CASE WHEN w.o > l.o THEN 'it has an accountable owner' END,
CASE WHEN w.t IN ('policy', 'manual') AND l.t NOT IN ('policy', 'manual') THEN 'an official ' || w.t || ' leads over a ' || l.t || ' (knowledge governance policy)' WHEN k.ch > l.ch THEN 'a ' || w.t || ' outranks a ' || l.t END,
CASE WHEN w.au > l.au THEN 'its owner has more recorded expertise on this topic' END, CASE WHEN w.f > l.f THEN 'it is more recent' END, CASE WHEN l.old THEN 'the rejected source says itself that it relies on old material' END), ''), 'it scores higher overall')
|| CASE WHEN l.f > w.f THEN ', even though the rejected source is newer' ELSE '' END || '.' AS reason FROM c l JOIN w ON l.o_custkey = w.o_custkey JOIN c k ON k.o_orderkey = w.o_orderkey WHERE l.o_orderkey <> w.o_orderkey""")
def preference_reasons(spark, d):
    """Why the first of a customer's orders is preferred to the others."""
    k = F.col("o_orderkey")
    x = _t(spark, d, "orders").withColumn("doc_type", F.expr(_TYPE))
    side = F.struct(
        (k % 2).alias("owner"), trust.channel(F.col("doc_type")).alias("channel"), (k % 3).alias("authority"), F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")).alias("freshness"), "doc_type",
        F.when(k % 5 == 0, "This is taken from an old note.").otherwise("Valid.").alias("text"),
    )
    x = x.select("o_custkey", k, side.alias("side"))
    first = x.groupBy("o_custkey").agg(F.min_by("side", "o_orderkey").alias("w"), F.min("o_orderkey").alias("of"))
    return x.join(first, "o_custkey").where("o_orderkey <> of").select("o_orderkey", analyse.reason(F.col("w"), F.col("side")).alias("reason"))


@query(f"""WITH {_PASSAGE}, q AS (SELECT *, min(chunk_id) OVER (PARTITION BY sub_id) AS pc, CASE topic WHEN '1-URGENT' THEN 'chat' WHEN '2-HIGH' THEN 'email' WHEN '3-MEDIUM' THEN 'meeting' ELSE 'wiki' END AS kind FROM p),
e AS (SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY relevance DESC, chunk_id) AS rank FROM q WHERE chunk_id <> pc),
f AS (SELECT e.*, p.day AS pday FROM e JOIN p ON e.pc = p.chunk_id WHERE rank <= 3 AND e.doc_id <> p.doc_id QUALIFY row_number() OVER (PARTITION BY e.sub_id, e.doc_id ORDER BY rank) = 1)
SELECT sub_id, chunk_id, rank, CASE WHEN chunk_id % 2 = 0 THEN CASE WHEN day < pday AND kind IN ('chat', 'email', 'ticket') THEN 'earlier' ELSE 'confirms' END ELSE 'supporting' END AS kind FROM f""")
def extra_segments(spark, d):
    """K4: further passages of an answer and what they add."""
    first = F.min("chunk_id").over(Window.partitionBy("sub_id"))
    p = _passages(spark, d).withColumn("score", F.col("relevance")).withColumn("first", first).withColumn("is_primary", F.col("chunk_id") == F.col("first"))
    p = p.withColumn("supports", F.when(F.col("chunk_id") % 2 == 0, F.col("first")))
    return answer.segments(p).select("sub_id", "chunk_id", "rank", "kind")


@query(f"""WITH {_PASSAGE}, r AS (SELECT *, sub_id % 100 AS question_id, row_number() OVER (PARTITION BY sub_id ORDER BY relevance DESC, chunk_id) AS rank FROM p)
SELECT question_id, doc_id, sub_id, chunk_id FROM r WHERE rank <= 3 AND st = 'F' QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY sub_id, rank) = 1""")
def stale_documents(spark, d):
    """K7: documents past review among those that answer."""
    p = _passages(spark, d).withColumn("score", F.col("relevance")).withColumn("stale", F.col("st") == "F").withColumn("question_id", F.col("sub_id") % 100)
    return answer.stale(p).select("question_id", "doc_id", "sub_id", "chunk_id")


@query(f"""WITH {_PASSAGE}, o AS (SELECT sub_id, count(*) AS n, string_agg('order ' || chunk_id || ' (' || year(day) || ')', ', ' ORDER BY relevance DESC, chunk_id) AS s FROM p WHERE st = 'F' GROUP BY 1)
SELECT sub_id, 'Yes: ' || n || ' older version(s) still exist and are excluded from answers: ' || s || '.' AS note FROM o WHERE sub_id % 2 = 0""")
def version_notes(spark, d):
    """K8: notes on older versions where they are asked for."""
    p = _passages(spark, d)
    old = p.where("st = 'F'").select("sub_id", F.col("chunk_id").alias("doc_id"), F.concat(F.lit("order "), F.col("chunk_id").cast("string")).alias("title"), "updated_at", "relevance")
    asked = p.select("sub_id").distinct().withColumn("question", F.when(F.col("sub_id") % 2 == 0, "Which versions exist?").otherwise("What conversions?"))
    return answer.version_notes(asked, old)


@query("""SELECT o_orderpriority AS doc_id, o_custkey AS person_id, c_name AS name, c_acctbal >= 0 AS active, string_agg(o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m-%d'), ', ' ORDER BY o_orderdate, o_orderstatus) AS acts
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def provenance_by_person(spark, d):
    """Links of documents by person."""
    o = _t(spark, d, "orders").select(F.col("o_orderpriority").alias("doc_id"), F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("rel"), F.to_date("o_orderdate").alias("at"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") >= 0).alias("active"))
    return reputation.provenance(o, people).select("doc_id", "person_id", "name", "active", F.array_join("acts", ", ").alias("acts"))


_EXPERTS = "s AS (SELECT ts::DATE AS question_id, user_id AS person_id, round(max(value), 2) AS score, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS here FROM events GROUP BY 1, 2)"


def _sections(spark, d):
    here = F.when(F.col("user_id") % 3 == 0, True).when(F.col("user_id") % 3 == 1, False)
    return _t(spark, d, "events").select(F.to_date("ts").alias("question_id"), F.col("user_id").alias("person_id"), F.round("value", 2).alias("score"), here.alias("in_country"))


@query(f"WITH {_EXPERTS} SELECT question_id, person_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, person_id) AS rank FROM s QUALIFY rank <= 4")
def merged_experts(spark, d):
    """A question's four best experts over its sections."""
    return reputation.merge_experts(_sections(spark, d)).select("question_id", "person_id", "score", "rank")


@query(f"""WITH {_EXPERTS}, m AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, person_id) AS rank FROM s QUALIFY rank <= 4)
SELECT question_id, person_id FROM m QUALIFY coalesce(here, true) OR NOT bool_or(coalesce(here, true)) OVER (PARTITION BY question_id)""")
def local_experts(spark, d):
    """Experts in the country, or all where there are none."""
    return reputation.prefer_local(reputation.merge_experts(_sections(spark, d))).select("question_id", "person_id")
