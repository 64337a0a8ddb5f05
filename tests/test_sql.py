"""The same rows through SQL as through the operators."""

import random

from pyspark.sql import functions as F

from trustweave import sql
from trustweave.functions import text
from trustweave.operators import ask, search, understand

PARTS = ["Notice is 5 working days.", "He said 'yes'! (Sure.)", "€ 12,50 or 3,5 percent?", "A correction run is free of charge.", "no exceptions", "£5 per week", "x\n\n y", "30  calendar days and 2 weeks.", "Is it? 7 Years.", "\"Quoted.\" It's", "über 8 hours."]


def test_functions_equal_the_columns(spark):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choices(PARTS, k=draw.randint(0, 6)))) for i in range(150)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    docs.createOrReplaceTempView("sql_docs")
    assert "tw_facts" in sql.register(spark)
    got = lambda f, *c: sorted(map(tuple, spark.sql(f"SELECT id, f.* FROM sql_docs, LATERAL tw_{f}(sql_docs.text) f").collect()))
    want = lambda e: sorted(map(tuple, docs.where("text IS NOT NULL").select("id", F.posexplode(e)).collect()))
    x = F.col("text")
    assert got("sentences") == want(text.sentences(x)) and got("sentences_any") == want(text.sentences_any(x))
    facts = docs.where("text IS NOT NULL").select("id", F.posexplode(text.facts(x)).alias("pos", "f")).select("id", "pos", "f", text.unit_of(F.col("f")), text.value_of(F.col("f")))
    assert got("facts") == sorted(map(tuple, facts.collect())) and len(got("facts")) > 200
    assert got("content_tokens") == sorted((i, x) for i, _, x in want(text.content_tokens(x)))
    plan = spark.sql("SELECT f.* FROM sql_docs, LATERAL tw_facts(sql_docs.text) f")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan  # expanded where it is called


def test_views_of_topics_searches_and_answers(spark):
    asked = spark.createDataFrame([(1, "What is the notice period?")], "question_id long, question string")
    asked.createOrReplaceTempView("sql_asked")
    rules = ask.Rules(topics=[("notice", "notice period")])
    sql.topics_view(spark, "sql_asked", rules.topics)
    assert spark.table("tw_topics").collect() == understand.topics(asked, rules.topics).collect()
    passages = spark.createDataFrame([(1, "notice period"), (2, "other")], "passage_id long, text string")
    passages.createOrReplaceTempView("sql_passages")
    asked.withColumnRenamed("question", "text").createOrReplaceTempView("sql_searches")
    sql.search_view(spark, "sql_searches", "sql_passages")
    assert spark.table("tw_found").collect() == search.ranked(spark.table("sql_searches"), search.postings(passages), passages).collect()
    docs = spark.createDataFrame(
        [("d", "Notice", "policy", None, None, ["notice"], "p", "p", "2026-09-01", None, True, None, "active"), ("e", "Gone", "policy", None, None, ["notice"], "p", "p", "2026-09-01", None, True, None, "retracted")],
        "id string, title string, doc_type string, country string, client string, topics array<string>, owner_id string, author_id string, updated_at string, validated_at string, date_known boolean, supersedes_id string, status string",
    ).withColumn("updated_at", F.to_date("updated_at")).withColumn("validated_at", F.to_date("validated_at"))
    chunks = spark.createDataFrame([(1, "d", "Rule", "The notice period is 6 weeks.", ["notice"]), (2, "e", "Rule", "The notice period is 9 weeks.", ["notice"])], "chunk_id long, document_id string, section string, text string, topics array<string>")
    people = spark.createDataFrame([("p", "Pat", "Lead", True, 3)], "id string, name string, role string, active boolean, seniority_years int")
    edges = spark.createDataFrame([("p", "owns", "doc", "d", None)], "person_id string, rel string, dst_kind string, dst_id string, at date").withColumn("at", F.lit("2026-09-01").cast("date"))
    corpus = ask.Corpus(chunks, docs, people, edges)
    sql.views(spark, corpus)
    assert [r.chunk_id for r in spark.sql("SELECT chunk_id FROM tw_passages").collect()] == [1]
    sql.answers(spark, "sql_asked", corpus, rules, as_of="2026-09-30")
    assert [tuple(r) for r in spark.sql("SELECT s.status, s.lead, v.verdict FROM tw_sections s JOIN tw_verdicts v USING (question_id)").collect()] == [("answered", "The notice period is 6 weeks.", "Grounded answer")]
