"""The engine's functions in SQL: table functions that Spark expands where they are called, views of a corpus, and answers to a table of questions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import text as t
from .operators import ask, search, understand


def _lit(said: str) -> str:
    return "'" + said.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _space(c: str) -> str:
    return f"trim(regexp_replace({c}, {_lit(chr(92) + 's+')}, ' '))"


def _split(c: str, pattern: str) -> str:
    return f"filter(split({_space(c)}, {_lit(pattern)}), x -> x <> '')"


def _key_facts() -> str:
    cases = [f"CASE {' '.join(f'WHEN lower(t) RLIKE {_lit(p)} THEN {_lit(key + chr(61) + value)}' for p, value in options)} END" for key, options in t.KEY_FACTS]
    return f"array_compact(array({', '.join(cases)}))"


def _numeric_facts() -> str:
    low = f"translate({_space('lower(x)')}, ',', '.')"
    return f"transform(regexp_extract_all(t, {_lit(t.FACT)}, 1), x -> replace(regexp_replace({low}, '(?:calendar|working) days', 'days'), 'percent', '%'))"


_NAMED = "contains({0}, '=') AND NOT {0} RLIKE '^[0-9]'"
_UNIT = f"CASE WHEN {_NAMED.format('f')} THEN substring_index(f, '=', 1) WHEN f RLIKE '^[€£]' THEN substring(f, 1, 1) ELSE trim(regexp_replace(f, {_lit('^[' + chr(92) + 'd.]+' + chr(92) + 's*')}, '')) END"
_VALUE = f"CASE WHEN {_NAMED.format('f')} THEN regexp_replace(f, '^[^=]*=', '') ELSE regexp_extract(f, {_lit('(' + chr(92) + 'd[' + chr(92) + 'd.]*)')}, 1) END"

#: Table functions: name -> (columns that are returned, the query over the text t).
FUNCTIONS = {
    "sentences": ("pos INT, sentence STRING", "SELECT pos, s FROM (SELECT posexplode(" + _split("t", r"(?<=[.!?])\s+(?=[A-Z0-9€£\"'(])") + ") AS (pos, s))"),
    "sentences_any": ("pos INT, sentence STRING", "SELECT pos, s FROM (SELECT posexplode(" + _split("t", r"(?<=[.!?])\s+") + ") AS (pos, s))"),
    "facts": ("pos INT, fact STRING, unit STRING, value STRING", f"SELECT pos, f, {_UNIT}, {_VALUE} FROM (SELECT posexplode(array_distinct(concat({_key_facts()}, array_distinct({_numeric_facts()})))) AS (pos, f))"),
    "content_tokens": (
        "token STRING",
        f"SELECT explode(array_except(array_distinct(filter(regexp_extract_all(lower(t), '([a-z0-9€£%]+)', 1), x -> length(x) > 2)), array({', '.join(map(_lit, t.STOPWORDS))})))",
    ),
}


def register(spark: SparkSession, prefix: str = "tw_") -> list[str]:
    """Make the table functions known to a session: ``SELECT id, f.* FROM docs, LATERAL tw_facts(docs.text) f``. A null text gives no rows. Returns their names."""
    for name, (columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS TABLE({columns}) RETURN {body}")
    return [prefix + name for name in FUNCTIONS]


def views(spark: SparkSession, corpus: ask.Corpus, prefix: str = "tw_") -> None:
    """A corpus as views: chunks, documents, people and edges, and passages (chunks of active documents with what is known about those)."""
    live = corpus.docs.where("status IN ('active', 'needs_update')").withColumnsRenamed({"id": "document_id", "topics": "document_topics"})
    tables = {"chunks": corpus.chunks, "documents": corpus.docs, "people": corpus.people, "edges": corpus.edges, "passages": corpus.chunks.join(live, "document_id")}
    for name, rows in tables.items():
        rows.createOrReplaceTempView(prefix + name)


def topics_view(spark: SparkSession, table: str, rules: list[tuple[str, str]], name: str = "tw_topics") -> None:
    """Topics of the questions of a table or view (question_id, question) as a view (question_id, topics)."""
    understand.topics(spark.table(table), rules).createOrReplaceTempView(name)


def search_view(spark: SparkSession, table: str, passages: str, name: str = "tw_found") -> None:
    """What the searches of a table or view (question_id, text) find among passages (passage_id, text), as a view (question_id, passage_id, rank)."""
    rows, asked = spark.table(passages), spark.table(table)
    search.ranked(asked, search.postings(rows, wanted=search.terms(asked)), rows).createOrReplaceTempView(name)


def answers(spark: SparkSession, table: str, corpus: ask.Corpus, rules: ask.Rules, prefix: str = "tw_", **options) -> ask.Answers:
    """Answer the questions of a table or view (question_id, question, and profile_country, profile_name where it has them), as views: sections, verdicts, evidence, review, experts."""
    rows = spark.table(table)
    for c in ("profile_country", "profile_name"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("string"))
    out = ask.ask(rows, corpus, rules, **options)
    for name in ("sections", "verdicts", "evidence", "review", "experts"):
        getattr(out, name).createOrReplaceTempView(prefix + name)
    return out
