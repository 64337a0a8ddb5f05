"""What questions ask: topics, context, intent, parts, rewrites. Rules are tables with an explicit priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import let, phrase_in
from . import phrases

# Fixed value: where a question of several parts is split.
SPLIT = r"(?i)(?:[,;])? and (?=(?:which|what|how|who|where|when|is|are|does|do)\b)"
#: Rule tables of up to so many rows travel inside the expression; larger ones are searched for by ``phrases``.
RULES = 2_000


def rules(table: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    """(priority, code, keyword) of a table code -> keywords in order of precedence."""
    return [(i, code, k) for i, (code, words) in enumerate(table.items(), 1) for k in words]


def _known(table: DataFrame | list[tuple], columns: list[str]) -> list[tuple] | None:
    """Rows of a rule table in order, without null and empty keywords; None for a large one."""
    if isinstance(table, DataFrame):
        table = [tuple(r) for r in table.select(*columns).limit(RULES + 1).collect()]
    return sorted(r for r in table if r[-1]) if len(table) <= RULES else None


def _large(texts: DataFrame, table: DataFrame | list[tuple], columns: list[str]) -> DataFrame:
    """A large rule table as priority, code, keyword."""
    if not isinstance(table, DataFrame):
        table = texts.sparkSession.createDataFrame(table, ", ".join(f"{c} {'int' if c == 'priority' else 'string'}" for c in columns))
    table = table.select(*columns).toDF(*columns[:-2], "code", "keyword")
    return table if "priority" in columns else table.withColumn("priority", F.lit(0))


def _met(text: Column, table: list[tuple[int, str, str]], bounded: bool = True) -> Column:
    """The rules (priority, code, keyword) that a text meets, in order of priority."""
    kind = "array<struct<priority:int,code:string,keyword:string>>"
    every = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(c).alias("code"), F.lit(k).alias("keyword")) for p, c, k in table)).cast(kind)
    # a plain search first: patterns are made for the phrases that a text holds at all
    meets = lambda low: lambda r: low.contains(r["keyword"]) & phrase_in(low, r["keyword"]) if bounded else low.contains(r["keyword"])
    return let(F.lower(text), lambda low: F.filter(every, meets(low)))


def topics_of(text: Column, table: list[tuple[str, str]]) -> Column:
    """Topics of a text by rules (topic, keyword), that with the longest keyword first, then the last by name."""
    longest = lambda met: lambda c: F.struct(F.array_max(F.transform(F.filter(met, lambda m: m["code"] == c), lambda m: F.length(m["keyword"]))).alias("len"), c.alias("topic"))
    best = let(_met(text, sorted((0, c, k) for c, k in table)), lambda met: F.transform(F.array_distinct(F.transform(met, lambda m: m["code"])), longest(met)))
    return F.transform(F.sort_array(best, asc=False), lambda t: t["topic"])


def first_of(text: Column, table: list[tuple[int, str, str]]) -> Column:
    """The first rule (priority, code, keyword) that a text meets: struct, or null."""
    return F.get(_met(text, table), F.lit(0))


def most_of(text: Column, table: list[tuple[int, str, str]], bounded: bool = False) -> Column:
    """The code with most keywords in a text, the first of equals: struct(hits, p, code), or null."""
    of = lambda met, c: F.filter(met, lambda m: m["code"] == c)
    count = lambda met: lambda c: F.struct(F.size(of(met, c)).alias("hits"), (-F.array_min(F.transform(of(met, c), lambda m: m["priority"]))).alias("p"), c.alias("code"))
    return let(_met(text, sorted(table), bounded), lambda met: F.array_max(F.transform(F.array_distinct(F.transform(met, lambda m: m["code"])), count(met))))


def topics(questions: DataFrame, keywords: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Topics of (question_id, question) by a rule table (topic, keyword): the longest keyword decides the order; no row without a topic."""
    known = _known(keywords, ["topic", "keyword"])
    if known is None:
        met = phrases.met(questions.select(F.col("question_id").alias("id"), F.col("question").alias("text")), _large(questions, keywords, ["topic", "keyword"]))
        best = met.groupBy("row", "id", "code").agg(F.max(F.length("keyword")).alias("len")).groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("len", "code")), asc=False).alias("t"))
        return best.select(F.col("id").alias("question_id"), F.transform("t", lambda t: t["code"]).alias("topics"))
    rows = questions.select("question_id", topics_of(F.col("question"), known).alias("topics"))
    return rows.where(F.size("topics") > 0)


def first_hit(texts: DataFrame, table: DataFrame | list[tuple[int, str, str]], otherwise: str | None = None) -> DataFrame:
    """The code of the first rule (priority, code, keyword) that a text (id, text) meets; ``otherwise`` if none."""
    names = ["priority", "code", "keyword"]
    known = _known(table, names)
    if known is None:
        rows = phrases.numbered(texts)
        first = phrases.met_in(rows, _large(texts, table, names)).groupBy("row").agg(F.min(F.struct(*names)).alias("m"))
        return rows.join(first, "row", "left").select("id", F.coalesce("m.code", F.lit(otherwise)).alias("code"))
    return texts.select("id", F.coalesce(first_of(F.col("text"), known)["code"], F.lit(otherwise)).alias("code"))


def intent(texts: DataFrame) -> DataFrame:
    """What kind of answer a question (id, text) wants."""
    return first_hit(texts, rules(config.INTENTS), config.INTENT_ELSE)


def most_hits(texts: DataFrame, table: DataFrame | list[tuple[int, str, str]], bounded: bool = False) -> DataFrame:
    """The code with most keywords in a text, the first of equals: id, code, hits; no row without a hit.

    Keywords count anywhere in a text, or (``bounded``) between non-letters only.
    """
    names = ["priority", "code", "keyword"]
    known = _known(table, names)
    if known is None:
        per = phrases.met(texts, _large(texts, table, names), bounded).groupBy("row", "id", "code").agg(F.count("*").alias("hits"), (-F.min("priority")).alias("p"))
        best = per.groupBy("row", "id").agg(F.max(F.struct("hits", "p", "code")).alias("best"))
        return best.select("id", "best.code", F.col("best.hits").cast("long").alias("hits"))
    best = texts.select("id", most_of(F.col("text"), known, bounded).alias("best"))
    return best.where("best IS NOT NULL").select("id", "best.code", F.col("best.hits").cast("long").alias("hits"))


def placed(text: Column, clients: list[tuple[int, str, str]], employees: list[tuple[int, str, str]]) -> Column:
    """Client and country that a text names, and by which rule: struct(client, country, named, works, place).

    First a client that is named (``clients``: priority, name, country), then the client of an employee who is named (``employees``: priority,
    employee, client), then a country keyword.
    """
    named = first_of(text, sorted((p, n, n.lower()) for p, n, _ in clients))
    works = first_of(text, sorted((p, c, e.lower()) for p, e, c in employees))
    place = first_of(text, rules(config.COUNTRIES))
    of = F.create_map(*[F.lit(x) for kv in {name: country for _, name, country in clients}.items() for x in kv]) if clients else F.create_map().cast("map<string,string>")
    found = F.struct(named["code"].alias("named"), works.alias("works"), place["code"].alias("place"))
    out = lambda f: F.struct(
        F.coalesce(f["named"], f["works"]["code"]).alias("client"), F.coalesce(F.try_element_at(of, F.coalesce(f["named"], f["works"]["code"])), f["place"]).alias("country"), *(f[x].alias(x) for x in ("named", "works", "place"))
    )
    return let(found, out)


def context(questions: DataFrame, clients: list[tuple[int, str, str]], employees: list[tuple[int, str, str]]) -> DataFrame:
    """Client and country of (question_id, question, profile_country, profile_name), with the source of the country.

    ``clients``: (priority, name, country); ``employees``: (priority, employee, client). First a client that is named, then
    the client of an employee who is named, then a country keyword, then the asker's profile. Adds client, country and country_source.
    """
    names = F.create_map(*[F.lit(x) for kv in config.COUNTRY_NAMES.items() for x in kv])
    rows = questions.withColumn("_p", placed(F.col("question"), clients, employees)).withColumn("client", F.col("_p.client"))
    place = F.col("_p.country")
    label = F.coalesce(F.try_element_at(names, place), place)
    # The phrases of an explanation.
    source = (
        F.when(F.col("_p.named").isNotNull(), F.concat(F.lit("client "), "client", F.lit(" is a "), label, F.lit(" account")))
        .when(F.col("_p.works").isNotNull(), F.concat(F.initcap(F.col("_p.works.keyword")), F.lit(" is an employee of client "), "client", F.lit(" ("), label, F.lit("), per the HR system")))
        .when(F.col("_p.place").isNotNull(), F.lit("mentioned in the question"))
        .when(F.col("profile_country").isNotNull(), F.concat(F.lit("inferred from your profile ("), "profile_name", F.lit(")")))
    )
    return rows.withColumn("country", F.coalesce(place, "profile_country")).withColumn("country_source", source).drop("_p")


def parts(question: Column) -> Column:
    """Sub-questions: split before a question word after 'and'; else at inner question marks."""
    split = F.filter(F.transform(F.split(question, SPLIT), lambda x: F.trim(x)), lambda x: x != "")
    inner = F.filter(F.transform(F.split(question, r"\?"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when((F.size(split) == 1) & (F.size(inner) > 1), inner).otherwise(split)


def rewrites(expansions: Column, scoped: Column) -> Column:
    """Up to two expansions of each of the first two topics (array of arrays), then the scoped one: four at most."""
    two = F.transform(F.slice(expansions, 1, 2), lambda x: F.slice(x, 1, 2))
    return F.slice(F.array_compact(F.concat(F.flatten(two), F.array(scoped))), 1, 4)


def inferred_country(candidates: DataFrame) -> DataFrame:
    """Country of a question from its three most relevant candidates (question_id, chunk_id, relevance, country), if they agree."""
    ranked = candidates.withColumn("r", F.expr("row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, chunk_id)")).where("r <= 3")
    found = ranked.groupBy("question_id").agg(F.collect_set("country").alias("c"), F.max(F.when(F.col("r") == 1, F.col("country"))).alias("first"))
    return found.select("question_id", F.when((F.size("c") == 1) & F.col("first").isNotNull(), F.col("first")).alias("country"))
