"""Text as columns: sentences, tokens, facts, claims. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns.
STOPWORDS = """a an the of for in on at to from by with and or is are was were be been do does did how many much
what which who where when why can could should would i we you they it this that these those our their your as into
about after before during under over per get gets give employee employees""".split()
FACT = r"(?i)(€\s?\d+(?:[.,]\d+)?|£\s?\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s*(?:%|percent|calendar days|working days|days|weeks|months|years|hours|per week))"
REPORTED = r"(?i)\b(?:say|says|said|claims?|told me|according to)\b[^.]{0,60}\d"
NO_ANSWER = r"(?i)does not determine|do not determine|is not determined|not covered by|out of scope|does not cover|must not be used|cannot be used to|is not part of"
STALE_SELF = r"(?i)old (?:onboarding )?(?:note|file|document|material|version)|have not checked|previous process|not (?:yet )?verified|i believe"
KEY_FACTS = [
    ("correction run cost", [(r"\bfor free\b|\bfree of charge\b|\bis free\b|\balways .{0,30}free\b", "free"), (r"\bcharged\b|\bcosts? extra\b|\bnot free\b|\bpaid\b|\binvoiced\b", "charged")]),
    ("correction run availability", [(r"correction runs? (?:are|is) not available", "not available"), (r"correction run (?:can be requested|is possible|is available)", "available")]),
    ("exceptions after cutoff", [(r"\bno exceptions\b", "none"), (r"\bonly [^.]{0,80} can be (?:processed|handled) after\b|\bexceptions? (?:are|is) (?:allowed|possible)\b|\bcan be handled after the cutoff\b", "some")]),
]
CONDITIONS = ("years", "months of service", "years of service")
_SPACE = " \t\n\r\x0b\x0c"


def let(value: Column, body) -> Column:
    """``body`` of ``value`` with the value computed once; a lambda would compute an expression at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _split(c: Column, pattern: str) -> Column:
    return F.filter(F.split(clean_space(c), pattern), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences that end in . ! ? before a capital, digit, currency sign, quote or bracket."""
    return _split(c, r"(?<=[.!?])\s+(?=[A-Z0-9€£\"'(])")


def sentences_any(c: Column) -> Column:
    """Sentences that end in . ! ? before anything."""
    return _split(c, r"(?<=[.!?])\s+")


def sentences_capital(c: Column) -> Column:
    """Sentences that end in . ! ? before a capital."""
    return _split(c, r"(?<=[.!?])\s+(?=[A-Z])")


def content_tokens(c: Column) -> Column:
    """Distinct tokens [a-z0-9€£%]+ of more than two characters that are no stopwords."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9€£%]+)"), 1), lambda x: F.length(x) > 2)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def all_tokens(c: Column) -> Column:
    """Distinct tokens [a-z0-9]+."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if it is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def is_duplicate(a: Column, b: Column) -> Column:
    """Short texts (under 20 tokens) need Jaccard .75; others .5, or containment .85."""
    short = F.least(F.size(a), F.size(b)) < 20
    return F.when(short, jaccard(a, b) >= 0.75).otherwise((jaccard(a, b) >= 0.5) | (containment(a, b) >= 0.85))


def overlap(question: Column, passage: Column) -> Column:
    """Share of a question's tokens in a passage; 0 for a question without tokens."""
    return F.when(F.size(question) > 0, F.size(F.array_intersect(question, passage)) / F.size(question)).otherwise(F.lit(0.0))


def numeric_facts(c: Column) -> Column:
    """Amounts and numbers with units in order, distinct: lower case, one space, decimal point, plain days, % for percent."""
    low = lambda x: F.translate(clean_space(F.lower(x)), ",", ".")
    fact = lambda x: F.replace(F.regexp_replace(low(x), "(?:calendar|working) days", "days"), F.lit("percent"), F.lit("%"))
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(FACT), 1), fact))


def facts(c: Column) -> Column:
    """Key facts of the fixed table, then numeric facts."""
    return F.array_distinct(F.concat(key_facts(F.lower(c), KEY_FACTS), numeric_facts(c)))


def fact_keys(c: Column) -> Column:
    """Keys of the key facts that a text states."""
    return F.transform(key_facts(F.lower(c), KEY_FACTS), lambda x: F.substring_index(x, "=", 1))


def key_facts(c: Column, rules: list[tuple[str, list[tuple[str, str]]]]) -> Column:
    """For each key the value of its first matching pattern, as key=value; ``rules``: (key, [(pattern, value)])."""
    one = lambda key, options: reduce(lambda w, o: w.when(c.rlike(o[0]), F.lit(f"{key}={o[1]}")), options, F.when(F.lit(False), F.lit("")))
    return F.array_compact(F.array(*(one(k, o) for k, o in rules))) if rules else F.array().cast("array<string>")


def unit_of(fact: Column) -> Column:
    """Unit of a fact: the key of key=value, the currency sign, or what follows the number."""
    return (
        F.when(fact.contains("=") & ~fact.rlike("^[0-9]"), F.substring_index(fact, "=", 1))
        .when(fact.rlike("^[€£]"), F.substring(fact, 1, 1))
        .otherwise(F.trim(F.regexp_replace(fact, r"^[\d.]+\s*", "")))
    )


def value_of(fact: Column) -> Column:
    """Value of a fact, as text."""
    return F.when(fact.contains("=") & ~fact.rlike("^[0-9]"), F.regexp_replace(fact, "^[^=]*=", "")).otherwise(F.regexp_extract(fact, r"(\d[\d.]*)", 1))


def by_unit(facts_: Column) -> Column:
    """Map of unit to the first value."""

    def firsts(named: Column) -> Column:
        units = F.transform(named, lambda x: x["unit"])
        return F.map_from_entries(F.filter(named, lambda x, i: F.array_position(units, x["unit"]) == i + 1))

    return let(F.transform(facts_, lambda x: F.struct(unit_of(x).alias("unit"), value_of(x).alias("value"))), firsts)


def contradictions(a: Column, b: Column, conditions: tuple[str, ...] = CONDITIONS) -> Column:
    """Units whose values differ between two unit maps, as (unit, a, b); none if a shared condition differs."""

    def found(both: Column) -> Column:
        other = both["b"]
        differ = F.filter(F.map_entries(both["a"]), lambda e: F.map_contains_key(other, e["key"]) & (F.element_at(other, e["key"]) != e["value"]))
        named = F.transform(differ, lambda e: F.struct(e["key"].alias("unit"), e["value"].alias("a"), F.element_at(other, e["key"]).alias("b")))
        return let(named, lambda d: F.when(F.exists(d, lambda x: x["unit"].isin(*conditions)), F.slice(d, 1, 0)).otherwise(d))

    return let(F.struct(a.alias("a"), b.alias("b")), found)


def asserts(c: Column) -> Column:
    """Whether a text states something: not empty, no question at its end or in what comes before the first point of its first 120 characters, no reported number."""
    whole = F.btrim(c, F.lit(_SPACE))
    last = F.element_at(F.split(whole, r"(?<=[.!?])\s+"), -1)
    early = F.substring_index(F.substring(c, 1, 120), ".", 1)
    return (whole != "") & ~last.endswith("?") & ~early.contains("?") & ~c.rlike(REPORTED)


def non_answer(c: Column) -> Column:
    """Whether a text says itself that it doesn't settle the matter."""
    return c.rlike(NO_ANSWER)


def says_stale(c: Column) -> Column:
    """Whether a text says itself that it rests on old material."""
    return c.rlike(STALE_SELF)


def phrase_in(c: Column, phrase: Column) -> Column:
    """Whether the lower-case text holds the phrase between non-letters."""
    quoted = F.concat(F.lit(r"(?<![a-z])\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z])"))
    return F.regexp_like(F.lower(c), quoted)


def title_stem(c: Column) -> Column:
    """A title without version, year, copy and draft marks."""
    low = F.regexp_replace(F.lower(c), r"\b(copy|final|draft)\b|\bv(ersion)? ?\d+(\.\d+)*\b|\b(19|20)\d\d\b", " ")
    words = F.split(F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("v", "version", "")), " ")


def slug(prefix: str, external_id: Column, size: int = 40) -> Column:
    """An id from a source's id; where it is cut, a piece of its hash keeps it apart."""
    whole = F.concat(F.lit(prefix), F.btrim(F.regexp_replace(external_id, r"[^A-Za-z0-9]+", "-"), F.lit("-")))
    return F.when(F.length(whole) <= size, whole).otherwise(F.concat(F.substring(whole, 1, size - 9), F.lit("-"), F.substring(F.sha1(external_id), 1, 8)))


def lead_sentence(question_tokens: Column, text: Column) -> Column:
    """The sentence with most question tokens (half a point for a digit), the earliest of equals; null without a sentence."""
    score = lambda s: F.size(F.array_intersect(question_tokens, content_tokens(s))) + F.when(s.rlike(r"\d"), 0.5).otherwise(0.0)
    scored = F.transform(sentences_capital(text), lambda s, i: F.struct(score(s).alias("score"), (-i).alias("at"), s.alias("sentence")))
    return F.array_max(scored)["sentence"]
