"""Words, English stems and what a search asks for; matching and ranking are joins (``operators.search``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS

# Endings and what stands in for them, longest first.
ENDINGS = [("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("sses", "ss"), ("ments", "ment"), ("ies", "i"), ("ing", ""), ("edly", ""), ("ed", ""), ("ly", ""), ("ss", "ss"), ("us", "us"), ("s", "")]


_STOP = frozenset(STOPWORDS)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def stem(word: str) -> str:
    """The stem of one word, as ``english`` makes it."""
    if len(word) <= 3:
        return word
    for ending, instead in ENDINGS:
        left = word.removesuffix(ending)
        if left != word and re.search("[aeiouy]", left):
            word = re.sub(r"^(.{2,})([^lsz])\2$", r"\1\2", left) if ending in ("ing", "ed") else left + instead
            break
    return re.sub("^(.{4,})e$", r"\1", re.sub("^(.{3,})y$", r"\1i", word))


def english(word: Column) -> Column:
    """A light English stem of a lower-case word, null for stop words: one ending is taken off if a vowel is left before it."""
    out = None
    for ending, instead in ENDINGS:
        left = F.substring(word, F.lit(1), F.greatest(F.length(word) - len(ending), F.lit(0)))
        new = F.concat(left, F.lit(instead)) if instead else left
        if ending in ("ing", "ed"):  # a doubled last letter is written once
            new = F.regexp_replace(left, r"^(.{2,})([^lsz])\2$", "$1$2")
        met = word.endswith(ending) & left.rlike("[aeiouy]")
        out = F.when(met, new) if out is None else out.when(met, new)
    last = F.regexp_replace(F.regexp_replace(out.otherwise(word), "^(.{3,})y$", "$1i"), "^(.{4,})e$", "$1")
    return F.when(~word.isin(*STOPWORDS), F.when(F.length(word) <= 3, word).otherwise(last))


def simple(word: Column) -> Column:
    """Every word as it is."""
    return word


def _english(word: str) -> str | None:
    return None if word in _STOP else stem(word)


def _simple(word: str) -> str:
    return word


#: What makes a stem of a column, and the same for one word.
PLAIN = {english: _english, simple: _simple}


def clauses(search: Column) -> Column:
    """What a search asks for: array<struct<clause, item, negated, words>>.

    Items beside one another must all be met; the word ``or`` begins another clause, and one clause that is met is enough. An item is a word, or a phrase of words that
    follow one another (in quotes, the last of which may be missing, or joined by other signs than blanks); a minus before it means that it must not be
    met. Items without a letter or digit are left out. Null and empty searches ask for nothing.
    """
    tokens = F.regexp_extract_all(F.coalesce(search, F.lit("")), F.lit(r'-?"[^"]*(?:"|$)|[^\s"]+'), F.lit(0))
    is_or = lambda t: F.lower(t) == "or"
    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    ors = F.transform(F.filter(numbered, lambda x: is_or(x["t"])), lambda x: x["i"])
    items = F.transform(
        F.filter(numbered, lambda x: ~is_or(x["t"])),
        lambda x: F.struct(F.size(F.filter(ors, lambda o: o < x["i"])).alias("clause"), x["i"].alias("item"), x["t"].startswith("-").alias("negated"), words(x["t"]).alias("words")),
    )
    return F.filter(items, lambda x: F.size(x["words"]) > 0)
