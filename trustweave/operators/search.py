"""Search by words, phrases, alternatives and exclusions over positional postings, ranked by cover density."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fulltext
from ..scratch import cut

#: Searches that ask for nothing but absence meet all passages in blocks of this many.
BLOCK = 2000
#: Up to so many stems that searches name are sent to the tasks; more are joined.
SENT = 200_000
#: Passages that are gathered at a time, and words whose stems a task remembers.
SLICE, KNOWN = 512, 500_000
#: Stems that a passage must have before the others are looked for.
RAREST = 3

Stem = Callable[[Column], Column]
_WORD = re.compile("[a-z0-9]+")


def terms(searches: DataFrame, stem: Stem = fulltext.english) -> DataFrame:
    """Stems that searches (question_id, text) name: question_id, clause, item, negated, at (place in the item), stem. Stop words only take up places."""
    rows = searches.select("question_id", F.explode(fulltext.clauses(F.col("text"))).alias("c"))
    rows = rows.select("question_id", "c.clause", "c.item", "c.negated", F.posexplode("c.words").alias("at", "word"))
    return rows.withColumn("stem", stem(F.col("word"))).where("stem IS NOT NULL").drop("word")


def _gathered(stem: Callable[[str], str | None], wanted: frozenset | None):
    """Postings of each batch of (passage_id, lower-case text): the places of a passage's stems are gathered as its words are read."""

    def run(batches):
        known: dict[str, str | None] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                stems, rows, places, ends = [], [], array("i"), [0]
                for row, text in enumerate(part.column(1).to_pylist()):
                    at: dict[str, list[int]] = {}
                    for i, word in enumerate(_WORD.findall(text or "")):
                        if word in known:
                            s = known[word]
                        else:
                            s = stem(word)
                            s = known[word] = s if wanted is None or s in wanted else None
                            if len(known) > KNOWN:
                                known.clear()
                        if s is not None:
                            at.setdefault(s, []).append(i)
                    for s, found in at.items():
                        stems.append(s)
                        rows.append(row)
                        places.extend(found)
                        ends.append(len(places))
                if stems:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(places, np.int32)))
                    found = pa.RecordBatch.from_arrays([pa.array(stems), part.column(0).take(pa.array(rows)), lists], names=["stem", "passage_id", "positions"])
                    yield found.take(pc.sort_indices(found.column(0)))  # equal stems lie together, which makes shuffles and files smaller

    return run


def postings(passages: DataFrame, stem: Stem = fulltext.english, wanted: DataFrame | None = None) -> DataFrame:
    """Where each passage (passage_id, text) has each stem: stem, passage_id, positions (sorted); with ``wanted`` (stem) only those stems. A passage_id names one passage.

    The words of a passage are gathered where its text is read, so none is shuffled. Up to ``SENT`` wanted stems are known to the tasks; more are joined.
    """
    few = None if wanted is None else wanted.select("stem").distinct()
    small = few is not None and few.count() <= SENT
    own = frozenset(r.stem for r in few.collect()) if small else None
    texts = passages.select("passage_id", F.lower("text").alias("text"))
    rows = texts.mapInArrow(_gathered(fulltext.PLAIN[stem], own), f"stem string, passage_id {texts.schema['passage_id'].dataType.simpleString()}, positions array<int>")
    return rows if few is None or small else rows.join(few, "stem", "left_semi")


def _needed(index: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The part of postings in which those of written ``pairs`` (question_id, clause, passage_id) are found, so that the others, which are most, are not shuffled.

    The passages of clauses, ``SENT`` in all, are sent to the postings; of clauses with more of them, and of those with ``RAREST`` stems at most and over ``BLOCK`` passages, the stems are.
    """
    one = ["question_id", "clause"]
    stems = asked.groupBy(*one).agg(F.count_distinct("stem").alias("_s"))
    many = cut(pairs.groupBy(*one).agg(F.count("*").alias("_n")).join(stems, one).withColumn("_bits", F.when((F.col("_n") > BLOCK) & (F.col("_s") <= RAREST), 64).otherwise(F.length(F.bin("_n")))))
    total, most = 0, 0
    for r in many.where("_bits < 64").groupBy("_bits").agg(F.sum("_n").alias("n")).orderBy("_bits").collect():  # 63 rows at most
        total += r.n
        if total > SENT:
            break
        most = r._bits
    few = F.broadcast if many.count() <= SENT else lambda df: df
    own = pairs.join(few(many.where(F.col("_bits") <= most).select(*one)), one).select("passage_id").distinct().withColumn("_own", F.lit(True))
    named = cut(asked.join(few(many.where(F.col("_bits") > most).select(*one)), one).select("stem").distinct()).withColumn("_named", F.lit(True))
    named = F.broadcast(named) if named.count() <= SENT else named
    return index.join(F.broadcast(own), "passage_id", "left").join(named, "stem", "left").where("_own OR _named").select(*index.columns)


def matches(asked: DataFrame, index: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """Clauses of ``terms`` that passages meet by their postings: question_id, clause, passage_id.

    A clause is looked for by its ``RAREST`` rarest stems, so a passage without them is never met. Clauses that only exclude are met by all of ``passages`` (passage_id), in
    blocks, that hold none of what they exclude; without ``passages`` they are met by none.
    """
    one, item = ["question_id", "clause"], ["question_id", "clause", "item"]
    few = F.broadcast if asked.count() <= SENT else lambda df: df
    size = asked.groupBy(*item, "negated").agg(F.count("*").alias("n_words"))
    stems = asked.groupBy(*one).agg(F.count_distinct("stem").alias("n_stems"))
    clause = size.groupBy(*one).agg(F.count_if(~F.col("negated")).alias("n_items"), F.max("n_words").alias("longest"), F.max("negated").alias("excludes")).join(stems, one)
    # clauses of a few single words are settled by their rare stems
    clause = cut(clause.withColumn("plain", (F.col("longest") == 1) & ~F.col("excludes") & (F.col("n_stems") <= RAREST)))
    used = index.join(few(asked.select("stem").distinct()), "stem", "left_semi")
    df = used.groupBy("stem").agg(F.count("*").alias("df"))
    rare = asked.where("NOT negated").join(df, "stem", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = rare.dropDuplicates([*one, "stem"]).withColumn("_r", F.row_number().over(Window.partitionBy(*one).orderBy("df", "stem"))).where(F.col("_r") <= RAREST)
    rare = cut(rare.withColumn("_n", F.count("*").over(Window.partitionBy(*one))).select(*one, "stem", "_n"))
    found = used.select("stem", "passage_id").join(few(rare), "stem").groupBy(*one, "passage_id").agg(F.count("*").alias("_met"), F.first("_n").alias("_n")).where("_met = _n").select(*one, "passage_id")
    if passages is not None:
        empty = clause.where("n_items = 0").select(*one)
        blocks = max(1, -(-empty.count() // BLOCK))
        for b in range(blocks):
            block = empty.where(F.pmod(F.xxhash64(*one), F.lit(blocks)) == b)
            found = found.unionByName(passages.select("passage_id").crossJoin(F.broadcast(block)).select(*one, "passage_id"))
    found = cut(found.join(few(clause.select(*one, "n_items", "plain")), one))
    open_ = found.where("NOT plain")
    # places only where words must follow one another
    named = asked.join(size, [*item, "negated"])
    hits = open_.select(*one, "passage_id").join(few(named), one).join(_needed(used, open_, asked), ["stem", "passage_id"])
    starts = F.when(F.col("n_words") > 1, F.transform("positions", lambda p: p - F.col("at")))
    held = hits.select(*item, "negated", "n_words", "passage_id", starts.alias("starts")).groupBy(*item, "negated", "n_words", "passage_id").agg(F.count("*").alias("n"), F.collect_list("starts").alias("s")).where("n = n_words")
    # the words of an item follow one another where one start suits them all
    together = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), lambda a, x: F.array_intersect(a, x))
    held = held.where((F.col("n_words") == 1) | (F.size(together) > 0))
    met = held.groupBy(*one, "passage_id").agg(F.count_if(~F.col("negated")).alias("met"), F.count_if(F.col("negated")).alias("bad"))
    out = open_.join(met, [*one, "passage_id"], "left").where("coalesce(met, 0) = n_items AND coalesce(bad, 0) = 0")
    return out.select(*one, "passage_id").unionByName(found.where("plain").select(*one, "passage_id"))


def density(met: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """Cover density of what ``matches`` found, as written: question_id, passage_id, rank.

    A cover is a shortest stretch with all stems that a clause wants; each adds stems / (length + stems), and the clauses of a search are added up. What is met by
    absence alone has rank 0.
    """
    one = ["question_id", "clause", "passage_id"]
    wanted = asked.where("NOT negated").select("question_id", "clause", "stem").distinct()
    wanted = wanted.withColumn("need", F.count("*").over(Window.partitionBy("question_id", "clause")))
    hits = met.join(wanted, ["question_id", "clause"]).join(_needed(index, met, wanted), ["stem", "passage_id"]).select(*one, "stem", "need", F.explode("positions").alias("pos"))
    # a hit is the last of its stem up to the next one; a cover starts at the earliest last hit and ends where all before it have come again
    of = Window.partitionBy(*one, "stem").orderBy("pos")
    hits = hits.withColumn("next", F.coalesce(F.lead("pos").over(of), F.lit((1 << 31) - 1))).withColumn("lead", F.when(F.lag("pos").over(of).isNull(), F.col("pos")))
    before = Window.partitionBy(*one).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.greatest(F.max("lead").over(Window.partitionBy(*one)), F.max("next").over(before), F.col("pos"))
    covers = hits.withColumn("end", end).where("end < next").groupBy("question_id", "passage_id").agg(F.sum(F.col("need") / (F.col("end") - F.col("pos") + F.col("need"))).alias("rank"))
    return met.select("question_id", "passage_id").distinct().join(covers, ["question_id", "passage_id"], "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))


def ranked(searches: DataFrame, index: DataFrame, passages: DataFrame | None = None, stem: Stem = fulltext.english) -> DataFrame:
    """Every passage that meets a search (question_id, text), with its cover density: question_id, passage_id, rank.

    ``index`` has the columns of ``postings`` made with the same ``stem``: whole, or only the stems that the searches name.
    """
    asked = cut(terms(searches, stem))
    met = cut(matches(asked, index, passages))
    return density(met, asked, index)
