"""Hybrid retrieval over many questions at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import content_tokens
from ..functions.vectors import cosine
from ..scratch import cut
from . import cells

#: Questions are taken in blocks of this many, so the side that is broadcast has a fixed bound.
BLOCK = 2000
#: Candidates that are sent to the chunks, so that no vector is shuffled for them; more are joined.
FEW = 200_000
#: Questions whose vectors are sent to the candidates; more are joined.
ASKED = 10_000
#: Documents in which something can be found.
LIVE = "status IN ('active', 'needs_update')"
#: Tokens of a block of questions, which bound what is sent.
TOKENS = 1_000_000
#: Passages that are compared with a block of questions at a time.
SLICE = 512


def knn(queries: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most similar chunks of each query (query_id, vector) among all (chunk_id, vector): query_id, chunk_id, sim, rank.

    Ids are whole numbers and vectors of one length; those without a vector find nothing and are not found. Queries are a stated set, sent in blocks to the tasks, each of which
    keeps its own best. ``cells`` finds nearly the same by looking at a part of the chunks.
    """
    return cells.exact(queries, chunks, k)


def few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, sent to the tasks in a join if it has ``most`` rows (``FEW``) at most."""
    return F.broadcast(rows) if rows.count() <= (FEW if most is None else most) else rows


def fuse(ranked: DataFrame, offset: int = 20) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank from 0, weight): query_id, chunk_id, rrf."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (offset + F.col("rank"))), 9).alias("rrf"))


def _best_of_task(shared, k: int):
    """(question_id, passage_id, hits): the ``k`` best passages of each question in one task, by shared tokens, smaller ids first.

    Tokens become numbers of the questions' tokens, and the shared tokens of a slice of passages with all questions are counted in one table.
    """

    def top(rows):
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        return rows[np.arange(len(rows)) - first < k]

    def best(batches):
        ids, tokens, ends, asked = shared.value  # questions of token i: asked[ends[i] : ends[i + 1]]
        kept = np.zeros((0, 3), np.int64)  # question, -hits, passage
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                lists = part.column(1)
                row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                code = pc.index_in(lists.flatten(), tokens)
                held = np.asarray(code.is_valid())
                row, code = row[held], np.asarray(code.drop_null())
                n = ends[code + 1] - ends[code]
                at = np.repeat(ends[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
                hits = np.bincount(np.repeat(row, n) * len(ids) + asked[at], minlength=len(lists) * len(ids)).reshape(len(lists), len(ids))
                least = np.maximum(np.partition(hits, -k, axis=0)[-k], 1) if len(lists) > k else 1
                p, q = np.nonzero(hits >= least)
                kept = top(np.concatenate([kept, np.stack([q, -hits[p, q], part.column(0).to_numpy()[p]], axis=1)]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[:, 0]]), pa.array(kept[:, 2]), pa.array(-kept[:, 1])], names=["question_id", "passage_id", "hits"])

    return best


def lexical_top(questions: DataFrame, passages: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` passages (passage_id: long, tokens) with the largest share of each question's tokens (question_id: long, tokens), none without any.

    Questions are a stated set and go to the tasks in blocks of ``BLOCK`` as an inverted index; each task keeps its own ``k`` best of every question, so
    what is shuffled is that and not the pairs that share a word. Returns question_id, passage_id, lexical and rank; ties go to the smaller passage_id.
    """
    spark = questions.sparkSession
    n, tokens = questions.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(tokens or 0) // TOKENS))
    out = None
    for b in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b).select("question_id", "tokens").collect()  # BLOCK rows or so
        postings: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for x in r.tokens or ():
                postings.setdefault(x, []).append(i)
        ids = np.array([r.question_id for r in rows], np.int64)
        ends = np.cumsum([0, *map(len, postings.values())])
        asked = np.array([i for v in postings.values() for i in v], np.int64)
        shared = spark.sparkContext.broadcast((ids, pa.array(list(postings), pa.string()), ends, asked))
        part = passages.select(F.col("passage_id").cast("long"), "tokens").mapInArrow(_best_of_task(shared, k), "question_id long, passage_id long, hits long")
        out = part if out is None else out.unionAll(part)
    scored = out.join(questions.select("question_id", F.size("tokens").alias("n")), "question_id").select("question_id", "passage_id", (F.col("hits") / F.col("n")).alias("lexical"))
    return top(scored, ["question_id"], [F.desc("lexical"), "passage_id"], k)


def candidates(questions: DataFrame, chunks: DataFrame, docs: DataFrame, ranked: DataFrame, k: int = 15) -> DataFrame:
    """Candidates of queries: chunks of active documents that match a query's words or are among its ``k`` nearest, all with their similarity.

    ``questions``: query_id, vector; ``chunks``: chunk_id, document_id, vector, ...; ``docs``: document_id, status, ...; ``ranked``: query_id, chunk_id, fts of chunks that
    hold a query's words. Documents that are not active are left out before the nearest are taken. The two sets are joined by key, so no query meets all
    chunks but in ``knn``. fts is 0 where a chunk is among the nearest alone; the vectors of chunks are dropped.
    """
    return among(questions, chunks.join(docs.where(LIVE), "document_id"), ranked, k)


def among(questions: DataFrame, live: DataFrame, ranked: DataFrame, k: int = 15) -> DataFrame:
    """``candidates`` among chunks (chunk_id, vector, ...) of which all can be found."""
    near = knn(questions, live.select("chunk_id", "vector"), k).select("query_id", "chunk_id")
    words = ranked.select("query_id", "chunk_id", "fts")
    both = cut(near.withColumn("fts", F.lit(0.0)).unionByName(words).groupBy("query_id", "chunk_id").agg(F.max("fts").alias("fts")))
    rows = live.join(few(both), "chunk_id").join(few(questions.select("query_id", F.col("vector").alias("_q")), ASKED), "query_id")
    return rows.withColumn("sim", F.round(cosine(F.col("_q"), F.col("vector")), 6)).withColumn("fts", F.coalesce("fts", F.lit(0.0))).drop("_q", "vector")


def overlap(question: Column, section: Column, text: Column, title: Column) -> Column:
    """Share of a question's content words that a passage has in its section, text or title; 0 for a question without any."""
    asked = content_tokens(F.coalesce(question, F.lit("")))
    said = content_tokens(F.concat_ws(" ", section, text, title))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, said)) / F.size(asked)).otherwise(0.0)


def reciprocal(found: DataFrame) -> DataFrame:
    """Rank fusion of candidates (sub_id, query_no, chunk_id, sim, fts), with the best sim of each: the question (query_no 0) counts 1, rewrites .6; by similarity, and by words where any match."""
    one = Window.partitionBy("sub_id", "query_no")
    weight = F.when(F.col("query_no") == 0, 1.0).otherwise(0.6)
    rank = lambda c: F.row_number().over(one.orderBy(F.desc_nulls_last(c), "chunk_id")) - 1
    rows = found.withColumn("_s", weight / (20 + rank("sim"))).withColumn("_f", F.when(F.col("fts") > 0, weight / (20 + rank("fts"))).otherwise(0.0))
    return rows.groupBy("sub_id", "chunk_id").agg(F.round(F.sum(F.col("_s") + F.col("_f")), 9).alias("rrf"), F.max("sim").alias("sim"))


def key_boost(lexical_: Column, asked: Column, said: Column) -> Column:
    """Share of shared words, .4 more (1 at most) where question and passage state one key fact's key."""
    return F.when(F.arrays_overlap(asked, said), F.least(F.lit(1.0), lexical_ + 0.4)).otherwise(lexical_)


def intent_boost(intent: Column, doc_type: Column, section: Column, text: Column) -> Column:
    """What a passage gains by the kind of answer that is wanted."""
    types = F.create_map(*[x for k, v in config.INTENT_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    kind = F.coalesce(F.array_contains(F.try_element_at(types, intent), doc_type), F.lit(False))
    head = F.lower(section)
    # What sections and texts say.
    decided = (intent == "decision") & head.contains("decision")
    steps = (intent == "procedure") & (head.contains("step") | (doc_type == "procedure"))
    person = (intent == "contact") & (head.rlike("contact|who") | F.lower(text).rlike(r"\bgo to\b|\bcontact\b|questions about"))
    return F.when(kind, 0.05).otherwise(0.0) + F.when(decided, 0.15).otherwise(0.0) + F.when(steps, 0.05).otherwise(0.0) + F.when(person, 0.2).otherwise(0.0)


def pooled(found: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` best candidates of each sub-question (sub_id, chunk_id, relevance, rrf) with their rank."""
    return top(found, ["sub_id"], [F.desc("relevance"), F.desc("rrf"), "chunk_id"], k)


def top(scored: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with their rank."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
