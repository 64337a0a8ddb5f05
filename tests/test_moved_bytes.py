"""What searches and questions move between tasks (F6): texts and postings stay where they are read, as far as few rows are asked of them."""

import datetime as dt
import random

import pytest

from trustweave.functions.vectors import hashed_embeddings
from trustweave.operators import ask, retrieve, search

DOCS = "id string, title string, doc_type string, country string, client string, topics array<string>, owner_id string, author_id string, updated_at date, validated_at date, date_known boolean, supersedes_id string, status string"
QUESTIONS = [(1, "What does the ledger say?"), (2, "Where is w7 w8?"), (3, "Which colour has the moon?")]


@pytest.fixture
def joined(spark):
    """No table is sent for its size, as if all were large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(spark, run):
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = total()
    run()
    return total() - before


def _corpus(spark, n=400):
    draw = random.Random(3)
    texts = [f"ledger w{i} w{i + 1} " + " ".join(f"{draw.getrandbits(40):x}" for _ in range(1000)) for i in range(n)]
    rows = [(str(i), f"Note {i}", "wiki", None, None, ["t"], None, None, dt.date(2026, 1, 1), None, True, None, "archived" if i % 10 == 0 else "active") for i in range(n)]
    chunks = spark.createDataFrame([(i, str(i), "Text", x, ["t"]) for i, x in enumerate(texts)], "chunk_id long, document_id string, section string, text string, topics array<string>")
    people = spark.createDataFrame([], "id string, name string, role string, active boolean, seniority_years int")
    edges = spark.createDataFrame([], "person_id string, rel string, dst_kind string, dst_id string, at date")
    return ask.Corpus(chunks, spark.createDataFrame(rows, DOCS), people, edges)


def _subs(spark):
    asked = spark.createDataFrame([(k, q, None, None) for k, q in QUESTIONS], "question_id long, question string, profile_country string, profile_name string")
    return ask.parts(asked, ask.Rules(topics=[("t", "ledger")]))


def embed(rows, key, text):
    return hashed_embeddings(rows, key, text, 16)


def test_texts_are_moved_once_for_their_titles(joined):
    corpus, subs = _corpus(joined), ask.cut(_subs(joined))
    once = moved(joined, lambda: corpus.chunks.repartition(4, "chunk_id").write.format("noop").mode("overwrite").save())
    assert moved(joined, lambda: ask.pool(subs, corpus, embed).collect()) < 1.5 * once


def test_many_candidates_find_the_same(joined, monkeypatch):
    corpus, subs = _corpus(joined, 60), ask.cut(_subs(joined))
    found = lambda: sorted((r.sub_id, r["rank"], r.chunk_id, r.doc_id, r.relevance, r.rrf, r.sim, r.title, r.body[:20], tuple(r.vector)) for r in ask.pool(subs, corpus, embed).collect())
    few = found()
    assert {r[0] // ask.PARTS for r in few} == {1, 2, 3} and all(int(r[3]) % 10 for r in few)
    for module, name in ((retrieve, "FEW"), (retrieve, "ASKED"), (search, "SENT"), (search, "BLOCK")):
        monkeypatch.setattr(module, name, 1)
    assert found() == few


@pytest.mark.parametrize("bounds", [(200_000, 2000), (5, 2000), (0, 0), (200_000, 2)])
def test_postings_of_pairs_are_all_found(spark, monkeypatch, bounds):
    monkeypatch.setattr(search, "SENT", bounds[0])
    monkeypatch.setattr(search, "BLOCK", bounds[1])
    draw = random.Random(7)
    index = [(s, p, [1]) for s in "abcdefgh" for p in range(40) if draw.random() < 0.5]
    asked = [(1, 0, "a"), (2, 0, "b"), (2, 0, "c"), (3, 0, "d"), (3, 0, "e"), (3, 0, "f"), (3, 0, "g")]
    pairs = [(q, 0, p) for q, n in ((1, 30), (2, 3), (3, 4)) for p in draw.sample(range(40), n)]
    got = search._needed(
        spark.createDataFrame(index, "stem string, passage_id long, positions array<int>"), ask.cut(spark.createDataFrame(pairs, "question_id long, clause int, passage_id long")),
        spark.createDataFrame(asked, "question_id long, clause int, stem string"),
    )
    got = [(r.stem, r.passage_id) for r in got.collect()]
    need = {(s, p) for q, c, p in pairs for q2, c2, s in asked if (q, c) == (q2, c2)} & {(s, p) for s, p, _ in index}
    assert need <= set(got) and len(got) == len(set(got)) and got
    assert all(s != "h" for s, _ in got) or bounds[0]  # sent by stems alone
