"""Each query of the extended and composed modules against its SQL, and the word ranking against plain loops."""

import random
import re

import duckdb
import pytest

from trustweave.functions.fulltext import stem
from trustweave.functions.text import STOPWORDS
from trustweave.plans import composed, extended, queries

DIR = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ in (extended.__name__, composed.__name__)]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("orders", "customer", "lineitem", "part", "events", "documents", "pages", "benchmark", "conversations", "embeddings", "nation"):
        con.sql(f"CREATE VIEW {name} AS FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in NAMES if n in queries.ORACLE])
def test_query_matches_its_sql(spark, db, name):
    want = db.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.select(*want.columns).collect()
    assert rows and sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


def _density(asked, text):
    """Sum over the shortest stretches of ``text`` that hold all stems of ``asked`` of stems / (length + stems), by plain loops."""
    need = {stem(w) for w in re.findall("[a-z0-9]+", asked.lower()) if w not in STOPWORDS}
    said = [stem(w) if w not in STOPWORDS else None for w in re.findall("[a-z0-9]+", (text or "").lower())]
    last, total = {}, 0.0
    for p, s in enumerate(said):
        if s in need:
            last[s] = p
            if len(last) == len(need):
                start = min(last.values())
                total += len(need) / (p - start + len(need))
                last = {k: v for k, v in last.items() if v > start}
    return total


def test_passage_rank_matches_loops_over_all_passages(spark, tmp_path):
    draw = random.Random(5)
    words = "policy policies travel travels traveling cost costs review the of approved manager office".split()
    docs = {i: " ".join(draw.choices(words, k=draw.choice([0, 3, 30, 200]))) for i in range(60)}
    items = {1: "policy the", 2: "the policies of traveling costs and quarterly reviews approved by managers in the office", 3: "cost Cost costs", 4: "of the", 5: "policy unheard", 6: "office approved travels"}
    docs[99] = "Pad words first, then " + items[2]
    docs[100] = None
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for q, x in items.items():
        ranked = sorted((-round(_density(x, text), 6), p) for p, text in docs.items())
        want |= {(q, p): -r for r, p in ranked[:12] if r < 0}
    got = {(r.question_id, r.passage_id): r["rank"] for r in extended.passage_rank(spark, str(tmp_path)).collect()}
    assert (2, 99) in want and {q for q, _ in want} == {1, 2, 3, 6}  # 2 is matched in late words only
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
