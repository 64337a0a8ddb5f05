"""Kept sums of standing against reputation from all edges."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trustweave.operators import reputation, standing

EDGES = "person_id string, rel string, dst_kind string, dst_id string, at date"


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(2)
    topics = ["a", "b", "c"]
    docs = [(str(i), draw.sample(topics, draw.randint(0, 3)), draw.choice([None, "BE", "NL"]), draw.choice(["policy", "chat", "unheard"])) for i in range(12)] + [("none", None, None, None)]
    edges = []
    for _ in range(200):
        kind = draw.choice(["doc", "doc", "topic"])
        edges.append((f"p{draw.randrange(6)}", draw.choice(["owns", "attended", "?"]), kind, draw.choice([*topics, "z"]) if kind == "topic" else str(draw.randrange(14)), dt.date(2020, 1, 1) + dt.timedelta(draw.randrange(2500))))
    people = [(f"p{i}", draw.choice([0, 4, 15])) for i in range(6)]
    return edges, spark.createDataFrame(docs, "id string, topics array<string>, country string, doc_type string"), spark.createDataFrame(people, "id string, seniority_years int")


@pytest.mark.parametrize("day", ["2026-09-30", "2021-03-01"])
def test_random_merges_equal_reputation_on_any_day(spark, world, day):
    edges, docs, people = world
    draw = random.Random(day)
    asked = {1: (["a"], "BE"), 2: (["a", "b", "c"], None), 3: (["c", "z"], "NL"), 4: (["unknown"], "BE")}
    frame = lambda rows: spark.createDataFrame(rows, EDGES)
    cuts = sorted(draw.sample(range(200), 3))
    parts = [edges[a:b] for a, b in zip([0, *cuts], [*cuts, 200], strict=True)]
    extra = draw.sample(edges, 25)  # seen once too often, and taken back
    states = [standing.sums(frame(x), docs, f"202{draw.randint(1, 6)}-0{draw.randint(1, 9)}-15") for x in [*parts, extra]]
    state = standing.merged([standing.merged(states[:2], "2024-02-29"), *states[2:], standing.removed(standing.sums(frame(extra), docs, "2023-12-31"))], "2025-07-01")
    asks = spark.createDataFrame([(k, t, c) for k, (t, c) in asked.items()], "ask_id int, topics array<string>, country string")
    got = {(r.ask_id, r.person_id): (r.raw, r.normalised, r.events) for r in standing.scored(state, asks, people, day).collect()}
    want = {}
    for k, (t, c) in asked.items():
        rows = frame(edges).withColumn("topics", F.array(*map(F.lit, t))).withColumn("country", F.lit(c).cast("string"))
        for r in reputation.reputation(reputation.weigh(rows, docs, day), people).collect():
            if r.events:
                want[k, r.id] = (r.raw, r.normalised, r.events)
    assert set(got) == set(want) and len(want) > 10
    assert all(got[k][2] == want[k][2] and abs(got[k][0] - want[k][0]) < 1e-9 * max(1, want[k][0]) and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_one_person_for_each_ask(spark, world):
    edges, docs, people = world
    state = standing.sums(spark.createDataFrame(edges, EDGES), docs, "2026-01-01")
    asks = spark.createDataFrame([("x", ["a"], None, "p1"), ("y", ["a"], None, "nobody"), ("w", None, None, "p1")], "ask_id string, topics array<string>, country string, person_id string")
    assert [(r.ask_id, r.person_id) for r in standing.scored(state, asks, people, "2026-01-01").collect()] == [("x", "p1")]
    assert standing.scored(state.limit(0), asks, people, "2026-01-01").count() == 0
