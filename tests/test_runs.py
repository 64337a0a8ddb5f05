"""Runs are counted in the pass that writes; failures are logged and raised. Rich-text trees against a walk in Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trustweave.operators import ingest, runs
from trustweave.sources import connectors

UNIT = "id string, content_hash string"


def jobs(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def world(spark, tmp_path):
    current = spark.createDataFrame([("a", "1", "active"), ("b", "1", "archived"), ("x", "1", "active"), ("y", "1", "active"), ("z", "1", "retracted")], UNIT + ", status string")
    units = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "1"), ("m", "1")], UNIT)
    log = str(tmp_path / "runs")
    written = []

    def write(df):
        path = str(tmp_path / f"out{len(written)}")
        df.write.parquet(path)
        written.append(spark.read.schema(df.schema).parquet(path))

    return current, units, write, written, log


def test_counts_come_from_the_pass_that_writes(spark, world):
    current, units, write, written, log = world
    row, n = jobs(spark, "sync", lambda: runs.sync("wiki", lambda: units, current, write, lambda df: None, since="2026-01-02"))
    assert {k: row[k] for k in ("fetched", "inserted", "updated", "unchanged", "archived", "error")} == {"fetched": 4, "inserted": 2, "updated": 1, "unchanged": 1, "archived": 0, "error": None}
    assert ingest.counts(written[0]).first().asDict() == {k: row[k] for k in ("fetched", "inserted", "updated", "unchanged")}
    _, plain = jobs(spark, "plain", lambda: write(ingest.classify(units, current)))
    assert n == plain  # counting costs no job


def test_full_runs_archive_and_are_logged(spark, world):
    current, units, write, written, log = world
    runs.sync("wiki", lambda: units, current, write, runs.appended(spark, log), mode="full")
    runs.sync("wiki", lambda: units.limit(0), current, write, runs.appended(spark, log), mode="full")
    rows = sorted(spark.read.schema(runs.SCHEMA).parquet(log).collect(), key=lambda r: r.started_at)
    assert [(r.fetched, r.archived, r.error) for r in rows] == [(4, 2, None), (0, 0, None)]
    assert {(r.id, r.status, r.change) for r in written[1].collect()} == {("x", "archived", "archived"), ("y", "archived", "archived")}
    assert all(r.started_at <= r.finished_at for r in rows)


def test_failures_are_logged_and_raised(spark, world):
    current, units, write, written, log = world

    def broken():
        raise OSError("no answer")

    run = lambda name, load: lambda: runs.sync(name, load, current, write, runs.appended(spark, log))
    with pytest.raises(ExceptionGroup) as e:
        runs.sync_all({"bad": run("bad", broken), "good": run("good", lambda: units), "worse": run("worse", lambda: units.select("id", F.raise_error(F.lit("bad unit")).cast("string").alias("content_hash")))})
    assert [type(x).__name__ for x in e.value.exceptions][0] == "OSError" and len(e.value.exceptions) == 2
    rows = {r.connector: r for r in spark.read.schema(runs.SCHEMA).parquet(log).collect()}
    assert rows["bad"].error == "OSError: no answer" and rows["good"].fetched == 4 and rows["good"].error is None and "bad unit" in rows["worse"].error


def walk(node):
    if isinstance(node, dict):
        own = [node["text"]] if isinstance(node.get("text"), str) else []
        return own + (sum(map(walk, node["content"]), []) if isinstance(node.get("content"), list) else [])
    return sum(map(walk, node), []) if isinstance(node, list) else []


def tree(draw, depth):
    if depth == 0 or draw.random() < 0.15:
        return draw.choice([{"text": draw.choice(["One.", " two \n ", "é x", ""])}, {"text": 5}, {"type": "rule"}, "loose", None, 7, {"text": None, "content": "no list"}])
    if draw.random() < 0.2:
        return [tree(draw, depth - 1) for _ in range(draw.randint(0, 3))]
    out = {"type": "p", "content": [tree(draw, depth - 1) for _ in range(draw.randint(0, 4))]}
    return out | ({"text": "own"} if draw.random() < 0.3 else {})


def test_rich_text_trees_without_python(spark):
    draw = random.Random(6)
    trees = [tree(draw, draw.randint(0, 9)) for _ in range(120)]
    deep = {"text": "bottom"}
    for _ in range(40):
        deep = {"content": [deep]}
    rows = [(i, json.dumps(x)) for i, x in enumerate([*trees, deep])] + [(900, None), (901, "{broken"), (902, ""), (0, json.dumps(trees[0]))]
    df = connectors.rich_texts(spark.createDataFrame(rows, "id int, body string").repartition(3), "body", "said")
    want = sorted((i, "" if x is None or x in ("{broken", "") else " ".join(" ".join(walk(json.loads(x))).split())) for i, x in rows)
    assert sorted((r.id, r.said) for r in df.collect()) == want
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert connectors.rich_texts(df.limit(0), "body", "said").count() == 0
