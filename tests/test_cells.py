"""The index of cells against exact search."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustweave.functions.vectors import cosine
from trustweave.operators import cells, retrieve

KIND = "chunk_id long, vector array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    """Loose groups, a vector that a third of the rows share, zero vectors and rows without any."""
    draw = np.random.default_rng(7)
    middle = draw.normal(size=(12, 24))
    x = middle[draw.integers(0, 12, 2000)] + 0.7 * draw.normal(size=(2000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[3].tolist()) for i in range(1000)] + [(9000, [0.0] * 24), (9001, None)]
    return spark.createDataFrame(rows, KIND).repartition(6)


def test_recall_and_exact_similarity(chunks):
    made = cells.fit(chunks)
    index = cells.build(chunks, made).cache()
    assert index.count() == 3001 and 1 < made.probes < len(made.centres)
    asked = chunks.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    want = retrieve.knn(asked, chunks.where("vector IS NOT NULL"))
    found = cells.search(asked, index, made)
    seen = cells.recall(found, want).agg(F.sum("found") / F.sum("of")).first()[0]
    assert seen >= 0.9
    both = found.join(want.withColumnRenamed("sim", "s"), ["query_id", "chunk_id"]).select("sim", "s").collect()
    assert len(both) > 1000 and max(abs(r.sim - r.s) for r in both) < 2e-6
    made.probes = len(made.centres)  # all cells: nothing is missed
    whole = cells.search(asked, index, made).select("query_id", "rank", F.round("sim", 5)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, want.select("query_id", "rank", F.round("sim", 5)).collect()))


def test_blocks_of_questions_and_few_cells_read(spark, chunks, monkeypatch):
    made = cells.fit(chunks, cells=30)
    index = cells.build(chunks, made)
    asked = chunks.where("chunk_id % 50 = 0 AND chunk_id < 2000").withColumnRenamed("chunk_id", "query_id")
    once = cells.search(asked, index, made).collect()
    monkeypatch.setattr(cells, "BLOCK", 7)
    assert sorted(map(tuple, cells.search(asked, index, made).collect())) == sorted(map(tuple, once))
    made.probes = 1
    plan = cells.search(asked.limit(1), index, made)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "EqualTo(cell" in plan or "cell#" in plan and "PushedFilters: [IsNotNull(cell)" in plan


def test_nothing_to_find(spark, chunks):
    none = chunks.limit(0)
    made = cells.fit(none)
    asked = chunks.limit(3).withColumnRenamed("chunk_id", "query_id")
    assert cells.search(asked.withColumn("vector", F.lit(None).cast("array<float>")), cells.build(chunks, cells.fit(chunks)), cells.fit(chunks)).count() == 0
    assert cells.build(none, made).count() == 0
    assert cells.search(none.withColumnRenamed("chunk_id", "query_id"), cells.build(none, made), made).count() == 0


def test_exact_search_equals_the_cosine_of_all_pairs(spark, chunks):
    asked = chunks.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    pairs = asked.withColumnRenamed("vector", "q").crossJoin(chunks).where("q IS NOT NULL AND vector IS NOT NULL").select("query_id", "chunk_id", F.round(cosine(F.col("q"), F.col("vector")), 6).alias("sim"))
    best = {}
    for r in pairs.collect():
        best.setdefault(r.query_id, []).append((-r.sim, r.chunk_id))
    got = {}
    for r in retrieve.knn(asked, chunks).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.sim))
    assert {q: [round(-s, 5) for s, _ in sorted(v)[:15]] for q, v in best.items()} == {q: [round(s, 5) for _, s in sorted(v)] for q, v in got.items()}


def test_memory_of_a_task_is_bounded(spark, chunks, monkeypatch):
    """neither similarities nor equals pile up in a task."""
    draw = np.random.default_rng(2)
    q = draw.normal(size=(1500, 8))
    x = np.concatenate([np.repeat(draw.normal(size=(1, 8)), 6000, axis=0), draw.normal(size=(2000, 8))])
    ids = draw.permutation(len(x))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(ids), pa.array(list(x))], names=["cell", "chunk_id", "vector"])
    shared = SimpleNamespace(value=(np.arange(len(q)), cells._unit(q), {0: np.arange(len(q), dtype=np.int32)}))
    tracemalloc.start()
    found = next(iter(cells._best(shared, 15)(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    sim = np.round(cells._unit(x) @ cells._unit(q).T, 6)
    want = [i for j in range(len(q)) for i in ids[np.lexsort((ids, -sim[:, j]))[:15]]]
    assert found.column("chunk_id").to_pylist() == want
    assert peak < 64 << 20
    whole = sorted(map(tuple, retrieve.knn(chunks.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), chunks).collect()))
    monkeypatch.setattr(cells, "SLICE", 40)
    monkeypatch.setattr(cells, "PRODUCTS", 500)
    assert whole == sorted(map(tuple, retrieve.knn(chunks.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), chunks).collect()))
