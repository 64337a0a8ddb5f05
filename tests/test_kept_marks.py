import pytest

from trustweave.functions import fulltext
from trustweave.operators import search, search_index


@pytest.mark.parametrize("sent", [100, 0])
def test_postings_are_not_shuffled_for_what_was_replaced(spark, tmp_path, monkeypatch, sent):
    """batches that add ask for no join, and what later ones replaced is sent to the tasks."""
    folder = str(tmp_path)
    monkeypatch.setattr(search, "SENT", 0)
    monkeypatch.setattr(search_index, "SENT", sent)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        make = lambda n, rows, gone=(): search_index.update(
            spark, folder, n, spark.createDataFrame(rows, "passage_id long, text string"), spark.createDataFrame([(g,) for g in gone], "passage_id long"), fulltext.simple, merge=4
        )
        plan = lambda n: search_index.postings(spark, folder, n, merge=4)._jdf.queryExecution().executedPlan().toString()
        make(0, [(i, f"alpha beta w{i}") for i in range(20)])
        make(1, [(i, f"alpha gamma w{i}") for i in range(20, 40)], [77])
        assert "Join" not in plan(2)
        make(2, [(i, "delta") for i in range(0, 40, 4)], [1, 2])
        assert ("SortMergeJoin" in plan(3)) == (sent == 0)
        make(3, [(1, "alpha back")], [4])  # a merge
        live = {i: {"alpha", "beta" if i < 20 else "gamma", f"w{i}"} for i in range(40)} | {i: {"delta"} for i in range(0, 40, 4)} | {1: {"alpha", "back"}}
        want = {(s, i) for i, stems in live.items() for s in stems if i not in (2, 4)}
        rows = search_index.postings(spark, folder, 4, merge=4).collect()
        assert {(r.stem, r.passage_id) for r in rows} == want and len(rows) == len(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
