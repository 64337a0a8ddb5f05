"""Paged responses: batch and stream read the same, filters reach the reader, a restart goes on where it stopped."""

import json

import pytest
from pyspark.sql import functions as F

from trustweave.sources import connectors, paged

ITEM = "id string, channel string, content string"


def write(folder, name, ids, then=None, **more):
    items = [{"id": i, "lastModifiedDateTime": f"2026-01-{int(i) % 27 + 1:02d}T00:00:00Z", "channel": "pay", "content": f"message {i} " * 12, "deep": {"é": [1, None]}} for i in ids]
    (folder / name).write_text(json.dumps({"value": items, "next": then, **more}))


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "responses"
    d.mkdir()
    write(d, "page-1.json", range(0, 10), "page-2.json")
    write(d, "page-2.json", range(10, 17), "page-3.json")
    write(d, "page-3.json", [], "page-4.json")
    write(d, "page-4.json", range(17, 20), "page-1.json")  # a link back ends it
    return d


def load(spark, folder, **options):
    paged.register(spark)
    return spark.read.format("paged_responses").options(path=str(folder), **options).load()


def test_batch_reads_all_pages(spark, folder):
    rows = load(spark, folder)
    assert sorted(int(r.id) for r in rows.collect()) == list(range(20))
    assert rows.rdd.getNumPartitions() == 3  # one a page that has items
    assert json.loads(rows.where("id = '3'").first().payload)["deep"] == {"é": [1, None]}
    said = connectors.teams(paged.responses(spark, str(folder), ITEM))
    assert said.count() == 20 and said.first().title == "Teams message in #pay"
    assert load(spark, folder / "nothing").count() == 0


def test_filters_reach_the_reader(spark, folder):
    rows = load(spark, folder).where(F.col("modified") >= F.to_timestamp(F.lit("2026-01-15T00:00:00Z")))
    assert sorted(int(r.id) for r in rows.collect()) == list(range(14, 20))
    late = load(spark, folder).where(F.col("modified") > F.to_timestamp(F.lit("2026-01-15T00:00:00Z")))
    assert sorted(int(r.id) for r in late.collect()) == list(range(15, 20))
    reader = paged._Batch({"path": str(folder)})
    left = list(reader.pushFilters([paged.GreaterThanOrEqual(("modified",), paged._time("2026-01-15T00:00:00Z")), paged.EqualTo(("page",), "page-2.json"), paged.EqualTo(("payload",), "x")]))
    assert [type(f) for f in left] == [paged.EqualTo] and [p.name for p in reader.partitions()] == ["page-2.json"]
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 3
    assert load(spark, folder, since="2026-01-15T00:00:00Z").count() == 6
    assert load(spark, folder).where("page = 'page-4.json'").count() == 3


def test_stream_equals_batch_and_resumes(spark, folder, tmp_path):
    write(folder, "page-4.json", range(17, 20), None)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        q = paged.responses(spark, str(folder), ITEM, stream=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(int(r.id) for r in spark.read.schema("modified timestamp, " + ITEM).parquet(out).collect())

    assert run() == list(range(20)) == sorted(int(r.id) for r in paged.responses(spark, str(folder), ITEM).collect())
    write(folder, "page-4.json", range(17, 23), "page-5.json")  # the last page grows, and another follows
    write(folder, "page-5.json", [23, 24])
    assert run() == list(range(25))
    assert run() == list(range(25))  # nothing new
    offsets = [json.loads(x.read_text().split("\n")[-1]) for x in sorted((tmp_path / "cp" / "offsets").glob("[0-9]*"))]
    assert offsets[-1] == {"page": "page-5.json", "items": 2}
