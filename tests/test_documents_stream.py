"""The life of documents: shuffled, repeated and late batches against ordered events in plain loops and the batch operators."""

import datetime as dt
import random

import pytest

from trustweave.operators import ingest
from trustweave.streaming import documents

EVENT = "id string, at timestamp, kind string, content_hash string, doc_type string, owner_id string, owner_active boolean, author_id string"
START = dt.datetime(2026, 1, 1)
DAY = dt.timedelta(days=1)


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", documents.ROCKSDB)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def life(events, until, keep):
    """All that becomes of one document, day by day in plain Python."""
    periods = {"chat": None, "policy": 864, "wiki": 438}
    doc, out = {}, []

    def pass_time(to):
        while doc.get("status") == "active":
            p = periods[doc["doc_type"]]
            asks = doc["owner_active"] or (doc["owner_id"] is None and doc["author_id"])
            steps = [(doc["seen"] + keep * DAY, 1)]
            if p and asks and not doc["asked"]:
                steps.append((max(doc["updated"], doc.get("validated") or doc["updated"]) + p * DAY, 0))
            at, kind = min(steps)
            if at > to:
                return
            if kind:
                doc["status"] = "archived"
                out.append((at, "archived"))
            else:
                doc["asked"] = True
                out.append((at, "confirm_valid"))

    for at, kind, content, doc_type, owner, active, author in events:
        pass_time(at)
        if kind == "validated":
            if doc:
                doc |= {"validated": at, "asked": False}
            continue
        new = doc.get("hash") != content
        was = doc.get("hash")
        doc |= {"doc_type": doc_type, "owner_id": owner, "owner_active": active, "author_id": author, "seen": at}
        if new:
            doc |= {"hash": content, "status": "active", "updated": at, "asked": False}
            out.append((at, "updated" if was else "inserted"))
        left = owner is not None and active is False
        if left and not doc.get("left") and doc["status"] == "active" and doc_type != "chat":
            out.append((at, "reassign_owner"))
        doc["left"] = left
    pass_time(until)
    return out, doc


def run(spark, tmp_path, batches, keep):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(src)
        documents.start(spark.readStream.schema(EVENT).parquet(src), out, cp, keep, "30 days").awaitTermination()
    return spark.read.schema(documents.OUT).parquet(out).collect()


def test_shuffled_late_and_repeated_batches_equal_ordered_events(spark, tmp_path):
    draw, keep, events = random.Random(5), 500, []
    for k in range(14):
        at = START + draw.randrange(20) * DAY
        for _ in range(draw.randint(1, 7)):
            kind = draw.choice(["unit", "unit", "unit", "validated"])
            owner = draw.choice([None, "p", "q"])
            events.append((f"d{k}", at, kind, draw.choice("abc") if kind == "unit" else None, draw.choice(["policy", "wiki", "wiki", "chat"]), owner, None if owner is None else owner == "p", draw.choice([None, "w"])))
            at += draw.choice([1, 3, 200, 450, 900]) * DAY
    events.sort(key=lambda e: e[1])
    end = START + 6000 * DAY
    # batches by time, each shuffled, with rows of the last 30 days moved into the next batch and some rows sent twice
    batches, held = [], []
    for lo in range(0, len(events), 14):
        part = held + events[lo : lo + 14]
        newest = max(e[1] for e in part)
        held = [e for e in part if newest - e[1] < 25 * DAY and draw.random() < 0.4]
        part = [e for e in part if e not in held] + draw.sample(part, 2)
        draw.shuffle(part)
        batches.append(part)
    batches += [held or [events[-1]], [("~", end + 30 * DAY, "unit", "z", "chat", None, None, None)], [("~", end + 31 * DAY, "unit", "z", "chat", None, None, None)]]
    rows = run(spark, tmp_path, batches, keep)
    got = sorted((r.id, r.at, r.what) for r in rows if r.id != "~" and r.at <= end)
    want, last = [], {}
    for k in {e[0] for e in events}:
        own = sorted({e[1:] for e in events if e[0] == k}, key=lambda e: (e[0], e[1], e[2] or ""))
        out, last[k] = life(own, end, keep)
        want += [(k, at, what) for at, what in out]
    assert got == sorted(want) and {w for _, _, w in want} == {"inserted", "updated", "archived", "confirm_valid", "reassign_owner"}

    # the content that is left is what the batch operators leave of the same units
    current = spark.createDataFrame([], "id string, content_hash string, status string")
    newest = {}
    for e in events:
        if e[2] == "unit":
            newest[e[0]] = e[3]
    current = ingest.apply(spark.createDataFrame(list(newest.items()), "id string, content_hash string"), current)
    assert {r.id: r.content_hash for r in current.collect()} == {k: d["hash"] for k, d in last.items() if d}


def test_what_the_watermark_has_passed_changes_nothing(spark, tmp_path):
    unit = lambda i, day, content: (i, START + day * DAY, "unit", content, "wiki", "p", True, None)
    rows = run(spark, tmp_path, [[unit("a", 100, "1")], [unit("b", 300, "1")], [unit("a", 10, "0"), unit("a", 299, "2")], [unit("b", 900, "1")], [unit("b", 901, "1")]], 365)
    told = sorted((r.what, r.content_hash, (r.at - START).days) for r in rows if r.id == "a")
    assert told == [("archived", "2", 664), ("inserted", "1", 100), ("updated", "2", 299)]
