"""The life of documents as a stream: changes, reviews that fall due and documents that are not seen any more, by event time.

A document's events wait in its state until the watermark has passed them and are then taken in order, so shuffled, repeated and (within the watermark) late batches give what ordered ones
give. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from .. import config

OUT = "id string, at timestamp, what string, status string, content_hash string, assignee_id string"
STATE = "content_hash string, status string, updated long, validated long, seen long, doc_type string, owner_id string, owner_active boolean, author_id string, asked boolean, left boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = 86_400_000
_BLANK = dict.fromkeys(["content_hash", "status", "updated", "validated", "seen", "doc_type", "owner_id", "owner_active", "author_id"]) | {"asked": False, "left": False}


def _period(doc_type: str | None) -> int | None:
    """Milliseconds after which a document is due for review; None for what is never reviewed."""
    if doc_type in config.NO_REVIEW:
        return None
    return (int(config.HALF_LIFE[doc_type] * 1.2) if doc_type in config.HALF_LIFE else config.HALF_LIFE_ELSE) * _DAY


def due(doc: dict, keep: int, upto: int) -> Iterator[tuple[int, str, str | None]]:
    """What time alone does to a document up to a moment (time, what, assignee), in order; ``doc`` changes with it."""
    while doc["status"] == "active":
        period, asks = _period(doc["doc_type"]), doc["owner_active"] or (doc["owner_id"] is None and doc["author_id"] is not None)
        review = max(doc["updated"], doc["validated"] or doc["updated"]) + period if period is not None and asks and not doc["asked"] else None
        gone = doc["seen"] + keep * _DAY
        first = min(gone, gone if review is None else review)
        if first > upto:
            return
        if first == review:
            doc["asked"] = True
            yield first, "confirm_valid", doc["owner_id"] or doc["author_id"]
        else:
            doc["status"] = "archived"
            yield first, "archived", None


def take(doc: dict, at: int, event: dict) -> Iterator[tuple[int, str, str | None]]:
    """What an event does to a document; ``doc`` changes with it.

    Units bring archived documents back when their content has changed, not otherwise; an owner who has left is told once, until another one owns the document. A change or a
    confirmation closes the question whether a document is still valid.
    """
    if event["kind"] == "validated":
        if doc["status"]:
            doc["validated"], doc["asked"] = at, False
        return
    before = doc["content_hash"]
    changed = before != event["content_hash"]
    doc |= {k: event[k] for k in ("doc_type", "owner_id", "owner_active", "author_id")} | {"seen": at}
    if changed:
        doc |= {"content_hash": event["content_hash"], "status": "active", "updated": at, "asked": False}
        yield at, "inserted" if before is None else "updated", None
    gone = doc["owner_id"] is not None and doc["owner_active"] is False
    if gone and not doc["left"] and doc["status"] == "active" and doc["doc_type"] not in config.NO_REVIEW:
        yield at, "reassign_owner", None
    doc["left"] = gone


class Life(StatefulProcessor):
    """Keeps a document and the events that the watermark has not passed."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.doc = handle.getValueState("doc", STATE)
        self.waiting = handle.getMapState("waiting", "at long, kind string, content_hash string", "doc_type string, owner_id string, owner_active boolean, author_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.ms, r.kind, r.content_hash or ""), (r.doc_type, r.owner_id, r.owner_active, r.author_id))
            self.handle.registerTimer(r.ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        doc = dict(zip(_BLANK, self.doc.get(), strict=True)) if self.doc.exists() else dict(_BLANK)
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= passed) if self.waiting.exists() else []
        said = []
        for (at, kind, content), rest in ready:
            said += due(doc, self.keep, at)
            said += take(doc, at, {"kind": kind, "content_hash": content, **dict(zip(("doc_type", "owner_id", "owner_active", "author_id"), rest, strict=True))})
            yield from self._told(key, doc, said)
            self.waiting.removeKey((at, kind, content))
        said += due(doc, self.keep, passed)
        yield from self._told(key, doc, said)
        self.doc.update(tuple(doc.values()))
        if doc["status"] == "active":
            nxt = next((t for t, *_ in due(dict(doc), self.keep, 1 << 62)), None)
            if nxt is not None:
                self.handle.registerTimer(nxt)

    def _told(self, key, doc: dict, said: list) -> Iterator[Row]:
        for at, what, who in said:
            yield self._row(key, at, what, "archived" if what == "archived" else "active", doc["content_hash"], who)
        said.clear()

    @staticmethod
    def _row(key, at, what, status, content, who) -> Row:
        return Row(id=key[0], ms=at, what=what, status=status, content_hash=content, assignee_id=who)

    def close(self) -> None:
        pass


def lives(events: DataFrame, keep: int = 90, late: str = "1 day") -> DataFrame:
    """What becomes of documents, from a stream of events (id, at, kind, content_hash, doc_type, owner_id, owner_active, author_id): id, at, what, status, content_hash, assignee_id.

    ``kind``: unit (a source brought the document) or validated (its owner confirmed it). Of events with one time, kind and content any one counts. A document is archived when no unit came for
    ``keep`` days; a review is asked for when its period is over. Events that the watermark (``late`` behind the newest) has passed
    don't reach the state: Spark drops them and counts them in the query's progress (numRowsDroppedByWatermark).
    """
    rows = events.withColumn("ms", F.unix_millis("at")).withWatermark("at", late).groupBy("id")
    kind = OUT.replace("at timestamp", "ms long")
    out = rows.transformWithState(statefulProcessor=Life(keep), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return out.select("id", F.timestamp_millis("ms").alias("at"), "what", "status", "content_hash", "assignee_id")


def start(events: DataFrame, folder: str, checkpoint: str, keep: int = 90, late: str = "1 day") -> StreamingQuery:
    """Write what becomes of documents to ``folder`` as Parquet, each row once; runs over what is there and ends."""
    return lives(events, keep, late).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
