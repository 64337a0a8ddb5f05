"""Sync runs: a connector's units applied and accounted for in one pass, failures recorded and told."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .ingest import classify, tombstones

SCHEMA = "connector string, mode string, trigger string, since date, fetched long, inserted long, updated long, unchanged long, archived long, started_at timestamp, finished_at timestamp, error string"
_COUNTS = ("fetched", "inserted", "updated", "unchanged")


def observed(classified: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows of ``classify`` that are counted by what became of them while they pass, and where the counts are found afterwards."""
    seen = Observation()
    is_ = lambda c: F.count_if(F.col("change") == c).alias(c)
    return classified.observe(seen, F.count("*").alias("fetched"), *(is_(c) for c in _COUNTS[1:])), seen


def sync(
    connector: str, load: Callable[[], DataFrame], current: DataFrame, write: Callable[[DataFrame], None], log: Callable[[DataFrame], None], mode: str = "delta", trigger: str = "manual", since: str | None = None
) -> dict:
    """One run: ``load`` gives units (id, content_hash, ...), ``write`` takes them judged (with change and status; all of them, so that what is unchanged can be marked as seen), and for a
    full run also, in a second call, the documents of ``current`` that were not seen, as archived. ``log`` gets the run's row when it is over.

    The counts come from the pass that writes; no other job looks at the units. A failure is logged with what was counted before it and raised again. Returns the row.
    """
    spark = current.sparkSession
    row = dict.fromkeys(SCHEMA_NAMES) | {"connector": connector, "mode": mode, "trigger": trigger, "since": None if since is None else datetime.fromisoformat(since).date(), "started_at": datetime.now(timezone.utc)}
    try:
        units = load()
        judged, seen = observed(classify(units, current))
        write(judged)
        row |= {k: seen.get[k] for k in _COUNTS} | {"archived": 0}
        if mode == "full" and row["fetched"]:
            gone = Observation()
            write(tombstones(current, units).withColumn("change", F.lit("archived")).observe(gone, F.count("*").alias("archived")))
            row["archived"] = gone.get["archived"]
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {e}"[:2000]
        raise
    finally:
        row["finished_at"] = datetime.now(timezone.utc)
        log(spark.createDataFrame([tuple(row[n] for n in SCHEMA_NAMES)], SCHEMA))
    return row


def sync_all(runs: dict[str, Callable[[], dict]]) -> dict[str, dict]:
    """Every connector's run; one that fails doesn't keep the others from running, and all failures are raised together at the end."""
    done, failed = {}, []
    for name, run in runs.items():
        try:
            done[name] = run()
        except Exception as e:
            e.add_note(f"connector {name}")
            failed.append(e)
    if failed:
        raise ExceptionGroup(f"{len(failed)} of {len(runs)} connectors failed", failed)
    return done


def appended(spark: SparkSession, path: str) -> Callable[[DataFrame], None]:
    """A log of runs kept as Parquet under ``path``."""
    return lambda rows: rows.coalesce(1).write.mode("append").parquet(path)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
