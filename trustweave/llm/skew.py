"""Joins that a heavy key can't stop, and names that clash with none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many keys a table is broadcast whole; beyond, only the keys that hold more than one in ``HOT`` of all rows are, so ``HOT`` at most.
SENT, HOT = 200_000, 10_000


def free(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with none of ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    return [next(n for n in ("_" * i + name for i in range(1, len(columns) + 2)) if n.lower() not in taken) for name in names]


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for a key and says in ``weight`` how many of ``rows`` hold it.

    Keys are strings that don't begin with ``#``. Rows without a key, or with one that the table lacks, get nulls. Heavy keys go by broadcast, and their rows,
    like those without a key, are dealt out evenly before the shuffle that serves the others.
    """
    if table.count() <= SENT:
        return rows.join(F.broadcast(table), key, "left")
    total = table.agg(F.sum(weight)).first()[0]
    others = [c for c in table.columns if c != key]
    at, *held = free([*rows.columns, *table.columns], "at", *others)
    is_heavy = F.col(weight) * HOT > total
    heavy = table.where(is_heavy).select(key, *[F.col(c).alias(h) for c, h in zip(others, held, strict=True)])
    light = table.where(~is_heavy).withColumnRenamed(key, at)
    rows = rows.join(F.broadcast(heavy), key, "left")
    served = F.col(key).isNull() | F.col(held[others.index(weight)]).isNotNull()
    rows = rows.withColumn(at, F.when(served, F.concat(F.lit("#"), F.monotonically_increasing_id())).otherwise(F.col(key)))
    out = rows.join(light, at, "left")
    for c, h in zip(others, held, strict=True):
        out = out.withColumn(c, F.coalesce(c, h))
    return out.drop(at, *held)
