"""Many phrases in many texts: automata over parts of the rule table, each sent to the tasks once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: Characters of phrases that one automaton holds, some 50 to 100 bytes each in a worker; a larger table takes one pass over the texts for each so many.
PART = 2_000_000

_BUILT: dict = {}


def _automaton(key, keywords: list[str]):
    """The automaton of one part, and the numbers of the rules that share a keyword; a worker keeps the last one."""
    if key not in _BUILT:
        same: dict[str, list[int]] = {}
        for i, k in enumerate(keywords):
            same.setdefault(k, []).append(i)
        found = ahocorasick.Automaton()
        for k, numbers in same.items():
            found.add_word(k, (len(k), numbers))
        found.make_automaton()
        _BUILT.clear()
        _BUILT[key] = found
    return _BUILT[key]


def _letter(c: str) -> bool:
    return "a" <= c <= "z"


def _found(low: str, automaton, bounded: bool) -> Iterator[int]:
    """Numbers of the rules that a lower-case text meets, each once."""
    seen: set[int] = set()
    for end, (size, numbers) in automaton.iter(low):
        if numbers[0] not in seen:
            start = end - size + 1
            if not bounded or not (start and _letter(low[start - 1]) or end + 1 < len(low) and _letter(low[end + 1])):
                seen.update(numbers)
    yield from sorted(seen)


def numbered(texts: DataFrame) -> DataFrame:
    """Texts (id, text) with a number for each row, written so that every pass has the same: row, id, low."""
    return cut(texts.select(F.monotonically_increasing_id().alias("row"), "id", F.lower("text").alias("low")))


def met_in(rows: DataFrame, table: DataFrame, bounded: bool = True) -> DataFrame:
    """Rules (priority, code, keyword) that the texts of ``numbered`` meet: row, id, priority, code, keyword.

    A keyword counts anywhere, or (``bounded``) where no letter a to z stands right before or after it. Each text gives a row for each rule that it meets. The
    table is dealt into parts by the hash of its keywords, so one part's size in the driver and the tasks is bounded whatever the table's. Null and
    empty keywords are never met, null and empty texts meet nothing.
    """
    spark = rows.sparkSession
    table = table.select(F.col("priority").cast("int").alias("priority"), "code", "keyword").where("keyword <> ''")
    total = table.agg(F.sum(F.length("keyword"))).first()[0] or 0
    parts = max(1, -(-total // PART))
    kind = f"row long, id {rows.schema['id'].dataType.simpleString()}, priority int, code string, keyword string"
    out = None
    for p in range(parts):
        own = table.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == p).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        shared = spark.sparkContext.broadcast(own)

        def search(batches, shared=shared, key=uuid.uuid4().hex):
            rules = shared.value
            automaton = _automaton(key, rules.column("keyword").to_pylist())
            for batch in batches:
                at, numbers = [], []
                for i, low in enumerate(batch.column(2).to_pylist()):
                    for n in _found(low, automaton, bounded) if low else ():
                        at.append(i)
                        numbers.append(n)
                if at:
                    said = rules.take(pa.array(numbers)).combine_chunks()
                    texts = batch.select([0, 1]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*texts.columns, *(c.combine_chunks() for c in said.columns)], names=["row", "id", "priority", "code", "keyword"])

        found = rows.select("row", "id", "low").mapInArrow(search, kind)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], kind) if out is None else out


def met(texts: DataFrame, table: DataFrame, bounded: bool = True) -> DataFrame:
    """``met_in`` of texts (id, text)."""
    return met_in(numbered(texts), table, bounded)
