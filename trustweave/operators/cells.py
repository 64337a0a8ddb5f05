"""Approximate nearest chunks: cells around centres of a bounded sample, several probes a question, exact similarity within."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Centres are fitted on so many vectors at most, and on so many bytes of them; questions go to the tasks in blocks with the same bounds.
SAMPLE, BYTES, BLOCK = 16_384, 64 << 20, 2_000
#: Probes are chosen so that this share of the nearest is found within the sample, for so many questions taken from it.
TARGET, TRIED = 0.97, 200
STEPS = 12
#: Chunks that a task looks at together, and similarities that it holds at a time.
SLICE, PRODUCTS = 2048, 1 << 20


@dataclass
class Cells:
    """Centres of length one (a row each) and how many of the nearest a question looks into."""

    centres: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float32) @ self.centres.T).argmax(axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        near = x.astype(np.float32) @ self.centres.T
        return np.argsort(-near, axis=1, kind="stable")[:, : self.probes]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit vectors of a list column; all lists must have one length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return _unit(np.asarray(col.flatten().cast(pa.float64())).reshape(len(col), -1))


def fit(chunks: DataFrame, cells: int | None = None, k: int = 15) -> Cells:
    """Cells for chunks (chunk_id, vector): as many as the square root of the chunks, or ``cells``, and no more than half the sample.

    The sample is taken by a hash of chunk_id, so it is the same always; it has ``SAMPLE`` rows at most. Chunks without a vector take no part. Without chunks there is one cell.
    """
    rows = chunks.where("vector IS NOT NULL").select("chunk_id", "vector")
    n, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return Cells(np.zeros((1, 1), np.float32), 1)
    most = max(256, min(SAMPLE, BYTES // (8 * max(size, 1))))
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 0.9 * most / n)) if n > most else F.lit(True)
    x = _matrix(rows.where(share).limit(most).toArrow().column("vector"))
    draw = np.random.default_rng(0)
    many = max(1, min(cells or int(n**0.5), len(x) // 2 or 1))
    centres = x[draw.choice(len(x), many, replace=False)]
    for _ in range(STEPS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=many) == 0
        sums[empty] = x[draw.choice(len(x), int(empty.sum()))]
        centres = _unit(sums)
    found = Cells(centres.astype(np.float32), many)
    # the fewest probes that find enough of the nearest among the sample
    asked = draw.choice(len(x), min(TRIED, len(x)), replace=False)
    own, order = found.nearest(x), found.probed(x[asked])
    near = np.argsort(-(x[asked] @ x.T), axis=1)[:, :k]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(many)[None, :], axis=1)
    seen = np.take_along_axis(place, own[near], axis=1)  # at which probe each of the nearest is found
    found.probes = next((p for p in range(1, many) if (seen < p).mean() >= TARGET), many)
    return found


def build(chunks: DataFrame, cells: Cells) -> DataFrame:
    """Every chunk (chunk_id, vector) with its cell, written in order of cells: cell, chunk_id, vector.

    Rows are dealt by ranges of cell and chunk_id, so a cell that holds a large share of them is spread over several files, and a search reads only the row groups of
    its cells. Chunks without a vector are left out.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(cells)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.nearest(_matrix(batch.column(1))), pa.int32()), batch.column(0), batch.column(1)], names=["cell", "chunk_id", "vector"])

    rows = chunks.where("vector IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "vector")
    kind = rows.schema["vector"].dataType.simpleString()
    placed = rows.mapInArrow(assign, f"cell int, chunk_id long, vector {kind}")
    return cut(placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell", "chunk_id"))


def _best(shared, k: int):
    """(query_id, chunk_id, sim): the ``k`` best chunks of a task for each question, among the cells that it probes."""

    def top(rows):
        rows = rows[np.lexsort((rows["chunk"], -rows["sim"], rows["q"]))]
        return rows[np.arange(len(rows)) - np.searchsorted(rows["q"], rows["q"]) < k]

    def run(batches):
        ids, q, asked = shared.value  # asked: cell -> numbers of questions
        kept = np.zeros(0, [("q", np.int32), ("chunk", np.int64), ("sim", np.float64)])
        floor = np.full(len(ids), -np.inf)  # similarity of the last of k that are kept
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                cell, chunk, found = piece.column(0).to_numpy(), piece.column(1).to_numpy(), [kept]
                x = _matrix(piece.column(2))
                for c in np.unique(cell):
                    who, rows = asked.get(int(c)), np.flatnonzero(cell == c)
                    if who is None:
                        continue
                    rows, vectors, step = rows[np.argsort(chunk[rows], kind="stable")], q[who].T, max(1, PRODUCTS // len(who))
                    for lo in range(0, len(rows), step):
                        part = rows[lo : lo + step]
                        sim = x[part] @ vectors
                        np.round(sim, 6, out=sim)
                        least = np.maximum(floor[who], np.partition(sim, -k, axis=0)[-k] if len(part) > k else -np.inf)
                        more, tied = sim > least, sim == least
                        tied &= np.cumsum(tied, axis=0, dtype=np.int32) <= k  # equals in order of their ids
                        row, which = np.nonzero(more | tied)
                        new = np.empty(len(row), kept.dtype)
                        new["q"], new["chunk"], new["sim"] = who[which], chunk[part[row]], sim[row, which]
                        found.append(new)
                if len(found) > 1:
                    kept = top(np.concatenate(found))
                    last = np.flatnonzero(np.bincount(kept["q"], minlength=len(ids)) == k)
                    floor[last] = kept["sim"][np.searchsorted(kept["q"], last, side="right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept["q"]]), pa.array(kept["chunk"]), pa.array(kept["sim"])], names=["query_id", "chunk_id", "sim"])

    return run


def _asked(questions: DataFrame, k: int, probed, part_of) -> DataFrame:
    """The ``k`` best chunks of questions, a block of them at a time: ``probed`` says which cells their vectors look into, ``part_of`` what to read for those cells."""
    spark = questions.sparkSession
    rows = questions.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), "vector")
    n, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = max(1, min(BLOCK, BYTES // (8 * max(size or 1, 1))))
    blocks = max(1, -(-n * 5 // (4 * most)))
    out = None
    for b in range(blocks):
        table = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not table.num_rows and (out is not None or b < blocks - 1):
            continue
        q = _matrix(table.column("vector")) if table.num_rows else np.zeros((0, 1))
        near = probed(q) if len(q) else np.zeros((0, 0), np.int64)
        asked = {int(c): np.flatnonzero((near == c).any(axis=1)).astype(np.int32) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((pc.cast(table.column("query_id"), pa.int64()).to_numpy(), q, asked))
        part = part_of(asked).select("cell", "chunk_id", "vector").mapInArrow(_best(shared, k), "query_id long, chunk_id long, sim double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "chunk_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(questions: DataFrame, index: DataFrame, cells: Cells, k: int = 15) -> DataFrame:
    """The ``k`` most similar chunks of each question (query_id: long, vector) that its probed cells hold: query_id, chunk_id, sim, rank.

    Similarities are exact; what is missed lies in cells that are not probed (none with as many probes as cells). Questions are a stated set, sent in blocks of bounded size;
    each task keeps its own best. Questions without a vector find nothing, and ids are those of one question each.
    """
    return _asked(questions, k, cells.probed, lambda asked: index if len(asked) == len(cells.centres) else index.where(F.col("cell").isin(list(asked))))


def exact(questions: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """``search`` without cells: every question (query_id, vector) against all chunks (chunk_id, vector), by matrix products."""
    rows = chunks.where("vector IS NOT NULL").select(F.lit(0).alias("cell"), F.col("chunk_id").cast("long").alias("chunk_id"), "vector")
    return _asked(questions, k, lambda q: np.zeros((len(q), 1), np.int64), lambda asked: rows)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """How many of the exact nearest (query_id, chunk_id) of each question were found: query_id, of, found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("of"), F.count("hit").alias("found"))
