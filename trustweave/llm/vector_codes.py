"""Vector code compression: product codes over integer vectors, screened in float32 and settled in int64."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from .skew import attach

#: Parts of a vector, entries of a part's codebook, rounds of assigning and averaging.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x becomes floor(SCALE * x), held within LIMIT either way, so that squares, sums and distances are exact in 64 bits.
SCALE, LIMIT = 1024, 1 << 26
#: Rows that are compared with a codebook at a time, and pairs whose distance is taken at a time.
ROWS, PAIRS = 2048, 1 << 15

_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def kept_rows(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list column hold a vector of finite numbers, the length of each of these, and their components in a row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
    values = np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))  # nulls as NaN
    row = np.repeat(np.arange(len(n)), n)
    keep = np.asarray(col.is_valid()) & (np.bincount(row[~np.isfinite(values)], minlength=len(n)) == 0)
    return keep, n[keep], values[keep[row]]


def integers(n: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Integer vectors of ``width`` places; shorter ones end in zeros."""
    whole = np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64)
    if (n == width).all():
        return whole.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(whole)) - np.repeat(np.cumsum(n) - n, n)] = whole
    return out


class Codebook:
    """The entries of one part, ready for the search of the nearest."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        # of equal entries only the first can win
        self.at = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        self.own = entries[self.at]
        self.low = np.ascontiguousarray(self.own.T.astype(np.float32))
        self.square = (self.own * self.own).sum(axis=1).astype(np.float64)
        self.norm = np.sqrt(self.square)
        # a float32 sum of m products of rounded numbers is off by less than (m + 2) u / (1 - (m + 2) u) of the sum of their sizes, in any order
        m = (entries.shape[1] + 2) * 2.0**-24
        self.slack = m / (1 - m)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower one of a tie, and its squared distance, both exact.

        The squared distance less that of the row to 0 is known from a float32 product up to a bound on its rounding; entries whose interval meets
        the interval with the lowest end are measured in int64.
        """
        best, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for lo in range(0, len(x), ROWS):
            part = x[lo : lo + ROWS]
            size = np.sqrt((part * part).sum(axis=1).astype(np.float64))[:, None] * self.norm
            middle = self.square - 2 * (part.astype(np.float32) @ self.low).astype(np.float64)
            off = 2.0002 * self.slack * size + 2.0**-50 * (self.square + 2 * size)  # the second term covers the float64 steps
            row, j = np.nonzero(middle - off <= (middle + off).min(axis=1)[:, None])
            exact = np.empty(len(row), np.int64)
            for k in range(0, len(row), PAIRS):
                gap = part[row[k : k + PAIRS]] - self.own[j[k : k + PAIRS]]
                exact[k : k + PAIRS] = (gap * gap).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(part)))
            low = np.minimum.reduceat(exact, first)
            hit = np.flatnonzero(exact == low[row])
            hit = hit[np.searchsorted(row[hit], np.arange(len(part)))]
            best[lo : lo + ROWS], error[lo : lo + ROWS] = self.at[j[hit]], low
        return best, error


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows that are kept and their integer vectors, the vector in the last column; a few thousand at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            rows = batch.slice(lo, ROWS)
            keep, n, values = kept_rows(rows.column(rows.num_columns - 1))
            if keep.any():
                yield rows.filter(pa.array(keep)), integers(n, values, width)


def _smallest(batches):
    """A task's smallest ids of kept rows, and one row without id that has the greatest length."""
    ids, most = np.zeros(0, np.int64), -1
    for batch in batches:
        keep, n, _ = kept_rows(batch.column(1))
        found = batch.column(0).filter(pa.array(keep)).drop_null()
        ids = np.sort(np.concatenate([ids, found.to_numpy()]))[:ENTRIES]
        most = max(most, int(n.max(initial=-1)))
    yield pa.RecordBatch.from_arrays([pa.array([*ids.tolist(), None], pa.int64()), pa.array([most] * (len(ids) + 1), pa.int32())], names=["vec_id", "width"])


def _only_kept(batches):
    for batch in batches:
        yield batch.filter(pa.array(kept_rows(batch.column(1))[0]))


def _sums(shared, width: int):
    """Per task: sums of the parts of each entry by place, and how many there are; places of counts are below zero."""

    def run(batches):
        books = [Codebook(b) for b in shared.value]
        k, w = len(books[0].entries), width // PARTS
        total, count = np.zeros((PARTS, k * w), np.int64), np.zeros((PARTS, k), np.int64)
        for _, x in _matrices(batches, width):
            for p, book in enumerate(books):
                part = x[:, p * w : (p + 1) * w]
                best, _ = book.nearest(part)
                count[p] += np.bincount(best, minlength=k)
                # exact: a few thousand numbers of 27 bits
                total[p] += np.bincount((best[:, None] * w + np.arange(w)).ravel(), part.ravel(), k * w).astype(np.int64)
        used = np.flatnonzero(count.ravel())
        spots = (used[:, None] * w + np.arange(w)).ravel()
        slots = np.concatenate([spots, -1 - used])
        sums = np.concatenate([total.ravel()[spots], count.ravel()[used]])
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(sums)], names=["slot", "total"])

    return run


def fit_codebooks(vectors: DataFrame) -> np.ndarray:
    """Codebooks over all kept vectors (vec_id, embedding): int64 entries by part, entry and place.

    They begin as the parts of the vectors of the ``ENTRIES`` smallest ids (nulls last, repeated ids by their vectors) and are averaged ``ROUNDS`` times;
    only sums a task and the entries (256 vectors) reach the driver. Without a kept vector there are no entries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    ids = cut(rows.mapInArrow(_smallest, "vec_id long, width int"))
    longest = ids.agg(F.max("width")).first()[0]
    if longest is None or longest < 0:
        return np.zeros((PARTS, 0, 0), np.int64)
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    low = [r.vec_id for r in ids.where("vec_id IS NOT NULL").orderBy("vec_id").limit(ENTRIES).collect()]
    first = rows.where(F.col("vec_id") <= low[-1]) if len(low) == ENTRIES else rows
    first = first.mapInArrow(_only_kept, rows.schema).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).toArrow()
    _, n, values = kept_rows(first.column(1))
    start = integers(n, values, width)
    books = np.ascontiguousarray(start.reshape(len(start), PARTS, -1).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("embedding").mapInArrow(_sums(shared, width), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        slot, total = sums.column(0).to_numpy(), sums.column(1).to_numpy()
        count = np.zeros(books.shape[0] * books.shape[1], np.int64)
        count[-1 - slot[slot < 0]] = total[slot < 0]
        spots = slot[slot >= 0]
        books = books.copy()
        books.ravel()[spots] = total[slot >= 0] // count[spots // books.shape[2]]
        shared.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes of the kept vectors (vec_id, label, embedding): vec_id, label, code, error; other columns are ignored."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    width = books.shape[0] * books.shape[2]

    def run(batches):
        own = [Codebook(b) for b in shared.value]
        w = width // PARTS
        for rows, x in _matrices(batches, width):
            found = [book.nearest(x[:, p * w : (p + 1) * w]) for p, book in enumerate(own)]
            text = np.stack([_HEX[best] for best, _ in found], axis=1)
            offs = np.arange(len(x) + 1, dtype=np.int32) * (2 * PARTS)
            code = pa.StringArray.from_buffers(len(x), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(text)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), code, pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(run, schema)


def decode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """``coded`` with ``vector``: the integers of the entries that its code names, divided by ``SCALE``."""
    table = F.split(F.lit(",".join(map(str, (books.ravel() / SCALE).tolist()))), ",").cast("array<double>")
    k, w = books.shape[1:]
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn("vector", F.concat(*[F.slice(table, entry(p) * w + (p * k * w + 1), w) for p in range(PARTS)]))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """Codes and errors of the vectors of a table (vec_id, label, embedding): vec_id, label, code, error, label_error and codebooks_sha256.

    Rows are dropped whose vector is null or holds null or non-finite components. Vectors that are shorter than the longest (empty ones too), or whose length the
    parts don't divide, count as ending in zeros; components beyond 65,536 either way count as that. With fewer than 256 vectors codebooks have as many
    entries. Repeated rows are coded and counted each, null ids are kept and come last, a null label is a label. label_error is null where a sum
    passes 64 bits. Other columns are ignored; an empty table gives an empty result.
    """
    books = fit_codebooks(vectors)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    if not books.size:
        kind = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label")
        coded = kind.limit(0).withColumn("code", F.lit("")).withColumn("error", F.lit(0).cast("long"))
    else:
        coded = cut(encode(vectors, books))
    coded = coded.withColumn("key", key)
    sums = cut(coded.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")))
    out = attach(coded, sums, "key", "n")
    return out.select("vec_id", "label", "code", "error", F.expr("try_cast(total AS bigint)").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
