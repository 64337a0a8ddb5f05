"""Near-duplicate detection: SuperMinHash signatures, banding, exact verification, union-find groups.

SuperMinHash gives each element a random permutation of the signature's places and one uniform
value for each place, so values of one element are correlated (place k of its permutation holds
k + uniform) and estimates vary less than with independent hashes. A document stops as soon as
every place holds a value below the next rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from ..scratch import cut

BANDS, ROWS = 24, 5
#: A pair at similarity 0.85 shares no band with probability (1 - 0.85**5)**24 = 8e-7.
PLACES = BANDS * ROWS
LINK, OF = 85, 100
#: In buckets that stay open, longer signatures (a byte a place) decide which pairs are verified: those that
#: agree in this many places. At similarity 0.85 fewer do once in a million (4.75 standard deviations).
FINE, AGREE = 1024, 816
#: Members of a bucket that are compared at once.
BLOCK = 512
_RANK = np.uint64(48)


def superminhash(elements: np.ndarray, offs: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures (rows x places, rank in the high 16 bits) of element sets given as flat hashes."""
    rows = len(offs) - 1
    sig = np.full(rows * places, np.iinfo(np.uint64).max, np.uint64)
    doc = np.repeat(np.arange(rows), np.diff(offs))
    e, perm = elements, None
    for j in range(places):
        if not len(e):
            break
        draw = tk.mix(e + tk.salt(j + 1))
        k = j + ((draw & np.uint64(0xFFFF)) * np.uint64(places - j) >> np.uint64(16)).astype(np.int64)
        if perm is None:
            place = k
        else:
            i = np.arange(len(e))
            place = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
        np.minimum.at(sig, doc * places + place, (np.uint64(j) << _RANK) | (draw >> np.uint64(16)))
        open_ = (sig.reshape(rows, places) >> _RANK).max(axis=1) > j
        live = open_[doc]
        if perm is None:
            e, doc, k = e[live], doc[live], k[live]
            perm = np.broadcast_to(np.arange(places, dtype=np.uint16), (len(e), places)).copy()
            perm[np.arange(len(e)), k] = 0
        elif not live.all():
            e, doc, perm = e[live], doc[live], perm[live]
    return sig.reshape(rows, places)


def _sets(data, offs):
    for lo, hi, buf, at in tk.slices(data, offs):
        low = tk.LOWER[buf]
        start, end, row = tk.words(low, at)
        yield lo, hi, *tk.shingles(tk.word_hashes(low, start, end), row, hi - lo)


def _print(elements, offs):
    """A 64-bit fingerprint of each row's set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(elements ^ tk._GOLDEN), dtype=np.uint64)])
    n = np.diff(offs)
    return tk.mix(sums[offs[1:]] - sums[offs[:-1]] + n.astype(np.uint64) * tk._GOLDEN).view(np.int64), n


def _signed(batches):
    for batch in batches:
        data, offs = tk.column(batch, "text")
        for lo, hi, elements, at in _sets(data, offs):
            fp, n = _print(elements, at)
            sig = superminhash(elements, at)
            bands = np.zeros((hi - lo, BANDS), np.uint64)
            for r in range(ROWS):
                bands = (bands + sig[:, r::ROWS]) * tk.salt(2 * r + 1)
            bands = tk.mix(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            has = n > 0
            ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(fp), tk.lists(bands[has].ravel(), ends, pa.int64())],
                names=["doc_id", "text_id", "n_shingles", "fp", "bands"],
            )


def _full(batches):
    for batch in batches:
        data, offs = tk.column(batch, "text")
        for lo, hi, elements, at in _sets(data, offs):
            fp, _ = _print(elements, at)
            blobs = [elements[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(blobs, pa.binary())], names=["node", "elements"])


def _linked(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(OF * both >= LINK * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _fine(batches):
    """Long signatures of sets, a few thousand elements at a time."""
    for batch in batches:
        data, offs = tk.column(batch, "elements")
        for lo, hi, buf, at in tk.slices(data, offs, 1 << 16):
            sig = tk.mix(superminhash(np.frombuffer(buf.tobytes(), np.uint64), at // 8, FINE)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "sig"])


def _likely(batches):
    """Pairs of different groups within each key whose signatures agree nearly enough; rows arrive sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= 4096:
            table = pa.Table.from_batches(held)
            key = table["key"].to_numpy()
            split = int(np.searchsorted(key, key[-1]))
            if split:
                yield _compared(table.slice(0, split))
            held = table.slice(split).combine_chunks().to_batches()
    if held:
        yield _compared(pa.Table.from_batches(held))


def _compared(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    key, band, node, n, comp = (table[c].to_numpy() for c in ("key", "band", "node", "n", "component"))
    bands = np.array(table["bands"].to_pylist(), np.int64).reshape(-1, BANDS)
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, FINE)
    first_block = table["block"].to_numpy() == table["one"].to_numpy()
    u, v = [], []
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        left = np.flatnonzero(first_block[a:b]) + a
        right = np.flatnonzero(~first_block[a:b]) + a
        within = not len(right)
        for i, x in enumerate(left.tolist()):
            y = left[i + 1 :] if within else right
            y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) * OF >= np.maximum(n[y], n[x]) * LINK)]
            if len(y):
                y = y[(sig[y] == sig[x]).sum(axis=1) >= AGREE]
            if len(y):
                y = y[(bands[y] == bands[x]).argmax(axis=1) == band[x]]
                u.append(np.full(len(y), node[x]))
                v.append(node[y])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (u, v)], names=["u", "v"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id: long, text: string; other columns are ignored).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, elements distinct 5-word shingles of the
    whole text (fewer words: the whole sequence), links pairs with 100 * intersection >= 85 * union.
    Returns one row per input row: doc_id, n_shingles, component_id (smallest doc_id of the group),
    kept (doc_id = component_id), group (names the group whatever its ids; null without shingles) and
    text_id (a hash of the text). Null, empty and blank texts have no shingles and link with nothing; a
    null doc_id is never kept and has its group's smallest id, or null, but links as others do; repeated
    doc_ids give repeated rows; an empty table gives an empty result.

    Equal sets become one class first, so copies cost nothing later. In each band bucket every class
    is compared with the one that meets most others. Buckets that then still hold several groups compare
    all their pairs of different groups by signature, in blocks of bounded size spread over the tasks, and
    only pairs that agree nearly enough are verified; a pair counts in its first common band alone.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    base = cut(docs.mapInArrow(_signed, "doc_id long, text_id long, n_shingles long, fp long, bands array<long>"))
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    classes = base.where("n_shingles > 0").groupBy(F.col("fp").alias("node")).agg(F.min(one).alias("one"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = classes.select("node", F.col("one.doc_id").alias("first_id"), F.col("one.text_id").alias("first_text"), "n", "bands")
    members = classes.select("node", "n", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.count("*").alias("c")).where("c > 1")
    shared = members.join(buckets, ["band", "hash"])
    # how many others a class meets over its bands: the text that copies were made from meets the most
    fame = cut(shared.groupBy("node").agg(F.sum("c").alias("fame")))
    shared = cut(shared.join(fame, "node"))
    similar = lambda a, b: F.least(a, b) * OF >= F.greatest(a, b) * LINK

    wanted = classes.select("node", "first_id", "first_text").join(shared.select("node").distinct(), "node", "left_semi").select("first_id", "first_text").distinct()
    one_of = (docs.text_id == wanted.first_text) & docs.doc_id.eqNullSafe(wanted.first_id)
    sets = cut(docs.join(wanted, one_of, "left_semi").select("text").mapInArrow(_full, "node long, elements binary").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are links by their full sets."""
        a = sets.select(F.col("node").alias("u"), F.col("elements").alias("x"))
        b = sets.select(F.col("node").alias("v"), F.col("elements").alias("y"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(_linked, "u long, v long")

    famous = shared.groupBy("band", "hash").agg(F.max(F.struct("fame", "node", "n")).alias("top"))
    star = shared.join(famous, ["band", "hash"]).where((F.col("node") != F.col("top.node")) & similar(F.col("n"), F.col("top.n")))
    edges = cut(verified(star.select(F.col("node").alias("u"), F.col("top.node").alias("v")).distinct()))
    # buckets that still hold several groups: all their pairs, compared by signature in blocks
    groups = components(edges)
    open_ = shared.where("c > 2").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = open_.groupBy("band", "hash").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band", "hash")
    rows = open_.join(mixed, ["band", "hash"], "left_semi")
    fine = sets.join(rows.select("node").distinct(), "node", "left_semi").mapInArrow(_fine, "node long, sig binary")
    rows = rows.join(classes.select("node", "bands"), "node").join(fine, "node")
    blocks = F.ceil(F.col("c") / BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.withColumn("key", F.xxhash64("band", "hash", F.least("block", "other"), F.greatest("block", "other")))
    rows = rows.select("key", "band", "node", "n", "component", "bands", "sig", "block", F.least("block", "other").alias("one"))
    likely = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_likely, "u long, v long")
    edges = cut(edges.union(verified(likely.distinct())))
    groups = components(edges)
    groups = classes.select("node", "first_id").join(groups, "node")
    lows = groups.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = groups.join(lows, "component").select("node", "component_id", "component")
    alone = classes.select("node", F.col("first_id").alias("own_id"))
    return (
        base.select("doc_id", "text_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("node"))
        .join(alone, "node", "left")
        .join(of, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "own_id", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("group"), "text_id")
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "group", "text_id")
    )
