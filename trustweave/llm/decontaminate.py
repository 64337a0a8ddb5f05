"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased), so punctuation and line
breaks don't count as edits. A text holds an item of n words when some run of its words is within
floor(n / 5) edits of the item.

The CGK embedding is a walk over words: at step j a random bit of (j, word) says whether to go on to the
next one, so two walks that an edit has parted soon meet again and few edits become few differing steps.
Every place of a text starts a window; its walk is the same for all window sizes and is read off as far as
the size goes. An item is looked for by the window of its own size and, so that edits near its start don't
hide it, by those that begin at every ``SHIFT``-th of its words and end with it. Bit sampling: a table's key
is the words at ``SAMPLED`` steps among the first 2 * 2**c, where 2**c is the window's size rounded down to
a power of two. A window and an item that share a key of any of a size's ``WALKS * TABLES`` tables are
candidates, and the exact edit distance with free ends decides. Measured with the allowed fifth of the
words substituted, deleted or inserted, evenly spread or at random, over a Zipf vocabulary of 30,000 words
(200 items each): recall 0.995 to 1 at 16 to 25 words, 1 from 30 words on.

Items of up to ``SHORT`` words have too few steps to sample from and are looked for exactly: of d + 1 pieces
of an item, d edits leave one whole, so windows are placed where a piece occurs; nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Items up to this many words are placed by their pieces.
SHORT = 15
#: Walks, tables of a size in each walk, sampled steps of a table; distance and least size of an item's further windows.
WALKS, TABLES, SAMPLED = 3, 6, 3
SHIFT, LEAST = 2, 8
#: Largest power of two for which a window is sampled; longer windows are sampled in their first 2 * 2**TOP steps.
TOP = 6
#: Items in a block; each block is one pass over the texts with a table of bounded size.
BLOCK = 4_000
#: Places of a text that walk together.
TOGETHER = 1 << 14


def allowed(n):
    """Edits that still count as the item."""
    return n // 5


def _size(n):
    """c of the largest power of two that a window of n words holds."""
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), TOP)


def _plan() -> list[list[list[np.ndarray]]]:
    """Sampled steps by walk, size and table: one of each third of the walk, a sixth apart at least, so that they rarely read one word."""
    rng = np.random.default_rng(5)

    def draw(steps: int) -> np.ndarray:
        while True:
            at = np.array([int(rng.integers(k * steps // SAMPLED, max(k * steps // SAMPLED + 1, (k + 1) * steps // SAMPLED))) for k in range(SAMPLED)])
            if (np.diff(at) >= steps // (2 * SAMPLED)).all():
                return at

    return [[[draw(2 << c) for _ in range(TABLES)] for c in range(TOP + 1)] for _ in range(WALKS)]


_STEPS = _plan()


def _walked(flat: np.ndarray, start: np.ndarray, walk: int, sizes: list[int]):
    """(size, table, keys of the starts) for each size; ``flat`` has a zero after the words of each row, where walks stay."""
    wanted = {int(s) for c in sizes for steps in _STEPS[walk][c] for s in steps}
    place, seen, move = start.astype(np.int64), {}, np.empty(len(start), np.int64)
    for j in range(max(wanted) + 1):
        if j % 64 == 0:
            bits = tk.mix(flat + tk.salt(1000 * walk + j + 1))
            bits[flat == 0] = 0
            bits = bits.view(np.int64)
        if j in wanted:
            seen[j] = flat[place]
        np.take(bits, place, out=move, mode="clip")
        np.right_shift(move, j % 64, out=move)
        np.bitwise_and(move, 1, out=move)
        np.add(place, move, out=place)
    for c in sizes:
        for table, steps in enumerate(_STEPS[walk][c]):
            n = ((walk * (TOP + 1) + c) * TABLES + table) * SAMPLED
            key = seen[int(steps[0])] * tk.salt(2 * n + 1)
            for k, s in enumerate(steps[1:], 1):
                key += seen[int(s)] * tk.salt(2 * (n + k) + 1)
            yield c, table, key


def _spaced(words: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a zero after each row's, the place of every word in it, and the first place of each row."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n + 1) - (n + 1)
    flat = np.zeros(len(words) + rows, np.uint64)
    place = np.arange(len(words)) + row
    flat[place] = np.where(words == 0, np.uint64(1), words)
    return flat, place, first


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        out = (out + words[k : k + len(out)]) * tk.salt(2 * k + 1)
    return tk.mix(out + np.uint64(size))


def edits(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to a run of ``text``, and where the first such run ends."""
    j = np.arange(len(text) + 1)
    d = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item):
        t = np.empty_like(d)
        t[0] = i + 1
        t[1:] = np.minimum(d[1:] + 1, d[:-1] + (text != x))
        d = np.minimum.accumulate(t - j) + j
    return int(d.min()), int(d.argmin())


class Lookup:
    """Places by key: ``find`` gives the (query, value) pairs of equal keys."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key, kind="stable")
        self.key, self.value = key[order], value[order]
        self.bits = max(10, int(64 * len(key)).bit_length())
        self.mask: np.ndarray | None = None

    def _slot(self, key):
        return (key >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.mask is None:
            self.mask = np.zeros(1 << self.bits, bool)
            self.mask[self._slot(self.key)] = True
        at = np.flatnonzero(self.mask[self._slot(key)])
        a = np.searchsorted(self.key, key[at])
        n = np.searchsorted(self.key, key[at], side="right") - a
        return np.repeat(at, n), self.value[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def __getstate__(self):
        return self.__dict__ | {"mask": None}


class Items:
    """Words of a block of items and their keys; values are item * 2**32 + word of the item."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        data, offs = tk.column(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
        low = tk.LOWER[data]
        start, end, row = tk.words(low, offs, tk.ALNUM)
        self.ids = ids
        self.length = np.bincount(row, minlength=len(ids)).astype(np.int64)
        self.flat, place, self.first = _spaced(tk.word_hashes(low, start, end), row, len(ids))
        word = place - self.first[row]
        # words of each item, as a table of bits that never says no to one of them
        self.bits = max(16, int(16 * len(row)).bit_length())
        self.member = np.zeros(1 << self.bits, bool)
        self.member[self.slot(row, self.flat[place])] = True
        # long items: windows by size, table and walk
        left = self.length[row] - word
        window = (self.length[row] > SHORT) & ((word == 0) | ((word % SHIFT == 0) & (left >= LEAST)))
        place, value, size = place[window], (row[window] << 32) | word[window], _size(left[window])
        self.sizes = np.unique(size).tolist()
        self.tables: dict[tuple[int, int, int], Lookup] = {}
        for walk in range(WALKS if self.sizes else 0):
            for c, table, key in _walked(self.flat, place, walk, self.sizes):
                self.tables[walk, c, table] = Lookup(key[size == c], value[size == c])
        # short items: pieces by their number of words
        piece: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero((self.length > 0) & (self.length <= SHORT)).tolist():
            n = int(self.length[i])
            parts = allowed(n) + 1
            for p in range(parts):
                piece.setdefault(n // parts, []).append((i, p * (n // parts)))
        self.pieces: dict[int, Lookup] = {}
        for g, at in piece.items():
            item, word = np.array(at, np.int64).T
            self.pieces[g] = Lookup(_grams(self.flat, g)[self.first[item] + word], (item << 32) | word)

    def slot(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return ((word + item.astype(np.uint64) * tk.salt(5)) * tk._GOLDEN >> np.uint64(64 - self.bits)).view(np.int64)

    def words(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i] + self.length[i]]

    def candidates(self, flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``flat``, value): windows that share a table's key with one of an item, and pieces found."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for g, lookup in self.pieces.items():
            at, value = lookup.find(_grams(flat, g))
            out.append((at, value))
        for lo in range(0, len(place) if self.sizes else 0, TOGETHER):
            start = place[lo : lo + TOGETHER]
            base = int(start[0])
            near = flat[base : int(start[-1]) + (2 << TOP) + 1]
            near = np.append(near, np.uint64(0))
            for walk in range(WALKS):
                for c, table, key in _walked(near, start - base, walk, self.sizes):
                    at, value = self.tables[walk, c, table].find(key)
                    if len(at):
                        out.append((start[at], value))
        at, value = (np.concatenate(c) for c in zip(*out, strict=True))
        return at, value


def _plausible(items: Items, flat, first, stop, doc, item, head) -> np.ndarray:
    """Candidates near which so many words of the item stand that its edits can suffice; a lossless filter."""
    n, most = items.length[item], allowed(items.length[item])
    x0, x1 = np.maximum(first[doc], head - most), np.minimum(stop[doc], head + n + 3 * most + 1)
    out = np.zeros(len(doc), bool)
    for lo in range(0, len(doc), 2048):
        p = slice(lo, lo + 2048)
        at = x0[p, None] + np.arange(int((x1[p] - x0[p]).max()))
        hit = items.member[items.slot(item[p, None], flat[np.minimum(at, len(flat) - 1)])] & (at < x1[p, None])
        out[p] = hit.sum(axis=1) >= n[p] - most[p]
    return out


def _verified(items: Items, flat, first, stop, doc, item, head) -> dict[tuple[int, int], tuple[int, int]]:
    """Fewest edits and place of the run for each (doc, item) with a run near ``head`` that is the item."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    near = _plausible(items, flat, first, stop, doc, item, head) if len(doc) else np.zeros(0, bool)
    for d, i, h in zip(doc[near].tolist(), item[near].tolist(), head[near].tolist(), strict=True):
        n, words = int(items.length[i]), items.words(i)
        most = allowed(n)
        old = best.get((d, i), (most + 1, 0))
        if old[0] == 0:
            continue
        x0, x1 = max(int(first[d]), h - most), min(int(stop[d]), h + n + 3 * most + 1)
        text = flat[x0:x1]
        k, end = edits(words, text)
        if k <= most:
            _, back = edits(words[::-1], text[:end][::-1])
            best[d, i] = min(old, (k, x0 + end - back - int(first[d])))
    return best


def _found(shared):
    def find(batches):
        items: Items = shared.value
        for batch in batches:
            data, offs = tk.column(batch, "text")
            ids = batch.column(0)
            for lo, hi, buf, at in tk.slices(data, offs, 1 << 19):
                low = tk.LOWER[buf]
                start, end, row = tk.words(low, at, tk.ALNUM)
                if not len(start):
                    continue
                flat, place, first = _spaced(tk.word_hashes(low, start, end), row, hi - lo)
                stop = first + np.bincount(row, minlength=hi - lo)
                where, value = items.candidates(flat, place)
                item = value >> 32
                doc = np.searchsorted(first, where, side="right") - 1
                # one check for the diagonals that an item's edits can join
                most = allowed(items.length[item])
                head = where - (value & 0xFFFFFFFF)
                head -= head % (most + 1)
                _, one = np.unique(((doc * len(items.ids) + item) << 32) + head, return_index=True)
                doc, item, head = doc[one], item[one], head[one]
                best = _verified(items, flat, first, stop, doc, item, head)
                if best:
                    rows = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.take(pa.array([lo + d for d, _ in rows])),
                            pa.array([int(items.ids[i]) for _, i in rows], pa.int64()),
                            pa.array([int(items.length[i]) for _, i in rows], pa.int64()),
                            pa.array([best[x][0] for x in rows], pa.int64()),
                            pa.array([best[x][1] for x in rows], pa.int64()),
                        ],
                        names=["doc_id", "item_id", "n_words", "edits", "at_word"],
                    )

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs of a text and a benchmark item that it holds.

    ``docs``: doc_id long, text string; ``benchmark``: item_id long, text string; other columns are
    ignored. Returns doc_id, item_id, n_words of the item, edits (fewest found) and at_word (the word of the
    text where that run starts, the first of equals). Null and empty texts hold nothing; items without words,
    null items and null item_ids match nothing; items of up to four words match where they occur unchanged;
    repeated rows give repeated pairs; empty tables give an empty result. Items are taken in blocks of about
    ``BLOCK``, so what each task holds is bounded.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna()
    blocks = max(1, -(-items.count() // BLOCK))
    schema = "doc_id long, item_id long, n_words long, edits long, at_word long"
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        shared = spark.sparkContext.broadcast(Items(block["item_id"].to_numpy(), block["text"].combine_chunks()))
        part = docs.mapInArrow(_found(shared), schema)
        out = part if out is None else out.unionAll(part)
    return out
