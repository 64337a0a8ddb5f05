"""Removal of byte strings that repeat anywhere in the corpus, by prefix-free parsing.

The corpus is cut into phrases at triggers, places where the hash of the next ``TRIGGER`` bytes is
0 modulo ``EVERY``; a phrase runs from one trigger to the end of the next, so no phrase is a prefix
of another. Triggers depend on their own bytes alone, so both occurrences of a repeated string are
cut alike. The dictionary of distinct phrases says which phrases recur (a repeated string's inner
phrases all do); only suffixes whose first ``span`` bytes are made of such phrases go on.

A suffix is the rest of the phrase that it starts in (a suffix of the dictionary) and what follows
from the next trigger on (a suffix of the parse). Runs of neighbouring suffixes ahead of one trigger
travel as one row of bytes and are dealt out by what follows the trigger, so each task holds whole
intervals of the parse's order. There the two suffix arrays are made: of the parse, by the bytes from
the trigger on, and of the dictionary, by the bytes ahead of it read backwards (rests of one length
that end in the same trigger compare alike in either direction), both with the longest common prefixes
of neighbours. Corpus order follows from them without comparing text again: suffixes whose rests are
equal follow each other by their rank in the parse, and two neighbours share ``span`` bytes if the
common prefixes between their ranks cover what the rest leaves of the span. Only the first ``span``
bytes of suffixes are ordered; what comes after decides nothing. All this compares bytes. Fingerprints
decide alone (128 bits) only for suffixes without a trigger in reach and for keys of over ``HOT`` rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import textkit as tk

SPAN = 400
TRIGGER, EVERY = 16, 48
#: A trigger counts for the suffixes up to so many 25ths of the span ahead of it: near ones are dealt out
#: by the longer text that is sure to lie in their span, far ones by the shorter.
NEAR, FAR = 13, 21
#: Runs of a key beyond this number are taken apart into suffixes, which a distributed count compares.
HOT = 20_000
#: Bytes and places that a task gathers before it hands on its runs, each distinct run once.
POOL_BYTES, POOL_PLACES = 1 << 24, 400_000
_OTHER = np.random.default_rng(77).permutation(256).astype(np.uint8)


def _triggers(h: tk.Prefix, n: int, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and rows of the triggers."""
    if n < TRIGGER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.arange(n - TRIGGER + 1)
    at = s[h(s, s + TRIGGER) % np.uint64(EVERY) == 0]
    row = np.searchsorted(offs, at, side="right") - 1
    ok = at + TRIGGER <= offs[row + 1]
    return at[ok], row[ok]


def _phrases(h: tk.Prefix, at: np.ndarray, row: np.ndarray):
    """Hash of the phrase that starts at each trigger; the last trigger of a row starts none (False)."""
    has = np.zeros(len(at), bool)
    has[:-1] = row[1:] == row[:-1] if len(at) else []
    ph = np.zeros(len(at), np.uint64)
    i = np.flatnonzero(has)
    ph[i] = h(at[i], at[i + 1] + TRIGGER)
    return ph, has


def _inside(at: np.ndarray, start: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last trigger inside each window."""
    return np.searchsorted(at, start), np.searchsorted(at, start + span - TRIGGER, side="right") - 1


def _starts(offs: np.ndarray, rows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of the rows given, and their rows."""
    count = np.maximum(0, offs[rows + 1] - offs[rows] - span + 1)
    row = np.repeat(rows, count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offs[row], row


def _parsed(span):
    def parse(batches):
        """(slot, other, known): (text_id, phrase) of phrases that recur within the task, and (phrase, text_id) of one of each and of all others."""
        pool: list[np.ndarray] = []
        size = 0
        for batch in batches:
            data, offs = tk.column(batch, "text")
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, at in tk.slices(data, offs):
                h = tk.Prefix(buf)
                place, row = _triggers(h, len(buf), at)
                ph, has = _phrases(h, place, row)
                # windows without a whole phrase: mark their texts by a phrase of their own
                start, srow = _starts(at, np.arange(hi - lo), span)
                a, b = _inside(place, start, span)
                bare = np.unique(srow[b <= a])
                text = ids[lo:hi]
                pool.append(np.stack([ph[has].view(np.int64), text[row[has]], np.ones(has.sum(), np.int64)]))
                pool.append(np.stack([text[bare], text[bare], np.zeros(len(bare), np.int64)]))
                size += pool[-1].shape[1] + pool[-2].shape[1]
            if size > 1_500_000:
                yield _combined(pool)
                pool, size = [], 0
        if pool:
            yield _combined(pool)

    return parse


def _combined(pool) -> pa.RecordBatch:
    ph, text, n = np.concatenate(pool, axis=1)
    order = np.lexsort((text, ph))
    ph, text, n = ph[order], text[order], n[order]
    new = np.ones(len(ph), bool)
    new[1:] = (ph[1:] != ph[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    times = np.add.reduceat(n, first) if len(first) else n
    ph, text = ph[first], text[first]
    head = np.ones(len(ph), bool)
    head[1:] = ph[1:] != ph[:-1]
    group = np.cumsum(head) - 1
    size = np.bincount(group) if len(ph) else group
    known = (size[group] > 1) | (times != 1) if len(ph) else head
    # known ones go on under their text, one of each phrase also under the phrase
    again = np.flatnonzero(known & head)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([np.where(known, text, ph), ph[again]])), pa.array(np.concatenate([np.where(known, ph, text), text[again]])),
            pa.array(np.concatenate([known, np.zeros(len(again), bool)])),
        ],
        names=["slot", "other", "known"],
    )


_NAMES = ["key", "other", "body", "ahead", "docs", "starts"]
_ROWS = "key long, other long, body binary, ahead int, docs array<long>, starts array<int>"


class _Pool:
    """Distinct runs (bytes, and how many lie ahead of the trigger) of a task with all their places."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.at: dict[tuple[int, bytes], int] = {}
        self.keys: list[int] = []
        self.of: list[int] = []
        self.docs: list[int] = []
        self.starts: list[int] = []
        self.bytes = 0

    def add(self, key, body, ahead, doc, start):
        i = self.at.get((ahead, body))
        if i is None:
            i = self.at[ahead, body] = len(self.keys)
            self.keys.append(key)
            self.bytes += len(body)
        self.of.append(i)
        self.docs.append(doc)
        self.starts.append(start)

    def full(self) -> bool:
        return self.bytes > POOL_BYTES or len(self.of) > POOL_PLACES

    def rows(self) -> pa.RecordBatch:
        of = np.asarray(self.of, np.int64)
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.keys)))])
        ahead, body = zip(*self.at, strict=True)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(self.keys, pa.int64()),
                pa.array(np.zeros(len(body), np.int64)),
                pa.array(body, pa.binary()),
                pa.array(ahead, pa.int32()),
                tk.lists(np.asarray(self.docs, np.int64)[order], ends, pa.int64()),
                tk.lists(np.asarray(self.starts, np.int32)[order], ends, pa.int32()),
            ],
            names=_NAMES,
        )
        self.clear()
        return out


def _gathered(key, other, doc, start) -> pa.RecordBatch:
    """Single suffixes by their fingerprint: one row for each distinct one, with all its places."""
    order = np.lexsort((other, key))
    key, other, doc, start = key[order], other[order], doc[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(new)
    ends = np.append(first, len(key))
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key[first].view(np.int64)), pa.array(other[first].view(np.int64)), pa.nulls(n, pa.binary()), pa.array(np.zeros(n, np.int32)),
            tk.lists(doc, ends, pa.int64()), tk.lists(start.astype(np.int32), ends, pa.int32()),
        ],
        names=_NAMES,
    )


def _suffixed(span):
    near, far = span * NEAR // 25, span * FAR // 25

    def suffixes(batches):
        """Rows of suffixes to compare: runs ahead of a trigger with their bytes, or single ones by fingerprint."""
        pool = _Pool()
        alone: list[tuple] = []
        for batch in batches:
            data, offs = tk.column(batch, "text")
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = batch.column(2)
            for lo, hi, buf, at in tk.slices(data, offs, 1 << 19):
                h = tk.Prefix(buf)
                place, row = _triggers(h, len(buf), at)
                ph, has = _phrases(h, place, row)
                recurs = np.zeros(len(place), bool)
                for i in range(lo, hi):
                    a, b = np.searchsorted(row, [i - lo, i - lo + 1])
                    recurs[a:b] = np.isin(ph[a:b].view(np.int64), np.asarray(known[i].values))
                bad = np.concatenate([[0], np.cumsum(has & ~recurs)])
                start, srow = _starts(at, np.arange(hi - lo), span)
                a, b = _inside(place, start, span)
                ok = (b <= a) | (bad[np.maximum(b, 0)] == bad[a])
                ahead = np.full(len(start), span)
                i = np.flatnonzero(a <= b)
                ahead[i] = place[a[i]] - start[i]
                tier = (ahead >= near).astype(np.int8) + (ahead >= far)
                one = np.flatnonzero(ok & (tier == 2))
                if len(one):
                    s = start[one]
                    alone.append((h(s, s + span), tk.Prefix(_OTHER[buf])(s, s + span), ids[lo + srow[one]], s - at[srow[one]]))
                    if sum(len(x[0]) for x in alone) > POOL_PLACES:
                        yield _gathered(*(np.concatenate(c) for c in zip(*alone, strict=True)))
                        alone = []
                run = np.flatnonzero(ok & (tier < 2))
                if not len(run):
                    continue
                head = np.ones(len(run), bool)  # neighbouring starts ahead of one trigger
                head[1:] = (a[run[1:]] != a[run[:-1]]) | (run[1:] != run[:-1] + 1) | (tier[run[1:]] != tier[run[:-1]])
                first = np.flatnonzero(head)
                last = np.concatenate([first[1:], [len(run)]]) - 1
                s, e, t, r = start[run[first]], start[run[last]], place[a[run[first]]], srow[run[first]]
                far_ = tier[run[first]]
                key = tk.mix(h(t, t + span - np.where(far_ == 1, far, near)) + far_.astype(np.uint64)).view(np.int64)
                raw = buf.tobytes()
                for k, x, y, z, doc, begin in zip(key.tolist(), s.tolist(), e.tolist(), t.tolist(), ids[lo + r].tolist(), (s - at[r]).tolist(), strict=True):
                    pool.add(k, raw[x : y + span], z - x, doc, begin)
                if pool.full():
                    yield pool.rows()
        if pool.of:
            yield pool.rows()
        if alone:
            yield _gathered(*(np.concatenate(c) for c in zip(*alone, strict=True)))

    return suffixes


def _suffix_array(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each byte string and the common prefix of every rank with the one before it (padded by zeros)."""
    m = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)
    order = np.argsort(m.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 8192):
        j = min(len(rows), i + 8192)
        differs = m[order[i:j]] != m[order[i - 1 : j - 1]]
        lcp[i:j] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    return rank, lcp


def _repeated(body: list[bytes], ahead: np.ndarray, count: np.ndarray, span: int) -> np.ndarray:
    """Which suffixes (row x place in its run) share their first ``span`` bytes with one of another row."""
    n, width = len(body), int(ahead.max()) + 1
    rest, rest_lcp = _suffix_array([x[:k][::-1] for x, k in zip(body, ahead.tolist(), strict=True)], width)
    parse, parse_lcp = _suffix_array([x[k : k + span] for x, k in zip(body, ahead.tolist(), strict=True)], span)
    out = np.zeros((n, int(count.max())), bool)
    # rows by the places that their suffixes lie ahead of the trigger
    for x in range(width):
        row = np.flatnonzero((ahead >= x) & (ahead - count < x))
        if len(row) < 2:
            continue
        same_rest, same_text = np.cumsum(rest_lcp < x)[rest[row]], np.cumsum(parse_lcp < span - x)[parse[row]]
        order = np.argsort(same_rest * n + parse[row])  # corpus order of these suffixes
        r, s, row = same_rest[order], same_text[order], row[order]
        twin = (r[1:] == r[:-1]) & (s[1:] == s[:-1])
        hit = np.zeros(len(row), bool)
        hit[1:] = twin
        hit[:-1] |= twin
        out[row[hit], ahead[row[hit]] - x] = True
    return out


def _ordered(span):
    """Places of repeated suffixes of each key; rows arrive sorted by key."""

    def flush(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        key = table["key"].to_numpy()
        docs, starts = (table[c].combine_chunks() for c in ("docs", "starts"))
        ends = np.asarray(docs.offsets, dtype=np.int64)
        docs, starts, ends = np.asarray(docs.values), np.asarray(starts.values), ends
        places = np.diff(ends)
        group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        crowd = np.bincount(group)[group] > 1
        rows = np.flatnonzero(crowd | (places > 1))
        if not len(rows):
            return None
        ahead = table["ahead"].to_numpy()[rows]
        body = table["body"].take(pa.array(rows)).to_pylist()
        count = np.fromiter(map(len, body), np.int64, len(body)) - span + 1
        many = places[rows] > 1
        hit = np.zeros((len(rows), int(count.max())), bool)
        busy = np.flatnonzero(crowd[rows])
        if len(busy):
            found = _repeated([body[i] for i in busy.tolist()], ahead[busy], count[busy], span)
            hit[busy, : found.shape[1]] = found
        hit[many] = np.arange(hit.shape[1]) < count[many, None]
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        r, first = np.nonzero(edge == 1)
        _, stop = np.nonzero(edge == -1)
        n = places[rows[r]]
        at = np.repeat(ends[rows[r]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs[at], pa.int64()),
                pa.array((starts[at] + np.repeat(first, n)).astype(np.int32)),
                pa.array((starts[at] + np.repeat(stop - 1 + span, n)).astype(np.int32)),
            ],
            names=["doc_id", "from", "to"],
        )

    def order(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < HOT:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["key"].to_numpy()
            split = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if split:
                out = flush(table.slice(0, split).to_batches())
                if out is not None:
                    yield out
            held = table.slice(split).to_batches()
        if held:
            out = flush(held)
            if out is not None:
                yield out

    return order


def _windows(span):
    """The suffixes of runs as single ones."""

    def windows(batches):
        alone: list[tuple] = []
        for batch in batches:
            bodies, docs, starts = (batch.column(i) for i in (2, 4, 5))
            for body, doc, start in zip(bodies, docs, starts, strict=True):
                buf = np.frombuffer(body.as_buffer(), np.uint8)
                s = np.arange(len(buf) - span + 1)
                key, other = tk.Prefix(buf)(s, s + span), tk.Prefix(_OTHER[buf])(s, s + span)
                doc, start = np.asarray(doc.values), np.asarray(start.values)
                alone.append((np.repeat(key, len(doc)), np.repeat(other, len(doc)), np.tile(doc, len(s)), np.repeat(s, len(doc)) + np.tile(start, len(s))))
                if sum(len(x[0]) for x in alone[-64:]) > POOL_PLACES or len(alone) >= 4096:
                    yield _gathered(*(np.concatenate(c) for c in zip(*alone, strict=True)))
                    alone = []
        if alone:
            yield _gathered(*(np.concatenate(c) for c in zip(*alone, strict=True)))

    return windows


def _removed(batches):
    for batch in batches:
        ids, texts, froms, tos = (batch.column(i) for i in range(4))
        out = []
        for text, a, b in zip(texts, froms, tos, strict=True):
            raw = text.as_py().encode()
            gone = np.zeros(len(raw) + 1, np.int32)
            np.add.at(gone, np.asarray(a.values), 1)
            np.add.at(gone, np.asarray(b.values), -1)
            gone = np.cumsum(gone[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
        n, s, d = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.string())], names=["text_id", "gone", "spans", "digest"])


#: Up to so many hot keys (8 bytes each) are sent to every task; more are joined.
SENT = 100_000


def repeated_spans(docs: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, sha, text_id, n_bytes), distinct texts, the texts that may hold repeats, and their
    repeated windows (doc_id: the text_id, from, to: runs of windows)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = cut(docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text").alias("text_id"), F.octet_length("text").cast("long").alias("n_bytes")))
    texts = rows.groupBy("sha", "text_id", "n_bytes").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"))
    long = docs.where(F.octet_length("text") >= span).select("doc_id", "text", F.xxhash64("text").alias("text_id"))
    parse = long.select("text", "text_id").mapInArrow(_parsed(span), "slot long, other long, known boolean")
    # a phrase under its text is a group of its own, so no group holds more rows of a phrase than there are tasks' pools
    by = "OVER (PARTITION BY known, slot)"
    recurring = parse.withColumn("wide", F.expr(f"min(other) {by} <> max(other) {by}"))
    recurring = recurring.where(F.col("known") | F.col("wide") | (F.col("slot") == F.col("other")))
    pair = lambda a, b: F.when(F.col("known"), F.col(a)).otherwise(F.col(b))
    known = recurring.groupBy(pair("slot", "other").alias("text_id")).agg(F.collect_set(pair("other", "slot")).alias("known"))
    known = known.join(texts.where(F.col("n_bytes") >= span), "text_id").select(F.col("text_id").alias("tid"), "rep_id", "known")
    sources = long.join(known, (F.col("text_id") == F.col("tid")) & F.col("doc_id").eqNullSafe(F.col("rep_id")))
    sources = cut(sources.select(F.col("text_id").alias("doc_id"), "text", "known"))
    suffixes = cut(sources.mapInArrow(_suffixed(span), _ROWS))
    runs, single = suffixes.where("body IS NOT NULL"), suffixes.where("body IS NULL").select("key", "other", "docs", "starts")
    hot = cut(runs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key"))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= SENT else hot
        single = single.union(runs.join(hot, "key", "left_semi").select(*_NAMES).mapInArrow(_windows(span), _ROWS).select("key", "other", "docs", "starts"))
        runs = runs.join(hot, "key", "left_anti").select(*_NAMES)
    ordered = runs.repartition("key").sortWithinPartitions("key").mapInArrow(_ordered(span), "doc_id long, from int, to int")
    # equal suffixes of a task's pool are one row, so a group has no more rows than there are pools
    twice = single.withColumn("n", F.expr("sum(size(docs)) OVER (PARTITION BY key, other)")).where("n > 1")
    place = twice.select(F.explode(F.arrays_zip("docs", "starts")).alias("p"))
    place = place.select(F.col("p.docs").alias("doc_id"), F.col("p.starts").alias("from"), (F.col("p.starts") + span).cast("int").alias("to"))
    return rows, texts, sources, ordered.union(place)


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Remove every byte covered by a ``span``-byte string that also starts anywhere else.

    ``docs``: doc_id long, text string (null: empty); other columns are ignored. Matches never cross
    documents, overlaps count, and strings are judged on the input. Returns one row per input row:
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the remaining bytes.
    Texts under ``span`` bytes lose nothing; a text with a copy loses all its bytes; null and empty
    texts give zeros and the digest of nothing; repeated and null doc_ids are rows like others (rows
    are told apart by their texts); an empty table gives an empty result.
    """
    rows, texts, sources, spans = repeated_spans(docs, span)
    spans = spans.groupBy("doc_id").agg(F.collect_list("from").alias("a"), F.collect_list("to").alias("b"))
    cleaned = sources.select("doc_id", "text").join(spans, "doc_id").select("doc_id", "text", "a", "b").mapInArrow(_removed, "text_id long, gone long, spans long, digest string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    verdict = texts.join(cleaned.dropDuplicates(["text_id"]), "text_id", "left").select(
        "sha",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("digest", "sha")).alias("kept_sha256"),
    )
    return rows.join(verdict, "sha").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
