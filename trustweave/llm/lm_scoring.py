"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Spark counts the words of all training texts. The frequent ones (``OWN`` at most, ``LEAST`` times at least) have vectors of their
own, and their number grows with the corpus up to that bound; a rarer word backs off to one of ``TAILS`` classes by its ending,
inside which words keep their smoothed relative counts. The counts of all words, however many, stay in a table that is joined.

The context of a token is the ``ORDER`` tokens before it, across which the position weights P spread their vectors:
c = sum_i P_i * R[w_i]. The next token is predicted in two steps, each a softmax of bilinear scores c . v + b: over classes
(clusters of own words that follow the same frequent words, and the tails), then over the words of the class. Both are trained by
noise-contrastive estimation with drawn noise: classes from their frequency, words from theirs inside the class.

Training runs where the texts are: every task goes once through the tokens of its texts in batches, with steps that shrink with
the use of a vector (Adagrad), and sends how far each vector moved; moves are averaged by use over all tasks with a shuffle. This
happens in ``ROUNDS`` rounds over disjoint parts of the texts, so each training token counts once. For scoring, batched matrix
products give the normalised log-probability of every token.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from . import textkit as tk

OWN, LEAST, TAILS = 16_384, 10, 32
#: So many of the most frequent words travel with their counts to every task; the rest are joined.
LISTED = 1 << 20
WIDTH, ORDER = 16, 2
#: Share of the texts in each round, in 1/8; noise draws of classes (shared by a batch) and of words.
ROUNDS = (1, 2, 5)
BATCH, NOISE, DRAWS, WORD_NOISE = 4096, 16.0, 48, 1
#: Adagrad's steps, of position weights also, and what its squares start from.
RATE, POSITION_RATE, CALM = 0.2, 0.01, 0.01
#: Clusters are formed by the frequent words that come before; a class holds so many words at most.
FEATURES, MEMBERS = 64, 256
_END = np.uint64(0x1B873593CC9E2D51)


def _read(buf, at):
    """Hash and row of every token, the end of each row included, in order; and a function that gives the tails of some of them."""
    low = tk.LOWER[buf]
    start, end, row = tk.words(low, at)
    rows = len(at) - 1
    h = tk.Prefix(low) if len(start) else None
    word = h(start, end) if len(start) else np.zeros(0, np.uint64)
    stop = np.cumsum(np.bincount(row, minlength=rows))  # an end after each row's words
    start, end = np.insert(start, stop, -1), np.insert(end, stop, -1)

    def tails(some: np.ndarray) -> np.ndarray:
        a, b = start[some], end[some]
        out = np.zeros(len(a), np.int64)
        real = np.flatnonzero(a >= 0)
        if len(real):
            out[real] = (h(np.maximum(a[real], b[real] - 4), b[real]) % np.uint64(TAILS)).astype(np.int64)
        return out

    return np.insert(word, stop, _END), tails, np.insert(row, stop, np.arange(rows))


def _tokens(buf, at):
    """Hash, tail and row of every token."""
    word, tails, row = _read(buf, at)
    return word, tails(np.arange(len(word))), row


def _counted(batches):
    held: list[np.ndarray] = []
    size = 0

    def flush():
        word, tail, n = (np.concatenate(c) for c in zip(*held, strict=True))
        word, first, inverse = np.unique(word, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(tail[first], pa.int32()), pa.array(np.bincount(inverse, weights=n).astype(np.int64))], names=["word", "tail", "n"]
        )

    for batch in batches:
        data, offs = tk.column(batch, "text")
        for _, _, buf, at in tk.slices(data, offs):
            word, tails, _ = _read(buf, at)
            word, first, n = np.unique(word, return_index=True, return_counts=True)
            held.append((word, tails(first), n))
            size += len(word)
            if size > 2_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _encoded(shared):
    """Token ids of each text (own words, then tails), what the listed counts give of its base score, and its unlisted words."""

    def encode(batches):
        own, listed, listed_n, total, vocab = shared.value
        shift = np.log10(total + 0.1 * (vocab + 1))
        known = np.log10(listed_n + 0.1)
        # where own words are listed, so that only other tokens are looked for among the listed ones
        spot = np.minimum(np.searchsorted(listed, own[0]), max(0, len(listed) - 1))
        own_listed = listed[spot] == own[0] if len(listed) else np.zeros(len(own[0]), bool)
        own_known = np.where(own_listed, known[spot], 0) if len(listed) else np.zeros(len(own[0]))
        task = TaskContext.get()
        rid = (task.partitionId() if task else 0) << 36
        for batch in batches:
            data, offs = tk.column(batch, "text")
            for lo, hi, buf, at in tk.slices(data, offs):
                rows = hi - lo
                word, tails, row = _read(buf, at)
                i = np.minimum(np.searchsorted(own[0], word), len(own[0]) - 1)
                ids, hit, c = own[1][i], own_listed[i], own_known[i]
                other = np.flatnonzero(own[0][i] != word)
                ids[other] = len(own[0]) + tails(other)
                hit[other], c[other] = False, 0
                if len(listed):
                    i = np.minimum(np.searchsorted(listed, word[other]), len(listed) - 1)
                    hit[other] = listed[i] == word[other]
                    c[other] = np.where(hit[other], known[i], 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
                miss = np.flatnonzero(~hit)
                order = miss[np.lexsort((word[miss], row[miss]))]
                w, d = word[order], row[order]
                new = np.ones(len(w), bool)
                new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(w)))
                rare = np.concatenate([[0], np.cumsum(np.bincount(d[first], minlength=rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(rid, rid + rows)),
                        batch.column(0).slice(lo, rows),
                        batch.column(1).slice(lo, rows),
                        tk.lists(ids.astype(np.int32), ends, pa.int32()),
                        pa.array(np.bincount(row, weights=hit, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(row, weights=c - shift, minlength=rows)),
                        pa.array(np.bincount(row, weights=np.where(ids >= len(own[0]), c, 0), minlength=rows)),
                        tk.lists(w[first].view(np.int64), rare, pa.int64()),
                        tk.lists(times.astype(np.int32), rare, pa.int32()),
                    ],
                    names=["rid", "doc_id", "held_out", "ids", "hits", "base", "share", "rare", "times"],
                )
                rid += rows

    return encode


def contexts(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """The ``ORDER`` tokens before each one (nearest first); a text starts after ends."""
    place = np.arange(len(ids)) - np.repeat(ends[:-1], np.diff(ends))
    out = np.full((ORDER, len(ids)), end_id, np.int64)
    for i in range(ORDER):
        inside = np.flatnonzero(place > i)
        out[i, inside] = ids[inside - i - 1]
    return out


class Model:
    """Vectors with biases as one matrix: contexts (own words and tails), classes, own words, position weights."""

    def __init__(self, words: int, end_id: int, cluster: np.ndarray, counts: np.ndarray, seed: int = 11):
        """``cluster``: class of each own word; ``counts``: uses of own words, then of tails."""
        self.words, self.end_id = words, end_id
        clusters = int(cluster.max()) + 1
        self.outcome = np.concatenate([cluster, clusters + np.arange(TAILS)])
        self.classes = clusters + TAILS
        n = counts + 0.5
        self.class_share = np.bincount(self.outcome, weights=n, minlength=self.classes)
        self.share = n / self.class_share[self.outcome]  # of a word inside its class
        self.class_share = self.class_share / self.class_share.sum()
        self.order = np.argsort(cluster, kind="stable")
        self.first = np.searchsorted(cluster[self.order], np.arange(clusters + 1))
        self.size = np.diff(self.first)
        self.rank = np.empty(words, np.int64)  # of a word inside its class
        self.rank[self.order] = np.arange(words) - self.first[cluster[self.order]]
        self.at = np.cumsum([0, words + TAILS, self.classes, words])
        rng = np.random.default_rng(seed)
        self.theta = rng.normal(0, 0.1, (self.at[-1] + ORDER, WIDTH + 1)).astype(np.float32)
        self.theta[self.at[1] : self.at[2], -1] = np.log(self.class_share)
        self.theta[self.at[2] : self.at[3], -1] = np.log(self.share[:words])
        self.theta[self.at[3] :] = 1 / (1 + np.arange(ORDER))[:, None]
        self.squares = np.full(len(self.theta), CALM, np.float32)  # of gradients so far, by vector

    def context(self, before: np.ndarray) -> np.ndarray:
        p = self.theta[self.at[3] :, :-1]
        return sum(self.theta[before[i], :-1] * p[i] for i in range(ORDER))

    def log_probs(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token's class, and of own words inside their class."""
        c = self.context(before)
        e, q = self.theta[self.at[1] : self.at[2]], self.theta[self.at[2] : self.at[3]]
        out = np.empty(len(ids))
        target = self.outcome[ids]
        for lo in range(0, len(ids), 2048):
            p = slice(lo, lo + 2048)
            out[p] = _log_softmax(c[p], e, target[p])
        own = np.flatnonzero(ids < self.words)
        own = own[np.argsort(target[own].astype(np.uint16) if self.classes <= 1 << 16 else target[own], kind="stable")]
        edge = np.searchsorted(target[own], np.arange(len(self.first)))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            members = self.order[self.first[k] : self.first[k + 1]]
            if len(members) > 1:
                v = q[members]
                for lo in range(edge[k], edge[k + 1], 2048):
                    t = own[lo : min(lo + 2048, edge[k + 1])]
                    out[t] += _log_softmax(c[t], v, self.rank[ids[t]])
        return out

    def fit(self, ids: np.ndarray, before: np.ndarray, rng: np.random.Generator, moved: Moves) -> None:
        """One pass of noise-contrastive estimation over tokens and their contexts, in batches."""
        theta, at, d = self.theta, self.at, WIDTH
        e, q, p = theta[at[1] : at[2]], theta[at[2] : at[3]], theta[at[3] :]
        ahead = np.concatenate([[0.0], np.cumsum(self.share[self.order])])  # shares of words, class after class
        log_noise = np.log(NOISE * self.class_share).astype(np.float32)
        log_word = np.log(WORD_NOISE * self.share).astype(np.float32)
        one = np.ones((len(ids), 1), np.float32)
        for lo in range(0, len(ids), BATCH):
            w, b = ids[lo : lo + BATCH], before[:, lo : lo + BATCH]
            n = len(w)
            h = theta[b][:, :, :d]
            c = (h * p[:, None, :d]).sum(axis=0)
            c1 = np.hstack([c, one[:n]])
            # classes: the true one against draws that the batch shares
            k = self.outcome[w]
            z = rng.choice(self.classes, DRAWS, p=self.class_share)
            g = 1 - _sigmoid((c1 * e[k]).sum(axis=1) - log_noise[k])
            gz = -_sigmoid(c1 @ e[z].T - log_noise[z]) * np.float32(NOISE / DRAWS)
            dc = g[:, None] * e[k, :d] + gz @ e[z, :d]
            moved.step(self, at[1] + np.concatenate([k, z]), np.vstack([g[:, None] * c1, gz.T @ c1]))
            # words inside their class: the true one against draws of its class
            own = np.flatnonzero((w < self.words) & (self.size[np.minimum(k, len(self.size) - 1)] > 1))
            if len(own):
                u = self.first[k[own]][:, None]
                v = ahead[u] + rng.random((len(own), WORD_NOISE)) * (ahead[self.first[k[own] + 1]][:, None] - ahead[u])
                drawn = self.order[np.clip(np.searchsorted(ahead, v, side="right") - 1, u, self.first[k[own] + 1][:, None] - 1)]
                word = np.hstack([w[own][:, None], drawn])
                co = c1[own]
                vec = q[word]
                score = _sigmoid(np.einsum("nd,nkd->nk", co, vec) - log_word[word])
                gw = np.hstack([1 - score[:, :1], -score[:, 1:]])
                dc[own] += np.einsum("nk,nkd->nd", gw, vec[:, :, :d])
                moved.step(self, at[2] + word.ravel(), (gw[:, :, None] * co[:, None, :]).reshape(-1, d + 1))
            zero = np.zeros((ORDER * n, 1), np.float32)
            dp = np.hstack([(h * dc).sum(axis=1), np.zeros((ORDER, 1), np.float32)])
            moved.step(self, b.ravel(), np.hstack([(p[:, None, :d] * dc).reshape(-1, d), zero]))
            moved.step(self, at[3] + np.arange(ORDER), dp / np.float32(n), POSITION_RATE)


def _log_softmax(c: np.ndarray, v: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each row's target by the scores of its context with all vectors ``v`` (with biases)."""
    s = c @ v[:, :-1].T
    s += v[:, -1]
    top = s.max(axis=1)
    picked = s[np.arange(len(s)), target] - top
    s -= top[:, None]
    np.exp(s, out=s)
    return picked - np.log(s.sum(axis=1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Moves:
    """Adagrad state of a task: squared gradients and uses of every vector."""

    def __init__(self, squares: np.ndarray):
        self.squares, self.uses = squares.copy(), np.zeros(len(squares), np.int64)

    def step(self, model: Model, row: np.ndarray, gradient: np.ndarray, rate: float | None = None) -> None:
        """Move the vectors ``row`` along the gradient (repeated rows add up)."""
        order = np.argsort(row.astype(np.uint16) if len(self.uses) <= 1 << 16 else row, kind="stable")  # small numbers are sorted by digits
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        n = np.diff(np.append(first, len(row)))
        row = row[first]
        g = np.add.reduceat(gradient[order], first, axis=0)
        self.squares[row] += (g * g).mean(axis=1)
        self.uses[row] += n
        model.theta[row] += (np.float32(RATE if rate is None else rate) / np.sqrt(self.squares[row]))[:, None] * g


def _shared_context(features):
    """(cell, n): how often each own word follows each of the most frequent words."""

    def count(batches):
        words, top = features.value
        total = np.zeros(FEATURES * words, np.int32)
        for batch in batches:
            col = batch.column(0)
            ids, ends = np.asarray(col.values), np.asarray(col.offsets, np.int64)
            ids, ends = ids[ends[0] : ends[-1]], ends - ends[0]
            prev = contexts(ids, ends, words)[0]  # a text's first word follows nothing
            f = np.where(prev < words, top[np.minimum(prev, words - 1)], -1)
            ok = (f >= 0) & (ids < words)
            cell, n = np.unique(f[ok] * words + ids[ok], return_counts=True)
            total[cell] += n.astype(np.int32)
        cell = np.flatnonzero(total)
        for a in range(0, len(cell), 200_000):
            part = cell[a : a + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["cell", "n"])

    return count


def clusters(table: np.ndarray, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Class of each word from what it follows (features x words): k-means over square roots of shares, weighted by use; of ``MEMBERS`` words at most."""
    words = table.shape[1]
    x = np.sqrt(table / np.maximum(table.sum(axis=0), 1)).T.astype(np.float32)
    k = max(1, min(words, math.isqrt(words)))
    rng = np.random.default_rng(seed)
    heavy = np.argsort(-counts, kind="stable")
    center = x[heavy[:k]] + rng.normal(0, 1e-3, (k, x.shape[1])).astype(np.float32)
    weight = np.sqrt(counts + 1.0)
    for _ in range(8):
        near = np.argmax(x @ center.T - 0.5 * (center * center).sum(axis=1), axis=1)
        sums = np.stack([np.bincount(near, weights=weight * x[:, f], minlength=k) for f in range(x.shape[1])], axis=1)
        mass = np.bincount(near, weights=weight, minlength=k)
        center = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-9)[:, None], center).astype(np.float32)
    # within a cluster frequent words first; large clusters are cut, and empty ones left out
    order = np.lexsort((-counts, near))
    place = np.arange(words) - np.searchsorted(near[order], near[order])
    label = np.empty(words, np.int64)
    label[order] = np.unique(near[order].astype(np.int64) * (1 << 32) + place // MEMBERS, return_inverse=True)[1]
    return label


def _trained(shared, turn):
    """(row, task, uses, move): how far one task's texts of this round move each vector, and the logarithm of its squares."""
    lo, hi = sum(ROUNDS[:turn]), sum(ROUNDS[: turn + 1])

    def train(batches):
        model: Model = shared.value
        start = model.theta
        model.theta = start.copy()
        task = TaskContext.get()
        number = task.partitionId() if task else 0
        rng, moved = np.random.default_rng([number, turn]), Moves(model.squares)
        try:
            for batch in batches:
                rid = batch.column(0).to_numpy()
                col = batch.column(1)
                flat, ends = np.asarray(col.values).astype(np.int64), np.asarray(col.offsets, np.int64)
                mine = np.flatnonzero((rid % 8 >= lo) & (rid % 8 < hi))
                for a in range(0, len(mine), 256):
                    rows = mine[a : a + 256]
                    parts = [flat[ends[r] : ends[r + 1]] for r in rows.tolist()]
                    ids = np.concatenate(parts)
                    model.fit(ids, contexts(ids, np.concatenate([[0], np.cumsum([len(x) for x in parts])]), model.end_id), rng, moved)
            row = np.flatnonzero(moved.uses)
            move = np.hstack([model.theta[row] - start[row], np.log(moved.squares[row])[:, None]]).astype(np.float16)
            for a in range(0, len(row), 20_000):
                p = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[p].astype(np.int32)), pa.array(np.full(len(row[p]), number, np.int32)), pa.array(moved.uses[row[p]]),
                        pa.array([x.tobytes() for x in move[p]], pa.binary()),
                    ],
                    names=["row", "task", "uses", "move"],
                )
        finally:
            model.theta = start

    return train


def _averaged(batches):
    """(row, move): the mean move of each vector by use; rows arrive sorted by row and task."""
    row, total, uses = -1, None, 0.0
    out: list[tuple[int, bytes]] = []
    for batch in batches:
        for r, n, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if r != row:
                if uses:
                    out.append((row, (total / uses).astype(np.float32).tobytes()))
                row, total, uses = r, np.zeros(WIDTH + 2), 0.0
            total += n * np.frombuffer(m.as_buffer(), np.float16).astype(np.float64)
            uses += n
        if len(out) > 20_000:
            yield _moves(out)
            out = []
    if uses:
        out.append((row, (total / uses).astype(np.float32).tobytes()))
    if out:
        yield _moves(out)


def _moves(out) -> pa.RecordBatch:
    row, move = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(move, pa.binary())], names=["row", "move"])


def learn(tokens: DataFrame, words: int, end_id: int, counts: np.ndarray) -> Model:
    """The model of training texts (rid, ids); ``counts``: uses of own words, then of tails."""
    spark = tokens.sparkSession
    top = np.full(words, -1)
    frequent = np.argsort(-counts[:words], kind="stable")[:FEATURES]
    top[frequent] = np.arange(len(frequent))
    cells = tokens.select("ids").mapInArrow(_shared_context(spark.sparkContext.broadcast((words, top))), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(FEATURES * words, np.float32)
    table[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    model = Model(words, end_id, clusters(table.reshape(FEATURES, words), counts[:words]), counts)
    for turn in range(len(ROUNDS)):
        shared = spark.sparkContext.broadcast(model)
        moves = tokens.select("rid", "ids").mapInArrow(_trained(shared, turn), "row int, task int, uses long, move binary")
        mean = moves.repartition("row").sortWithinPartitions("row", "task").mapInArrow(_averaged, "row int, move binary").toArrow()
        model.theta = model.theta.copy()
        if len(mean):
            row, move = mean["row"].to_numpy(), np.frombuffer(b"".join(mean["move"].to_pylist()), np.float32).reshape(-1, WIDTH + 2)
            model.theta[row] += move[:, :-1]
            model.squares[row] = np.exp(move[:, -1])
    return model


def _scored(shared):
    """The model's log10 probability of each text, but for what the counts of back-off words add."""

    def scores(batches):
        model, tail_base = shared.value
        for batch in batches:
            col = batch.column(1)
            flat, ends = np.asarray(col.values).astype(np.int64), np.asarray(col.offsets, np.int64)
            out = np.zeros(batch.num_rows)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + 65_536, side="right")) - 1)
                ids, at = flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
                p = model.log_probs(ids, contexts(ids, at, model.end_id)) * np.log10(np.e)
                p -= np.where(ids >= model.words, tail_base[np.maximum(ids - model.words, 0)], 0)
                out[lo:hi] = np.add.reduceat(p, at[:-1])
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["rid", "model"])

    return scores


def frequent(vocab: DataFrame, most: int, least: int = 1) -> pa.Table:
    """The most frequent words (word, n) of a vocabulary: ``most`` rows at most, counted ``least`` times at least.

    Counts are gathered into ranges an eighth of a doubling wide, and whole ranges are taken from the top, so nothing is sorted as a whole.
    """
    band = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r["band"], r["size"]) for r in vocab.where(F.col("n") >= least).groupBy(band.alias("band")).agg(F.count("*").alias("size")).collect()), reverse=True)
    cut_at, held = None, 0
    for value, size in sizes:
        if held + size > most:
            break
        cut_at, held = value, held + size
    rows = vocab.where((F.col("n") >= least) & (band >= cut_at)) if cut_at is not None else vocab.limit(0)
    return rows.select("word", "n").toArrow()


def score_texts(docs: DataFrame, held_out=None) -> DataFrame:
    """Score every whole text of ``docs`` (doc_id: long, text: string; other columns are ignored).

    Learns from the rows where ``held_out`` is false (default: crc32 of the doc_id as text modulo 10 is
    not 0; a null doc_id counts as the empty string). Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after
    lower-casing A-Z and one end. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram with 0.1 added) and score, both log10 of the text's probability. Null and empty
    texts are the end alone; repeated rows are scored each; without training rows every word is
    unknown; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    vocab = cut(docs.where(~F.col("held_out")).select("text").mapInArrow(_counted, "word long, tail int, n long").groupBy("word").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")))
    sums = vocab.agg(F.sum("n").alias("total"), F.count("*").alias("size")).first()
    total, size = sums["total"] or 0, sums["size"]

    listed = frequent(vocab, LISTED)
    listed, listed_n = listed["word"].to_numpy().view(np.uint64), listed["n"].to_numpy()
    order = np.argsort(listed)
    listed, listed_n = listed[order], listed_n[order]
    own = frequent(vocab, OWN, LEAST)
    own, own_n = own["word"].to_numpy().view(np.uint64), own["n"].to_numpy()
    if _END not in own:
        own, own_n = np.append(own, _END), np.append(own_n, 0)
    order = np.argsort(own)
    own, own_n = own[order], own_n[order]
    end_id, words = int(np.searchsorted(own, _END)), len(own)
    ids = spark.createDataFrame(pa.table({"word": own.view(np.int64)}))  # OWN + 1 rows at most
    tails = {t["tail"]: t for t in vocab.join(F.broadcast(ids), "word", "left_anti").groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tail_n = np.array([tails[t]["n"] if t in tails else 0 for t in range(TAILS)], np.float64)
    tail_v = np.array([tails[t]["v"] if t in tails else 0 for t in range(TAILS)], np.float64)

    columns = "rid long, doc_id long, held_out boolean, ids array<int>, hits long, base double, share double, rare array<long>, times array<int>"
    part = cut(docs.mapInArrow(_encoded(spark.sparkContext.broadcast(((own, np.arange(words)), listed, listed_n, total, size))), columns))
    model = learn(part.where(~F.col("held_out")), words, end_id, np.concatenate([own_n, tail_n]))
    scores = part.select("rid", "ids").mapInArrow(_scored(spark.sparkContext.broadcast((model, np.log10(tail_n + 0.1 * (tail_v + 1))))), "rid long, model double")

    rare = part.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("rid", F.col("r.rare").alias("word"), F.col("r.times").alias("m")).join(vocab.select("word", "n"), "word", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("rid").agg(F.sum(F.col("m") * F.log10(c + 0.1)).alias("s"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("k"))
    extra = F.coalesce("s", F.lit(0.0))
    known = part.select("rid", "doc_id", "held_out", F.size("ids").cast("long").alias("n_tokens"), "hits", "base", "share")
    return known.join(scores, "rid").join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + F.col("share") + extra).alias("score"),
    )
