"""SentencePiece encoding and decoding with sampled segmentations.

Texts are encoded over the lattice of a public SentencePiece vocabulary (never trained here). The model
is a merge list, so a piece's log-probability follows Zipf's law of its rank. Segmentations are drawn by
Gumbel top-k without replacement: the tree of all segmentations of a text is searched best first by
perturbed log-probability. A leaf carries the maximum of its tree; at every step of its path the arcs
not taken form a subtree whose maximum is a Gumbel variable truncated by the leaf's value; the best
such subtree holds the next segmentation. Draws depend on the row's key alone. The lattice falls into
units (spaces and the word after them), which share their arcs wherever a word recurs; a text's path runs
through all its units, so the samples are of whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Longer units are cut where no piece spans the place, which changes no segmentation; without such a place they stay whole.
LONGEST = 48
_ZIPF, _BYTE = 8.0, -16.0


def load(path: str = MODEL) -> list[bytes | int]:
    """The pieces by id: bytes with a space for the word mark, a number for a byte piece, or empty."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[bytes | int] = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append(int(sp.id_to_piece(i)[1:-1], 16))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(b"")
        else:
            out.append(sp.id_to_piece(i).replace("▁", " ").encode())
    return out


class Vocabulary:
    def __init__(self, pieces: list[bytes | int]):
        words = [(i, p) for i, p in enumerate(pieces) if isinstance(p, bytes) and p]
        self.byte = np.zeros(256, np.int64)
        for i, p in enumerate(pieces):
            if isinstance(p, int):
                self.byte[p] = i
        self.longest = max(len(p) for _, p in words)
        flat = np.frombuffer(b"".join(p for _, p in words), np.uint8)
        size = np.array([len(p) for _, p in words])
        first = np.cumsum(size) - size
        h = tk.Prefix(flat)
        ids = np.array([i for i, _ in words])
        self.prefixes, self.whole, self.ids = [], [], []
        for k in range(1, self.longest + 1):
            some = size >= k
            self.prefixes.append(Table(np.unique(h(first[some], first[some] + k))))
            full = h(first[size == k], first[size == k] + k)
            order = np.argsort(full)
            self.whole.append(Table(full[order]))
            self.ids.append(ids[size == k][order])
        rank = np.arange(len(pieces)) - words[0][0]
        self.score = np.where([isinstance(p, bytes) for p in pieces], -np.log(np.maximum(rank, 0) + _ZIPF), _BYTE)
        # bytes of each piece, for decoding
        raw = [bytes([p]) if isinstance(p, int) else p for p in pieces]
        self.raw, self.size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a sequence of ids."""
        n = self.size[ids]
        return self.raw[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


class Table:
    """Sorted hashes with an index over their leading bits."""

    def __init__(self, values: np.ndarray):
        self.values, bits = values, 17
        self.shift = np.uint64(64 - bits)
        slot = (values >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange(1 << bits))
        count = np.bincount(slot, minlength=1 << bits)
        self.some, self.most = count > 0, int(count.max(initial=0))

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``values`` are in the table, as places in ``values``, and where."""
        slot = (values >> self.shift).astype(np.int64)
        who = np.flatnonzero(self.some[slot])
        at, hit = self.first[slot[who]], np.zeros(len(who), bool)
        found = at.copy()
        for k in range(self.most):
            i = np.minimum(at + k, len(self.values) - 1)
            same = self.values[i] == values[who]
            found[same], hit = i[same], hit | same
        return who[hit], found[hit]


class Lattice:
    """Arcs of distinct units: node of start, node of end, piece, probability among the arcs of their node."""

    def __init__(self, vocab: Vocabulary, buf: np.ndarray, first: np.ndarray, size: np.ndarray):
        # node = byte of a unit; units are packed with one more node for their end
        self.first = np.cumsum(size + 1) - (size + 1)
        n = int((size + 1).sum())
        pos = np.repeat(first - self.first, size + 1) + np.arange(n)
        left = np.repeat(self.first + size, size + 1) - np.arange(n)  # bytes up to the unit's end
        h = tk.Prefix(buf)
        lead = (buf[np.minimum(pos, len(buf) - 1)] & 0xC0) != 0x80
        alive = np.flatnonzero((left > 0) & lead)
        starts, ends, pieces = [], [], []
        width = np.ones(256, np.int64)
        width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:] = 2, 3, 4
        char = width[buf[np.minimum(pos, len(buf) - 1)]]
        known = np.zeros(n, bool)
        for k in range(1, vocab.longest + 1):
            alive = alive[left[alive] >= k]
            if not len(alive):
                break
            key = h(pos[alive], pos[alive] + k)
            hit, _ = vocab.prefixes[k - 1].find(key)
            alive, key = alive[hit], key[hit]
            hit, i = vocab.whole[k - 1].find(key)
            at = alive[hit]
            known[at] |= char[at] == k
            starts.append(at)
            ends.append(at + k)
            pieces.append(vocab.ids[k - 1][i])
        bare = np.flatnonzero((left > 0) & lead & ~known)
        for k in range(4):
            b = bare[(char[bare] > k) & (left[bare] > k)] + k
            starts.append(b)
            ends.append(b + 1)
            pieces.append(vocab.byte[buf[pos[b]]])
        # by node, long pieces (the likely ones) first
        start, end, piece = (np.concatenate(x[::-1]) for x in (starts, ends, pieces))
        order = np.argsort(start.astype(np.int32), kind="stable")
        self.start, self.end, self.piece = start[order], end[order], piece[order]
        narrow = np.int16 if left.max(initial=0) < 1 << 15 else np.int64  # 16 bits sort faster
        back = np.argsort(left[self.start].astype(narrow), kind="stable")  # from the units' ends backwards
        start, end, piece = self.start[back], self.end[back], self.piece[back]
        score = vocab.score[piece]
        mass = np.full(n, -np.inf)
        mass[left == 0] = 0
        level = np.searchsorted(left[start], np.arange(1, int(left.max(initial=0)) + 2))
        logp = np.empty(len(start))
        for a, b in zip(level[:-1], level[1:], strict=True):
            if a == b:
                continue
            v = score[a:b] + mass[end[a:b]]
            head = np.concatenate([[True], start[a + 1 : b] != start[a : b - 1]])
            i = np.flatnonzero(head)
            top = np.maximum.reduceat(v, i)
            of = np.cumsum(head) - 1
            with np.errstate(invalid="ignore"):
                m = top + np.log(np.add.reduceat(np.exp(np.where(np.isfinite(v), v - top[of], -np.inf)), i))
                logp[a:b] = np.where(np.isfinite(v), v - m[of], -np.inf)
            mass[start[a:b][i]] = np.where(np.isfinite(top), m, -np.inf)
        self.logp = np.empty_like(logp)
        self.logp[back] = logp
        start = self.start
        self.p = np.exp(self.logp)
        head = np.concatenate([[True], self.start[1:] != self.start[:-1]]) if len(start) else np.zeros(0, bool)
        i = np.flatnonzero(head)
        total = np.cumsum(self.p)
        self.below = total - self.p - np.repeat((total - self.p)[i], np.diff(np.append(i, len(start)))) if len(start) else total
        self.above = self.below + self.p
        if len(i):
            self.above[np.append(i[1:] - 1, len(start) - 1)] = np.inf
        self.out = np.zeros(n, np.int64)
        self.out[self.start[i]] = i
        self.done = left == 0

    def arc(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc of each node at u of its probability."""
        at = self.out[node]
        more = np.flatnonzero(u >= self.above[at])
        while len(more):
            at[more] += 1
            more = more[u[more] >= self.above[at[more]]]
        return at

    def draw(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Paths from nodes to their units' ends: which path, step and arc, in no order."""
        who, step, out = np.flatnonzero(~self.done[node]), 0, []
        node = node.copy()
        while len(who):
            arc = self.arc(node[who], _uniform(seed[who] + tk.salt(2 * step + 1)))
            out.append((who, np.full(len(who), step), arc))
            node[who] = self.end[arc]
            who = who[~self.done[node[who]]]
            step += 1
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((tk.mix(seed) >> tk.U(11)).astype(np.float64) + 0.5) / (1 << 53)


def _spanned(vocab: Vocabulary, buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which bytes of ``buf`` lie within a piece or a character that starts before them in the same unit; other units than the given ones are not looked at."""
    pos = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    left = np.repeat(first + size, size) - pos
    lead = (buf[pos] & 0xC0) != 0x80
    alive, left = pos[lead], left[lead]
    end = np.zeros(len(buf), np.int64)
    h = tk.Prefix(buf)
    for k in range(1, vocab.longest + 1):
        alive, left = alive[left >= k], left[left >= k]
        if not len(alive):
            break
        key = h(alive, alive + k)
        hit, _ = vocab.prefixes[k - 1].find(key)
        alive, left, key = alive[hit], left[hit], key[hit]
        hit, _ = vocab.whole[k - 1].find(key)
        end[alive[hit]] = alive[hit] + k
    reach = np.maximum.accumulate(end)  # no piece leaves its unit, so none of an earlier unit reaches in
    out = (buf & 0xC0) == 0x80
    out[1:] |= reach[:-1] > np.arange(1, len(buf))
    return out


def _units(vocab: Vocabulary, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and row of the units."""
    space = buf == 0x20
    new = np.zeros(len(buf), bool)
    new[1:] = space[1:] & ~space[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(buf)))
    long = np.flatnonzero(size > LONGEST)
    if len(long):
        free = np.flatnonzero(~_spanned(vocab, buf, first[long], size[long]))
        for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True):
            p = a + LONGEST
            while p < a + n:
                i = np.searchsorted(free, p)
                p = int(free[i]) if i < len(free) else a + n
                if p < a + n:
                    new[p] = True
                p += LONGEST
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(buf)))
    return first, size, np.searchsorted(at, first, side="right") - 1


def sample(vocab: Vocabulary, buf: np.ndarray, at: np.ndarray, key: np.ndarray, k: int = SAMPLES):
    """``k`` distinct segmentations (or all, if fewer) of each row of a slice whose rows start with a space.

    Returns for each sample: ids (flat), offsets, log-probability, perturbed log-probability; and the
    threshold, the perturbed log-probability of the best segmentation left out. Rows without a further
    segmentation have a perturbed log-probability of -inf.
    """
    rows = len(at) - 1
    first, size, row = _units(vocab, buf, at)
    h = tk.Prefix(buf)(first, first + size)
    _, one, unit = np.unique(h, return_index=True, return_inverse=True)
    lattice = Lattice(vocab, buf, first[one], size[one])
    node = lattice.first[unit]
    place = np.arange(len(unit)) - np.searchsorted(row, row)
    paths: list[dict] = []
    seed = lambda s: tk.mix(key[row] + tk.salt(7919 * s + 1)) + place.astype(np.uint64) * tk.salt(3)

    def path(who, step, arc, value, turn, parent):
        """One sample of all rows from its arcs; ``turn``: index of the step where it left its parent."""
        order = np.lexsort((step, who))
        arc, owner = arc[order], row[who[order]]
        offs = np.searchsorted(owner, np.arange(rows + 1))
        before = np.concatenate([[0], np.cumsum(lattice.logp[arc])])
        lead = before[:-1] - before[offs[owner]]  # log-probability of the path up to each step
        return {"arc": arc, "who": who[order], "owner": owner, "offs": offs, "lead": lead, "logp": before[offs[1:]] - before[offs[:-1]], "g": value, "turn": turn, "parent": parent}

    def rests(p, s):
        """Perturbed maxima of the subtrees beside the path, from the step where it is new."""
        i = np.arange(len(p["arc"]))
        fresh = i - p["offs"][p["owner"]] >= p["turn"][p["owner"]]
        gone = lattice.p[p["arc"]].copy()
        for q, mine in _line(paths, p["parent"], p["turn"]):
            gone[p["offs"][mine] + p["turn"][mine]] += lattice.p[paths[q]["arc"][paths[q]["offs"][mine] + p["turn"][mine]]]
        noise = -np.log(_uniform(tk.mix(key[p["owner"]] + tk.salt(104729 * (s + 1))) + i.astype(np.uint64) * tk.salt(5) - p["offs"][p["owner"]].astype(np.uint64) * tk.salt(5)))
        with np.errstate(divide="ignore", invalid="ignore"):
            phi = p["lead"] + np.where(gone < 1 - 1e-9, np.log1p(-np.minimum(gone, 1)), -np.inf)
            v = -np.logaddexp(-p["g"][p["owner"]], np.log(noise) - phi)
        return np.where(fresh & np.isfinite(phi), v, -np.inf)

    who, step, arc = lattice.draw(node, seed(0))
    g = -np.log(-np.log(_uniform(key + tk.salt(31))))
    paths.append(path(who, step, arc, g, np.zeros(rows, np.int64), np.full(rows, -1)))
    open_ = [rests(paths[0], 0)]

    def best():
        top, of, where = np.full(rows, -np.inf), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for s, (p, v) in enumerate(zip(paths, open_, strict=True)):
            some = np.flatnonzero(np.diff(p["offs"]) > 0)
            if not len(some):
                continue
            m = np.full(rows, -np.inf)
            m[some] = np.maximum.reduceat(v, p["offs"][some])
            hit = np.flatnonzero((v == m[p["owner"]]) & np.isfinite(v))[::-1]
            at_ = np.zeros(rows, np.int64)
            at_[p["owner"][hit]] = hit
            better = m > top
            top[better], of[better], where[better] = m[better], s, at_[better]
        return top, of, where

    for s in range(1, k):
        top, of, where = best()
        parts = []
        turn = np.full(rows, 1 << 40)
        for q, p in enumerate(paths):
            mine = np.flatnonzero(np.isfinite(top) & (of == q))
            if not len(mine):
                continue
            i = where[mine]
            turn[mine] = i - p["offs"][mine]
            limit = np.full(rows, -1)
            limit[mine] = i
            j = np.flatnonzero(np.arange(len(p["arc"])) < limit[p["owner"]])
            keep = p["who"], np.arange(len(p["arc"])) - np.searchsorted(p["who"], p["who"])
            parts.append((keep[0][j], keep[1][j], p["arc"][j]))
            # another arc of the node, by what is left of its probability
            start = lattice.start[p["arc"][i]]
            u = _uniform(key[mine] + tk.salt(611953 * s + 7))
            taken = []
            for x, z in _line(paths, np.where(np.isin(np.arange(rows), mine), q, -1), turn):
                t = np.full(rows, -1)
                t[z] = paths[x]["arc"][paths[x]["offs"][z] + turn[z]]
                taken.append(t[mine])
            taken = np.sort(np.stack(taken), axis=0)
            width = np.where(taken >= 0, lattice.p[taken], 0)
            u *= np.maximum(1 - width.sum(0), 0)
            for t, w in zip(taken, width, strict=True):  # in order of place: step over the arcs taken
                u += np.where((t >= 0) & (u >= lattice.below[t]), w, 0)
            other = lattice.arc(start, u)
            w0, s0 = p["who"][i], keep[1][i]
            parts.append((w0, s0, other))
            seeds = tk.mix(key[mine] + tk.salt(15485863 * s + 3))
            dw, ds, da = lattice.draw(lattice.end[other], seeds)
            parts.append((w0[dw], s0[dw] + 1 + ds, da))
            later = np.full(rows, 1 << 60)
            later[mine] = w0
            z = np.flatnonzero(np.arange(len(unit)) > later[row])
            dw, ds, da = lattice.draw(node[z], seed(s)[z])
            parts.append((z[dw], ds, da))
            open_[q][i] = -np.inf
        if not parts:
            break
        who, step, arc = (np.concatenate(c) for c in zip(*parts, strict=True))
        paths.append(path(who, step, arc, top, turn, np.where(np.isfinite(top), of, -1)))
        open_.append(rests(paths[-1], s))
    threshold = best()[0]
    return [(lattice.piece[p["arc"]], p["offs"], p["logp"], p["g"]) for p in paths], threshold


def _line(paths, of, turn):
    """The paths that pass the node at step ``turn`` of path ``of`` (-1: none) and took an arc there: path, rows."""
    while (of >= 0).any():
        up = np.full(len(of), -1)
        for q in np.unique(of[of >= 0]):
            mine = np.flatnonzero(of == q)
            yield q, mine
            same = mine[paths[q]["turn"][mine] == turn[mine]]
            up[same] = paths[q]["parent"][same]
        of = up


def _sampled(shared, k, digests):
    def run(batches):
        vocab: Vocabulary = shared.value
        for batch in batches:
            data, offs = tk.column(batch, "text")
            keys = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, buf, at in tk.slices(data, offs, 1 << 18):
                rows = hi - lo
                spaced = np.insert(buf, at[:-1], 0x20)  # the mark before the first word
                at = at + np.arange(rows + 1)
                found, threshold = sample(vocab, spaced, at, tk.mix(keys[lo:hi]), k)
                for s, (ids, o, logp, g) in enumerate(found):
                    live = np.flatnonzero(np.isfinite(g))
                    decoded, size = vocab.decode(ids), vocab.size[ids]
                    ends = np.concatenate([[0], np.cumsum(size)])[o]
                    same = np.array([np.array_equal(decoded[ends[i] : ends[i + 1]], spaced[at[i] : at[i + 1]]) for i in live], bool)
                    with np.errstate(over="ignore"):
                        chance = -np.expm1(-np.exp(np.minimum(logp - threshold, 50)))
                    flat = ids.astype(np.int32)
                    if digests:
                        raw = flat.astype("<i4")
                        out = pa.array([hashlib.sha256(raw[o[i] : o[i + 1]].tobytes()).hexdigest() for i in live], pa.string())
                    else:
                        out = pa.array([flat[o[i] : o[i + 1]] for i in live], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(2).slice(lo, rows).take(pa.array(live)),
                            pa.array(np.full(len(live), s), pa.int32()),
                            pa.array(np.diff(o)[live], pa.int64()),
                            pa.array(logp[live]),
                            pa.array(g[live]),
                            pa.array(chance[live]),
                            pa.array(same),
                            out,
                        ],
                        names=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids_sha256" if digests else "ids"],
                    )

    return run


def encode_sampled(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, digests: bool = False) -> DataFrame:
    """``k`` distinct sampled segmentations of every whole text of ``docs`` (doc_id long, text; others are ignored).

    Returns for each row and sample: doc_id, sample (0 is the one of the largest perturbed log-probability),
    n_pieces, log_prob, perturbed, inclusion (the probability that the segmentation is among the samples,
    given the threshold), round_trip (whether decoding gives the text back) and ids, or ids_sha256 of their
    little-endian 32-bit values if ``digests``. Null and empty texts are the lone mark; a text with fewer
    segmentations has fewer samples; draws depend on doc_id (null: 0), so repeated rows give the
    same samples; an empty table gives an empty result.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(text.alias("text"), key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(load(model)))
    last = "ids_sha256 string" if digests else "ids array<int>"
    return docs.mapInArrow(
        _sampled(shared, k, digests), f"doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, round_trip boolean, {last}"
    )


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Texts of encoded rows: all columns of ``encoded`` with ids (array<int>) replaced by text. Null ids give null."""
    vocab = encoded.sparkSession.sparkContext.broadcast(Vocabulary(load(model)))

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: None if x is None else vocab.value.decode(np.asarray(x, np.int64)).tobytes()[1:].decode(errors="replace"))

    return encoded.withColumn("text", text("ids")).drop("ids")
