"""Vector codes, exact dedup and importance resampling against plain loops."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.llm import exact_dedup, resample, skew, vector_codes

DOCS = "doc_id long, text string, n long, p long, sha string, kept string, Keep_ID int, rank int, buckets int, won int, rows int, h int"
WS = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, x, 1, 2, "s", "yes", 4, 5, 6, 7, 8, 9) for i, x in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Nulls, empties, ties, repeated rows, texts that agree in length or prefix, a long text."""
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdeÉñ漢𝄞9"), 3)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(1, 60, 60)]
    out = list(enumerate(texts))
    out += [(100 + i, x.replace(" ", "\n\t")) for i, x in enumerate(texts[:20])]
    out += [(7, texts[3]), (7, texts[3]), (7, texts[7]), (3, texts[3]), (None, texts[4] + "  "), (None, None), (201, ""), (202, " \n\x0b"), (203, None), (-5, "x" * 100), (-6, "x" * 99 + "y"), (300, " ".join(rng.choice(vocab, 30_000)))]
    out += [(400, "gone twice"), (400, "gone twice"), (None, "no id"), (None, "no id"), (None, "no  id"), (401, "  thin space"), (402, " thin space")]
    return out


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for k, (i, x) in enumerate(rows):
        groups[WS.sub("", x or "")].append((-len(x or ""), i is None, i or 0, k))
    out = []
    for k, (i, x) in enumerate(rows):
        members = groups[WS.sub("", x or "")]
        out.append((i, rows[min(members)[3]][0], len(members), min(members)[3] == k))
    return collections.Counter(out)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_exact_duplicates(spark, rows, monkeypatch, sent):
    monkeypatch.setattr(skew, "SENT", sent)
    monkeypatch.setattr(skew, "HOT", 30)  # some keys are heavy, others not
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "n", "p", "sha", "rank", "buckets", "won", "rows", "h", "keep_id", "group_size", "kept"]
    found = got.collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute_copies(rows)
    assert sum(r.kept for r in found) == len({WS.sub("", x or "") for _, x in rows})
    assert collections.Counter((r.doc_id, r.text) for r in found) == collections.Counter(rows)


def test_only_groups_that_survive_are_hashed(spark, monkeypatch):
    """Texts of a length or a prefix of their own are not hashed in full."""
    seen = {}
    attach = skew.attach
    monkeypatch.setattr(exact_dedup, "attach", lambda r, t, k, w: seen.setdefault("rows", r) and attach(r, t, k, w))
    exact_dedup.exact_duplicates(spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "ccc"), (4, "a a"), (5, "z" * 64 + "1"), (6, "z" * 64 + "2")], "doc_id long, text string"))
    hashed = {r.doc_id for r in seen["rows"].where(F.col("_sha").isNotNull()).collect()}
    assert hashed == {1, 4, 5, 6}


def test_exact_duplicates_of_nothing(spark, rows):
    empty = frame(spark, rows).limit(0)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def brute_scores(rows, target):
    def features(x):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]]

    own, other = [features(x) for _, x in rows], collections.Counter(b for x in target for b in features(x)[1])
    source = collections.Counter(b for _, f in own for b in f)
    s, t = sum(source.values()), sum(other.values())
    gain = [math.floor(1000 * math.log((other[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def test_resampling(spark, rows):
    target = [rows[5][1], "some Ünknown words", None, ""]
    got = resample.resample(frame(spark, rows), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(brute_scores(rows, target))
    assert sum(r[4] is not None for r in brute_scores(rows, target)) > 5


def test_resampling_ranks_over_many_ranges_and_ties(spark):
    rows = [(i // 2, f"w{i % 3} " * 25) for i in range(4000)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "w0 w0")], "item_id long, text string"))
    key = lambda r: (r[4] is None, r[4] or 0, *(x or 0 for x in r[:4]))
    want = sorted(brute_scores(rows, ["w0 w0"]), key=key)
    found = sorted(map(tuple, got.collect()), key=key)
    assert [r[4] for r in found] == [r[4] for r in want] and [r[3] for r in found if r[4]] == [r[3] for r in want if r[4]]
    assert [r[0] for r in found if r[4]] == [r[0] for r in want if r[4]]


def test_resampling_of_nothing(spark, rows):
    docs = frame(spark, rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(docs.limit(0), none).count() == 0
    assert resample.resample(docs, none).count() == len(rows)
    assert {r["rank"] for r in resample.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()} == {None}


def brute_codes(rows):
    """(vec_id, label, code, error) and all entries, in Python's whole numbers."""
    kept = [(i, lab, v) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(4, -(-max(len(v) for _, _, v in kept) // 4) * 4)
    ints = [[max(-(1 << 26), min(1 << 26, math.floor(x * 1024))) for x in v] + [0] * (width - len(v)) for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:256]
    w = width // 4
    books = [[ints[k][p * w : (p + 1) * w] for k in order] for p in range(4)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, v: min((gap(v[p * w : (p + 1) * w], c), j) for j, c in enumerate(books[p]))
    for _ in range(4):
        found = [[near(p, v)[1] for v in ints] for p in range(4)]
        for p in range(4):
            for j in set(found[p]):
                own = [v[p * w : (p + 1) * w] for v, f in zip(ints, found[p], strict=True) if f == j]
                books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = []
    for (i, lab, _), v in zip(kept, ints, strict=True):
        best = [near(p, v) for p in range(4)]
        out.append((i, lab, "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best)))
    return out, books


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    f32 = lambda v: [float(np.float32(x)) for x in v]
    rows = [(int(i), int(i) % 3, f32(rng.normal(0, 0.2, 12))) for i in rng.permutation(330)]
    rows += [(1000 + i, None, rows[4][2]) for i in range(20)] + [rows[9], rows[9], (None, 1, f32(rng.normal(size=12))), (3, 1, f32(rng.normal(size=12)))]
    return rows + [(2000, 1, None), (2001, 1, [0.1] * 11 + [None]), (2002, 1, [float("nan")] * 12), (2003, 1, [float("inf")] + [0.0] * 11), (2004, 9, [0.5] * 5), (2005, 9, []), (2006, None, [0.25] * 11)]


VECTORS = "vec_id long, label int, embedding array<float>, code string, error int, key string, n int"


def test_vector_codes(spark, vectors, monkeypatch):
    want, books = brute_codes(vectors)
    by = collections.Counter()
    for _, lab, _, e in want:
        by[lab] += e
    flat = ",".join(str(x) for p in books for c in p for x in c)
    sha = hashlib.sha256(flat.encode()).hexdigest()
    df = spark.createDataFrame([(*r, "c", 0, "k", 0) for r in vectors], VECTORS).repartition(5)
    for sent in (200_000, 0):
        monkeypatch.setattr(skew, "SENT", sent)
        monkeypatch.setattr(skew, "HOT", 3)
        got = collections.Counter(map(tuple, vector_codes.compress(df).collect()))
        assert got == collections.Counter((*r, by[r[1]], sha) for r in want)
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(df.where("vec_id = 2000")).count() == 0
    assert vector_codes.compress(df.where("vec_id = 2005")).collect()[0].code == "00000000"


def test_vectors_come_back_within_their_error(spark, vectors):
    df = spark.createDataFrame([(*r, "c", 0, "k", 0) for r in vectors if r[2] and len(r[2]) == 12], VECTORS)
    books = vector_codes.fit_codebooks(df)
    for r in vector_codes.decode(vector_codes.encode(df, books), books).join(df.select("vec_id", "embedding"), "vec_id").where("vec_id >= 1000 AND vec_id < 2000").collect():
        assert sum((math.floor(x * 1024) - y * 1024) ** 2 for x, y in zip(r.embedding, r.vector, strict=True)) == pytest.approx(r.error)


def test_nearest_is_exact_where_float32_is_not():
    """Entries that differ by less than the rounding of a float32 product, equal entries, and the largest numbers."""
    rng = np.random.default_rng(2)
    for size, spread in ((1 << 26, 3), (1 << 20, 1), (50, 2)):
        base = rng.integers(-size, size + 1, 16)
        entries = np.clip(base + rng.integers(-spread, spread + 1, (256, 16)), -(1 << 26), 1 << 26)
        entries[100] = entries[3]
        x = np.clip(base + rng.integers(-spread, spread + 1, (300, 16)), -(1 << 26), 1 << 26)
        x[:20] = rng.integers(-(1 << 26), (1 << 26) + 1, (20, 16))
        best, error = vector_codes.Codebook(entries).nearest(x)
        gaps = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (best == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()
