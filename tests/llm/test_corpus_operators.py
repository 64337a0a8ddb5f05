import collections
import hashlib
import math
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trustweave.llm import chat_format, decontaminate, html_text, line_dedup, lm_scoring, near_dedup, quality_rules, quality_trees, repeats, sentencepieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, node long"


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text, and columns whose names the operators use inside."""
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcdeéñ"), 4)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab, int(n))) + "." for n in rng.integers(3, 200, 40)]
    texts += [texts[5], texts[5].upper(), texts[6] + " one more", texts[7] + "\n" + texts[8], " ".join(rng.choice(vocab, 20_000)), "a b", "", "  \n ", None, "Orre " * 300]
    rows = [(i, x, "en", f"src{i % 2}", 0, 1, 2, 3) for i, x in enumerate(texts)]
    rows += [rows[0], (None, texts[9], None, None, None, None, None, None), (len(texts), "same line here.\n" + texts[3], "en", "src0", 0, 0, 0, 0)]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def pairs(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_near_duplicates(odd, empty):
    rows = pairs(odd, "doc_id", "text")
    sets = []
    for _, x in rows:
        w = words((x or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = collections.Counter((rows[i][0], len(sets[i]), low[group[i]], rows[i][0] is not None and rows[i][0] == low[group[i]]) for i in range(len(rows)))
    got = near_dedup.near_duplicates(odd)
    assert collections.Counter(pairs(got, "doc_id", "n_shingles", "component_id", "kept")) == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_open_group(spark):
    """Copies of one text with ever more edits: links only between neighbours, so buckets stay open after the first comparison."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([f"x{j}" for j in range(4 * k)] + base[4 * k :]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {0}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    a, b = x[:900], x[100:]
    sig = near_dedup.superminhash(np.concatenate([a, b]), np.array([0, 900, 1800]), 250)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.08


def test_segmentations(odd, empty):
    got = sentencepieces.encode_sampled(odd, k=3)
    rows = got.collect()
    assert all(r.round_trip for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows if r.doc_id is not None and r.doc_id > 0}) == sum(r.doc_id is not None and r.doc_id > 0 for r in rows)
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    back = sentencepieces.decode(got.where("sample = 0").select("doc_id", "ids"))
    assert collections.Counter(pairs(back, "doc_id", "text")) == texts
    assert pairs(sentencepieces.encode_sampled(odd.repartition(7), k=3).orderBy("doc_id", "sample"), "ids") == pairs(got.orderBy("doc_id", "sample"), "ids")
    assert sentencepieces.encode_sampled(empty).count() == 0


@pytest.mark.parametrize("text", [" " + "ab" * 40, " " + "ab" * 20000, " " + "ab" * 30 + "\n" + "ab" * 30 + "漢" * 40 + "ab"])
def test_long_units_are_sampled_over_their_whole_lattice(text):
    pieces = [b"", b" a", b"b", b" ", b"a", b" ab", b"ab", b"bab", *range(256)]
    vocab = sentencepieces.Vocabulary(pieces)
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    (found, *_), _ = sentencepieces.sample(vocab, buf, np.array([0, len(buf)]), sentencepieces.tk.mix(np.array([7], np.uint64)), 1)
    ids, _, logp, _ = found
    # the lattice of the whole text, forwards
    names = {p: i for i, p in enumerate(pieces) if isinstance(p, bytes) and p}
    mass = np.full(len(raw) + 1, -np.inf)
    mass[0] = 0
    for i in range(len(raw)):
        for k in (1, 2, 3):
            if raw[i : i + k] in names and i + k <= len(raw):
                mass[i + k] = np.logaddexp(mass[i + k], mass[i] + vocab.score[names[raw[i : i + k]]])
        if raw[i] > 0x7F or raw[i] == 10:
            mass[i + 1] = mass[i] + vocab.score[vocab.byte[raw[i]]]
    assert vocab.decode(ids).tobytes() == raw
    assert abs(logp[0] - (vocab.score[ids].sum() - mass[-1])) < 1e-6 * max(1, abs(mass[-1]))


def test_segmentations_follow_the_lattice():
    """First samples follow the probabilities of all segmentations; the order of samples is that of top-k without replacement."""
    vocab = sentencepieces.Vocabulary([b"", b" a", b"b", b" ", b"a", b" ab", b"ab"])
    rows = 20_000
    buf = np.frombuffer(b" ab" * rows, np.uint8)
    found, _ = sentencepieces.sample(vocab, buf, np.arange(rows + 1) * 3, sentencepieces.tk.mix(np.arange(rows).astype(np.uint64)), 4)
    score = vocab.score
    paths = {(5,): score[5], (1, 2): score[1] + score[2], (3, 6): score[3] + score[6], (3, 4, 2): score[3] + score[4] + score[2]}
    total = np.log(sum(np.exp(v) for v in paths.values()))
    p = {k: float(np.exp(v - total)) for k, v in paths.items()}
    orders = [tuple(tuple(ids[o[i] : o[i + 1]]) for ids, o, _, _ in found) for i in range(rows)]
    assert all(len(set(o)) == 4 for o in orders)
    first, second = collections.Counter(o[0] for o in orders), collections.Counter(o[:2] for o in orders)
    third = collections.Counter(o[2] for o in orders)
    want3 = collections.Counter()
    for a in p:
        assert abs(first[a] / rows - p[a]) < 0.015
        for b in p:
            if a != b:
                both = p[a] * p[b] / (1 - p[a])
                assert abs(second[a, b] / rows - both) < 0.015
                for c in p:
                    if c not in (a, b):
                        want3[c] += both * p[c] / (1 - p[a] - p[b])
    assert all(abs(third[c] / rows - want3[c]) < 0.015 for c in p)


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_trees.score_quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    assert quality_trees.score_quality(empty, labels).count() == 0
    assert quality_trees.score_quality(odd, labels.limit(0)).count() == odd.count()


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality_trees.grow(x[:2000], y[:2000])
    assert ((trees(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_quality_scores_match_plain_statistics_and_walks(spark, odd, monkeypatch):
    """The score of every odd text from statistics and tree walks in plain Python."""
    kept, grow = {}, quality_trees.grow
    monkeypatch.setattr(quality_trees, "grow", lambda *a: kept.setdefault("trees", grow(*a)))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(quality_trees, "LEAST", 4)
    got = quality_trees.score_quality(odd, labels).collect()

    def measure(x):
        raw, w = (x or "").encode(), [y.encode() for y in words(x)]
        size, n = max(len(raw), 1), max(len(w), 1)
        letters = max(sum(65 <= c < 91 or 97 <= c < 123 for c in raw), 1)
        return [
            math.log1p(len(raw)), math.log1p(len(w)), sum(map(len, w)) / n, len(set(w)) / n, sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
            sum(a == b for a, b in zip(w, w[5:], strict=False)) / n, sum(y[-1] in b"!#%*$&" for y in w) / n, max(map(len, w), default=0), sum(65 <= c < 91 for c in raw) / letters,
            sum(48 <= c < 58 for c in raw) / size, sum(c >= 128 for c in raw) / size, (raw.count(b"\n") + 1) / n, raw.count(b" ") / size, *(raw.count(bytes([c])) / size for c in quality_trees._SYMBOLS),
        ]

    def walk(x):
        trees, x = kept["trees"], np.array(x, np.float32)
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return 1 / (1 + math.exp(-total))

    want = collections.Counter((i, round(walk(measure(x)), 6)) for i, x in pairs(odd, "doc_id", "text"))
    assert len(kept["trees"].leaf) > 10 and len({r.score for r in got}) > 5
    assert collections.Counter((r.doc_id, round(r.score, 6)) for r in got) == want


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_trees.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_lm(odd, empty):
    rows = pairs(odd, "doc_id", "text")
    tokens = [[*words((x or "").translate(LOWER)), None] for _, x in rows]
    held = [zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0 for i, _ in rows]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)) for t, h in zip(tokens, held, strict=True))
    got = lm_scoring.score_texts(odd).collect()
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm_scoring.score_texts(empty).count() == 0
    assert all(r.n_known == 0 and r.base_score == 0 for r in lm_scoring.score_texts(odd, F.lit(True)).collect())


def test_lm_scores_match_a_plain_loop(odd, monkeypatch):
    """The score of every text (nulls, empties, repeated rows, 20,000 words) from the model's vectors, token by token."""
    kept, learn = {}, lm_scoring.learn
    monkeypatch.setattr(lm_scoring, "LEAST", 2)
    monkeypatch.setattr(lm_scoring, "learn", lambda *a: kept.setdefault("model", learn(*a)))
    got = lm_scoring.score_texts(odd).collect()
    m, rows = kept["model"], pairs(odd, "doc_id", "text")
    held = {r.doc_id: r.held_out for r in got}
    c, ends = collections.Counter(), {}
    for i, x in rows:
        for w in [*words((x or "").translate(LOWER)), None]:
            c[w] += not held[i]
            ends[w] = w
    hashes = {w: int(lm_scoring._tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) if w else int(lm_scoring._END) for w in c}
    tails = {w: int(lm_scoring._tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0]) for w in c if w}
    own = sorted(hashes[w] for w in c if c[w] >= 2 or w is None)
    assert m.words == len(own) > 100 and m.words < len([w for w in c if c[w]])
    place = {h: k for k, h in enumerate(own)}
    ids = {w: place.get(hashes[w], m.words + tails.get(w, 0)) for w in c}
    n, v = collections.Counter(), collections.Counter()
    for w in c:
        if ids[w] >= m.words and c[w]:
            n[ids[w]] += c[w]
            v[ids[w]] += 1
    e, q, p = m.theta[m.at[1] : m.at[2]], m.theta[m.at[2] : m.at[3]], m.theta[m.at[3] :, :-1]
    members = collections.defaultdict(list)
    for k in range(m.words):
        members[int(m.outcome[k])].append(k)

    def score(x):
        total, past = 0.0, [m.end_id] * lm_scoring.ORDER
        for w in [*words((x or "").translate(LOWER)), None]:
            t = ids[w]
            h = sum(m.theta[past[i], :-1] * p[i] for i in range(lm_scoring.ORDER))
            s = e[:, :-1] @ h + e[:, -1]
            total += (s[m.outcome[t]] - np.log(np.exp(s).sum())) / math.log(10)
            if t < m.words:
                inside = members[int(m.outcome[t])]
                s = q[inside, :-1] @ h + q[inside, -1]
                total += (s[inside.index(t)] - np.log(np.exp(s).sum())) / math.log(10)
            else:
                total += math.log10((c[w] + 0.1) / (n[t] + 0.1 * (v[t] + 1)))
            past = [t, *past[:-1]]
        return total

    texts = {i: x for i, x in rows}
    assert len(got) == len(rows)
    for r in got:
        want = score(texts[r.doc_id])
        assert abs(r.score - want) < 2e-3 * max(1, abs(want)), r.doc_id


def test_lm_is_normalised_and_learns():
    """Probabilities of all words and tails add up to one, before and after training, which raises those of what follows."""
    rng = np.random.default_rng(0)
    words_, text = 40, (np.arange(60_000) // 2) % 39
    counts = np.concatenate([np.bincount(text, minlength=words_), np.zeros(lm_scoring.TAILS)])
    m = lm_scoring.Model(words_, 39, np.arange(words_) // 7, counts)
    before = rng.integers(0, words_ + lm_scoring.TAILS, (lm_scoring.ORDER, 20))
    mass = lambda: sum(np.exp(m.log_probs(np.full(20, w), before)) for w in range(words_ + lm_scoring.TAILS))
    assert np.allclose(mass(), 1, atol=1e-4)
    context = lm_scoring.contexts(text, np.array([0, len(text)]), 39)
    first = m.log_probs(text, context).mean()
    m.fit(text, context, rng, lm_scoring.Moves(m.squares))
    assert np.allclose(mass(), 1, atol=1e-4) and m.log_probs(text, context).mean() > first + 1


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = lm_scoring.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r.score < r.base_score for r in got) <= 0.05 * len(got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<header class=site-header>Site</header><div class="layout"><article><h1>Head &amp; more</h1><p><b>One  two<br><p>Three&nbsp;&lt;4 <i>five</i>
six</p><div class="ad">Buy</div><form>Mail <input></form></article><aside>Side</aside></div><section id="comments"><p>Nice</p></section><footer>&copy; Y</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Head & more\nOne two\nThree <4 five six"
    assert html_text.main_text("") == "" and html_text.main_text("plain < text") == "plain < text"
    assert html_text.main_text("<p>a<div>b</div>c") == "a\nb\nc"
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    same = html_text.template_candidates("<ul  class='x'><li>a\n b</ul>") & html_text.template_candidates("<p>z</p><ul class='x'><li>a b</li></ul>")
    assert len(same) == 2 and not html_text.template_candidates("<ul><li>a</ul>") & html_text.template_candidates("<ul><li>b</ul>")
    body = "<html><body><div>{n}</div><div class=x>Follow us everywhere</div><p>Text {n}</p></body></html>"
    rows = [(i, f"http://h.org/{i}", body.format(n=i)) for i in range(4)] + [(4, "http://g.org/1", body.format(n=4)), (5, None, None), (None, "odd", ""), (0, "http://h.org/0", body.format(n=0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit(1))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()}
    assert got[1, "http://h.org/1"] == ("1\nText 1", 8)
    assert got[4, "http://g.org/1"][0] == "4\nFollow us everywhere\nText 4"
    assert got[5, None] == ("", 0) and got[None, "odd"] == ("", 0)
    assert html_text.extract_pages(pages).count() == len(rows) and html_text.extract_pages(pages.limit(0)).count() == 0


def test_html_matches_counts_by_plain_loops(spark):
    """All pages of the smallest table, and pages at the thresholds: templates counted in plain Python."""
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    page = "<html><body><article><h1>T{n}</h1><p>Story {n}.</p></article><div>Thrice here</div>{more}</body></html>"
    rows += [(9000 + n, f"https://edge.org/{n}", page.format(n=n, more="<div>Twice here</div>" if n < 2 else "")) for n in range(3)]
    rows += [(9100 + n, f"https://body.org/{n}", f"<html><body><p>Story {n}.</p><div>On {'three' if n < 3 else 'few'}</div>{'<div>On two</div>' if n < 2 else ''}</body></html>") for n in range(10)]
    hosts, seen = collections.Counter(), collections.defaultdict(collections.Counter)
    host = lambda url: (re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "") or [None, ""])[1].lower()
    for _, url, html in rows:
        hosts[host(url)] += 1
        for x, (item, around) in html_text.recurring(html or "").items():
            seen[host(url), x, item][around] += 1
    template = collections.defaultdict(set)
    for (h, x, item), arounds in seen.items():
        n = sum(arounds.values())
        spread = not item and len(arounds) >= max(html_text.PAGES, html_text.SPREAD * math.sqrt(hosts[h]))
        if n >= html_text.PAGES and (n >= html_text.SHARE * hosts[h] or spread):
            template[h].add(x)
    want = collections.Counter((i, html_text.main_text(html or "", frozenset(template[host(url)]))) for i, url, html in rows)
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert collections.Counter(got.items()) == want
    assert got[9100] == "Story 0.\nOn two" and got[9001] == "T1\nStory 1."


def test_html_template_on_a_small_share_of_a_large_host(spark):
    page = "<html><body><h1>Title {n}</h1><p>This is the long story of page number {n}, told once.</p>{more}</body></html>"
    rows = []
    for n in range(120):
        more = "<div><p>Try our new app</p></div>" if n % 10 == 0 else ""  # unmarked, on 12 of 130 pages
        more += "<ul><li>Yes</li><li>Answer {n}</li></ul>".replace("{n}", str(n)) if n % 8 == 1 else ""  # an item of many texts
        rows.append((n, f"http://big.org/{n}", page.format(n=n, more=more)))
    copied = page.format(n=999, more="<div>A table of figures</div>")
    rows += [(200 + i, f"http://big.org/copy{i}", copied) for i in range(10)]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10] == "Title 10\nThis is the long story of page number 10, told once."
    assert got[9].endswith("Yes\nAnswer 9")
    assert all(got[200 + i].endswith("A table of figures") and got[200 + i].startswith("Title 999") for i in range(10))


def test_rules(spark, odd, empty):
    got = quality_rules.rate_texts(odd)
    want = []
    for i, x in pairs(odd, "doc_id", "text"):
        w = words(x)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = collections.Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        lines = [y for y in (x or "").split("\n") if words(y)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(pairs(got, *cols)) == collections.Counter(want)
    assert quality_rules.rate_texts(empty).count() == 0
    good = ["This is a plain line with enough words to stay.", "And another plain line?!", "Où est-ce que l'on va, et pourquoi ?", "Titre sans point", "the cat and the dog and the bird and the fish"]
    bad = ["Home | News | Sport | Mail", "%%% $$$ ### &&&", "We use cookies.", "Alle Rechte vorbehalten.", "Accueil > Produits > Aide > Prix", "Inicio", "Buy!! Now!! Cheap!! Deal!!", "la la la la la la la la la", "Menu | Contact"]
    mixed = [x for two in zip(good + [""] * 4, bad, strict=True) for x in two]
    r = quality_rules.rate_texts(spark.createDataFrame([(1, "\n".join(mixed))], "doc_id long, text string")).first()
    assert [x for x in r.cleaned.split("\n") if x] == good and r.n_failed_lines == len(bad)


def test_lines(spark, odd, empty):
    rows = [(i, "s", f"Own line {i}.\n  Common line. \n\nOther {i}") for i in range(8)] + [(8, None, "Common line."), (9, "s", None), (10, "t", "Common line.")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash")).withColumn("pages", F.lit(1)).withColumn("k", F.lit(1))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.cleaned) for r in line_dedup.drop_boilerplate_lines(docs).collect()}
    assert got[3] == (3, 1, "Own line 3.\n\nOther 3") and got[8] == (1, 0, "Common line.") and got[9] == (0, 0, "") and got[10][1] == 0
    assert line_dedup.drop_boilerplate_lines(odd).count() == odd.count() and line_dedup.drop_boilerplate_lines(empty).count() == 0


def _least_edits(item, text):
    """Fewest edits that make ``item`` a run of ``text``, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def _edited(rng, words, kind, evenly, d):
    w = list(words)
    at = np.linspace(0, len(w) - 1, d + 2)[1:-1].astype(int) if evenly else rng.choice(len(w), d, replace=False)
    for k in sorted(at.tolist(), reverse=True):
        w[k : k + 1] = [[], ["new"], [w[k], "more"]][kind if kind < 3 else int(rng.integers(3))]
    return w


def test_contamination(spark, odd, empty):
    rng = np.random.default_rng(4)
    vocab = np.array(["".join(rng.choice(list("klmnop"), 5)) for _ in range(400)])
    items = [(i, " ".join(rng.choice(vocab, int(n)))) for i, n in enumerate(rng.integers(8, 60, 40))]
    rows, planted = [], set()
    for i in range(200):
        item, text = items[i % 40]
        w = _edited(rng, text.split(), 3, False, len(text.split()) // 5) if i >= 40 else text.split()
        before, after = (" ".join(rng.choice(vocab, 30)) for _ in range(2))
        rows.append((1000 + i, f"{before} {' '.join(w).upper() if i % 3 else '. '.join(w)}, {after}"))
        planted.add((1000 + i, item))
    docs = spark.createDataFrame(rows + [(1, None), (2, "")], "doc_id long, text string").withColumn("item_id", F.lit(7))
    bench = spark.createDataFrame(items + [(90, None), (91, "..."), (None, "a b c d e f")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.edits, r.at_word) for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) <= planted and len(found) >= 0.99 * len(planted)
    assert all(found[1000 + i, i] == (0, 30) for i in range(40))
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_contamination_matches_edit_distance(spark, odd):
    """Every pair of odd texts (nulls, ties, repeated rows, 20,000 words, clashing columns) and items against the full table of edit distances."""
    texts = [r.text for r in odd.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 60]
    item_texts = [" ".join(texts[i % len(texts)].split()[5 : 5 + n]) for i, n in enumerate((1, 2, 4, 5, 6, 9, 10, 11, 15, 16, 20, 40, 50))]
    items = [(i, x, 1) for i, x in enumerate(item_texts)] + [(0, item_texts[0], 1), (77, item_texts[12], 2), (78, "never said anywhere", 3)]
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    words_of = lambda x: re.findall(r"[0-9a-zA-Z\u0080-\uffff]+", (x or "").translate(LOWER))
    want = collections.Counter()
    docs = pairs(odd, "doc_id", "text")
    for d, x in docs:
        for i, y, _ in items:
            w, v = words_of(y), words_of(x)
            if len(v) < 5000 or set(w) & set(v):
                k = _least_edits(w, v) if len(v) < 5000 else 0 if f" {' '.join(w)} " in f" {' '.join(v)} " else 99
                if k <= len(w) // 5:
                    want[d, i, k] += 1
    got = collections.Counter(pairs(decontaminate.contaminated(odd, bench), "doc_id", "item_id", "edits"))
    assert got == want and sum(want.values()) > 20


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 20, 30, 50, 80])
def test_contamination_recall_by_length(n):
    """With all allowed edits: everything is found up to 15 words, 99 % at least beyond."""
    rng = np.random.default_rng(n)
    p = 1 / (np.arange(30_000) + 2.7)
    draw = lambda k: [f"w{x}" for x in rng.choice(30_000, k, p=p / p.sum())]
    items = [draw(n) for _ in range(50)]
    shared = decontaminate.Items(np.arange(50), pa.array([" ".join(x) for x in items]))
    docs = [draw(20) + _edited(rng, x, kind, evenly, n // 5) + draw(20) for x in items for kind in range(4) for evenly in (True, False)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([" ".join(x) for x in docs])], names=["doc_id", "text"])
    found = {(d, i) for out in decontaminate._found(types.SimpleNamespace(value=shared))([batch]) for d, i in zip(out[0].to_pylist(), out[1].to_pylist(), strict=True)}
    missed = sum((k, k // 8) not in found for k in range(len(docs)))
    assert missed == 0 if n <= decontaminate.SHORT else missed <= 0.01 * len(docs)


@pytest.mark.parametrize("span", [400, 200])
def test_repeats(spark, odd, empty, span):
    shared = "".join(np.random.default_rng(5).choice(list("abc def"), 700))
    more = [(500, "left side " + shared + " right"), (501, shared[100:] + "tail"), (502, "x" * 1000), (503, shared[:399]), (504, shared[:450] + "y" + shared[:450])]
    docs = odd.select("doc_id", "text", "node", "rank").union(spark.createDataFrame(more, "doc_id long, text string").select("doc_id", "text", F.lit(0).cast("long"), F.lit(0)))
    raw = [(i, (x or "").encode()) for i, x in pairs(docs, "doc_id", "text")]
    seen = collections.Counter(x[k : k + span] for _, x in raw for k in range(len(x) - span + 1))
    want = collections.Counter()
    for i, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - span + 1):
            if seen[x[k : k + span]] > 1:
                gone[k : k + span] = True
        gone = gone[: len(x)]
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()] += 1
    got = repeats.remove_repeats(docs, span)
    assert collections.Counter(pairs(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == want
    assert repeats.remove_repeats(empty).count() == 0


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\<s>\\\\", "<|turn|>a<|text|>", "", None, "plain <\\s>", "<\\|end|>"]
    rows = [(c, t, ["system", "user", "assistant", "<s>tool", None][t % 5] if t else ["system", "user"][c % 2], (nasty[(c + t) % 7] or "") + " word" * (c * 40) if (c + t) % 7 != 4 else None) for c in range(6) for t in range(30)]
    rows += [(None, 0, "assistant", "x"), (3, 29, "assistant", "tie"), (3, 29, "assistant", "tie")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("pos", F.lit(1))
    w = chat_format.windows(chat_format.with_probe(turns), budget=512)
    assert w.where("conv_id = 5").count() > 3 and w.where("repeated > 0").count() > 0
    got = {r.conv_id: r for r in chat_format.read_back(w).collect()}
    probe = "</s>[INST] ok [/INST]"
    for c in {r[0] for r in rows} | {-1}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda y: (y[0], y[1].encode(), y[2].encode())) or [(0, "user", probe), (1, "assistant", probe)]
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    bodies = [x for f in pairs(w, "formatted") for x in f[0][3:-4].replace("<|turn|>", "\0").replace("<|text|>", "\0").replace("<|end|>", "\0").split("\0")]
    assert not any(s in b for b in bodies for s in chat_format.CONTROL)
    assert chat_format.read_back(chat_format.windows(turns.limit(0))).count() == 0


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    for docs in (odd.select(*corpus_pipeline.COLUMNS), empty.select(*corpus_pipeline.COLUMNS)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, d)
            if name == "encoding":
                assert out.count() >= docs.count() and out.where("NOT round_trip").count() == 0
            else:
                assert out.columns == corpus_pipeline.COLUMNS, name
                assert out.count() <= docs.count()


def test_pipeline_keeps_rows_without_ids(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{d}/benchmark.parquet").first().text
    rng = np.random.default_rng(8)
    said = [" ".join(rng.choice(["".join(rng.choice(list("opqrst"), 5)) for _ in range(500)], 60)) for _ in range(6)]
    rows = [(1, said[0]), (2, said[0] + "."), (None, said[0]), (None, said[1]), (None, said[1]), (3, said[2]), (3, said[2]), (3, said[3]), (None, None), (4, ""), (None, f"{said[4]} {item}"), (None, said[5])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter(pairs(corpus_pipeline.near_duplicates(spark, docs, d), "doc_id", "text"))
    assert got == collections.Counter([(1, said[0]), (None, said[1]), (3, said[2]), (3, said[3]), (None, None), (4, ""), (None, f"{said[4]} {item}"), (None, said[5])])
    got = collections.Counter(pairs(corpus_pipeline.decontamination(spark, docs, d), "doc_id", "text"))
    assert got == collections.Counter((i, x) for i, x in rows if not (x and item in x))


def test_line_columns_with_inner_names_stay(spark):
    rows = [(i, "s", f"Own line {i}.\nCommon line.", i, 2 * i) for i in range(8)]
    out = line_dedup.drop_boilerplate_lines(spark.createDataFrame(rows, "doc_id long, source string, text string, _host int, _common int"))
    assert {(r.doc_id, r._host, r._common, r.cleaned) for r in out.collect()} == {(i, i, 2 * i, f"Own line {i}.") for i in range(8)}
