"""Searches against plain loops, and the kept index against one made anew."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trustweave.functions import fulltext, text
from trustweave.operators import ingest, search, search_index
from trustweave.streaming import ingest_stream

VOCAB = "policy policies travel travels traveling traveled cost costs review reviewing the of or and approved approve manager managers office offices e-mail running stopped falls 24 x9".split()


def stem(word):
    """The stem rule in plain Python."""
    if word in text.STOPWORDS:
        return None
    if len(word) <= 3:
        return word
    for ending, instead in fulltext.ENDINGS:
        if word.endswith(ending) and re.search("[aeiouy]", word[: -len(ending)]):
            word = word[: -len(ending)] + instead
            if ending in ("ing", "ed") and len(word) > 3 and word[-1] == word[-2] and word[-1] not in "lsz":
                word = word[:-1]
            break
    return word[:-1] + "i" if word.endswith("y") and len(word) > 3 else word[:-1] if word.endswith("e") and len(word) > 4 else word


def words(x):
    return re.findall("[a-z0-9]+", (x or "").lower())


def parsed(search_text):
    """Clauses as lists of (negated, [(place, stem)])."""
    out = [[]]
    for tok in re.findall(r'-?"[^"]*(?:"|$)|[^\s"]+', search_text or ""):
        if tok.lower() == "or":
            out.append([])
        else:
            item = [(i, stem(w)) for i, w in enumerate(words(tok)) if stem(w)]
            if item:
                out[-1].append((tok.startswith("-"), item))
    return [c for c in out if c]


def met(item, said):
    return any(all(p + i in said.get(s, ()) for i, s in item) for p in [q - item[0][0] for q in said.get(item[0][1], ())])


def brute(search_text, passage):
    """Cover density of a passage that meets the search, else None."""
    at = [stem(w) for w in words(passage)]
    said = {}
    for i, s in enumerate(at):
        if s:
            said.setdefault(s, set()).add(i)
    total, any_met = 0.0, False
    for clause in parsed(search_text):
        if all(met(item, said) != negated for negated, item in clause):
            any_met = True
            need = {s for negated, item in clause if not negated for _, s in item}
            last = {}
            for i, s in enumerate(at if need else []):
                if s in need:
                    last[s] = i
                    if len(last) == len(need):
                        start = min(last.values())
                        total += len(need) / (i - start + len(need))
                        last = {k: v for k, v in last.items() if v > start}
    return total if any_met else None


def random_search(draw):
    out = []
    for _ in range(draw.randint(1, 5)):
        kind = draw.random()
        tok = '"' + " ".join(draw.choices(VOCAB, k=draw.randint(1, 4))) + '"' if kind < 0.35 else draw.choice(VOCAB)
        out.append(("-" if draw.random() < 0.25 else "") + tok)
        if draw.random() < 0.3:
            out.append(draw.choice(["or", "OR"]))
    return " ".join(out) + draw.choice(["", "", ' "unclosed policy', " -", " or"])


def test_stems_match_the_rule(spark):
    draw = random.Random(1)
    made = ["".join(draw.choices("abeilosy", k=draw.randint(1, 8))) + draw.choice(["", *(e for e, _ in fulltext.ENDINGS), "y", "e", "nned", "lling"]) for _ in range(3000)] + VOCAB
    rows = spark.createDataFrame([(w,) for w in made], "w string").select("w", fulltext.english(F.col("w")).alias("s")).collect()
    assert all(r.s == stem(r.w) for r in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(8)
    texts = {i: " ".join(draw.choices(VOCAB, k=draw.choice([0, 1, 4, 12, 60]))) for i in range(120)} | {500: None, 501: "Policy!? TRAVEL, e-mail; cost-review"}
    return texts, spark.createDataFrame(list(texts.items()), "passage_id long, text string")


def test_random_searches_match_loops(spark, corpus):
    texts, passages = corpus
    draw = random.Random(3)
    asked = {i: random_search(draw) for i in range(80)} | {900: "", 901: None, 902: "the of", 903: "-policy", 904: "or or", 905: '"e-mail cost" or 24', 906: "unheard or -costs"}
    want = {(q, p): r for q, x in asked.items() for p, body in texts.items() if (r := brute(x, body)) is not None}
    searches = spark.createDataFrame(list(asked.items()), "question_id long, text string")
    got = {(r.question_id, r.passage_id): r["rank"] for r in search.ranked(searches, search.postings(passages), passages).collect()}
    assert set(got) == set(want) and len(want) > 500
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert search.ranked(searches.limit(0), search.postings(passages), passages).count() == 0
    assert search.ranked(searches, search.postings(passages.limit(0)), passages.limit(0)).count() == 0


def postings_of(texts):
    return {(s, i): tuple(p for p, w in enumerate(words(x)) if stem(w) == s) for i, x in texts.items() for s in {stem(w) for w in words(x)} - {None}}


def test_kept_index_equals_one_made_anew(spark, tmp_path):
    draw, folder, live = random.Random(4), str(tmp_path / "index"), {}
    for n in range(10):
        changed = {draw.randrange(40): " ".join(draw.choices(VOCAB, k=draw.choice([0, 3, 9]))) for _ in range(draw.choice([0, 5, 12]))}
        gone = draw.sample(range(40), draw.choice([0, 3]))
        make = lambda: search_index.update(
            spark, folder, n, spark.createDataFrame(list(changed.items()), "passage_id long, text string"), spark.createDataFrame([(g,) for g in gone], "passage_id long"), merge=4
        )
        make()
        if n in (2, 7):  # a batch that is repeated, a merging one among them
            make()
        live = {k: v for k, v in live.items() if k not in gone} | changed
        if n in (0, 3, 5, 9):
            rows = search_index.postings(spark, folder, n + 1, merge=4).collect()
            assert {(r.stem, r.passage_id): tuple(r.positions) for r in rows} == postings_of(live) and len(rows) == len(postings_of(live))
            assert {r[0] for r in search_index.passages(spark, folder, n + 1, merge=4).collect()} == set(live)
    assert sorted(x.name for x in (tmp_path / "index" / "postings").iterdir()) == ["4", "5", "6", "7", "8", "9", "base-4", "base-8"]  # what base-4 replaced is gone
    asked = {i: random_search(draw) for i in range(12)}
    want = {(q, p) for q, x in asked.items() for p, body in live.items() if brute(x, body) is not None}
    found = search_index.searched(spark, folder, 10, spark.createDataFrame(list(asked.items()), "question_id long, text string"), merge=4)
    assert {(r.question_id, r.passage_id) for r in found.collect()} == want


def test_only_buckets_of_the_searched_stems_are_read(spark, tmp_path, corpus):
    folder = str(tmp_path / "index")
    search_index.update(spark, folder, 0, corpus[1])
    one = spark.createDataFrame([("polici",)], "stem string")
    got = search_index.postings(spark, folder, 1, stems=one)
    assert {r.stem for r in got.collect()} == {"polici"}
    assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().executedPlan().toString() or "bucket#" in got._jdf.queryExecution().executedPlan().toString()


def test_index_follows_ingest(spark, tmp_path):
    folder = str(tmp_path / "index")
    unit = "id string, content_hash string, body string"
    first = spark.createDataFrame([("a", "1", "travel costs"), ("b", "1", "travel policy"), ("c", "1", "office")], unit)
    current = ingest.apply(first, spark.createDataFrame([], unit + ", status string"))
    search_index.follow(spark, folder, 0, ingest.classify(first, current.limit(0)))
    second = spark.createDataFrame([("a", "2", "office costs"), ("b", "1", "travel policy")], unit)
    judged = ingest.classify(second, current.withColumn("status", F.when(F.col("id") == "a", "retracted").otherwise("active")))
    search_index.follow(spark, folder, 1, judged, ingest.tombstones(current, second))
    rows = search_index.postings(spark, folder, 2, "string").collect()
    assert {(r.stem, r.passage_id) for r in rows} == {("travel", "b"), ("polici", "b")}


def test_index_follows_the_stream(spark, tmp_path):
    schema = "id string, content_hash string, body string, seq long"
    source = str(tmp_path / "in")
    rows = [[("a", "1", "travel costs", 1), ("b", "1", "office", 1)], [("a", "2", "office policy", 2), ("b", "1", "office", 2)]]
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        units = spark.readStream.schema(schema).parquet(source)
        ingest_stream.start(units, str(tmp_path / "docs"), str(tmp_path / "cp"), index=str(tmp_path / "index")).awaitTermination()
    got = search_index.postings(spark, str(tmp_path / "index"), 2, "string").collect()
    assert {(r.stem, r.passage_id) for r in got} == {("offic", "a"), ("polici", "a"), ("offic", "b")}


@pytest.mark.parametrize("sent", [200_000, 3])
def test_postings_of_wanted_stems(spark, corpus, monkeypatch, sent):
    texts, passages = corpus
    whole = search.postings(passages)
    monkeypatch.setattr(search, "SENT", sent)
    found = {(r.stem, r.passage_id): tuple(r.positions) for r in search.postings(passages).collect()}
    assert found == postings_of(texts) == {(r.stem, r.passage_id): tuple(r.positions) for r in whole.collect()}
    wanted = spark.createDataFrame([("polici",), ("cost",), ("offic",), ("review",), ("unheard",)], "stem string")
    few = {(r.stem, r.passage_id): tuple(r.positions) for r in search.postings(passages, wanted=wanted).collect()}
    assert few == {k: v for k, v in found.items() if k[0] in ("polici", "cost", "offic", "review")}
