"""Large rule tables by automata against the regex form and plain loops."""

import collections
import random
import re

import pytest

from trustweave.operators import phrases, understand

TEXTS = "id long, text string"


@pytest.fixture(scope="module")
def draw():
    return random.Random(11)


@pytest.fixture(scope="module")
def texts(spark, draw):
    words = ["sick", "leave", "sick leave", "Pay", "24/7", "c++", "é", "über pay", "leaves", "a", "x-ray", "(a)", "\\E", "İ", "  "]
    rows = [(i, draw.choice([" ", "", "-"]).join(draw.choices(words, k=draw.randint(0, 9)))) for i in range(150)]
    return rows + [(3, rows[3][1]), (None, "sick leave"), (900, None), (901, "")]


@pytest.fixture(scope="module")
def table(draw):
    words = ["sick", "leave", "sick leave", "leave sick", "pay", "24/7", "4/", "c++", "é", "über", "eave", "a", "ray", "x-ray", "(a)", "\\e", "\\E", "k l", " "]
    return [(draw.randint(1, 9), draw.choice("ABCD"), draw.choice(words)) for _ in range(60)] + [(0, "Z", "")]


@pytest.mark.parametrize("part", [2_000_000, 40])
def test_large_tables_equal_the_regex_form(spark, texts, table, monkeypatch, part):
    rows = spark.createDataFrame(texts, TEXTS).repartition(3)
    rules = spark.createDataFrame(table, "priority int, code string, keyword string")
    asked = rows.withColumnsRenamed({"id": "question_id", "text": "question"})
    keywords = rules.select(rules.code.alias("topic"), "keyword")

    def all_of():
        got = [understand.first_hit(rows, rules, "else"), understand.most_hits(rows, rules), understand.most_hits(rows, rules, bounded=True), understand.topics(asked, keywords)]
        return [collections.Counter(repr(tuple(r)) for r in df.collect()) for df in got]

    small = all_of()
    monkeypatch.setattr(understand, "RULES", 5)
    monkeypatch.setattr(phrases, "PART", part)
    assert all_of() == small and all(len(x) > 5 for x in small)
    assert understand.first_hit(rows, table, "else").count() == len(texts)  # a list is as good as a table
    assert understand.topics(asked.limit(0), keywords).count() == 0


def test_a_large_table_against_loops(spark, draw, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 400_000)
    make = lambda k: " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 4))) for _ in range(k))
    table = {make(draw.randint(1, 2)) for _ in range(120_000)}
    rows = [(i, make(400)) for i in range(40)]
    got = phrases.met(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([(1, "c", k) for k in table], "priority int, code string, keyword string"))
    want = set()
    for i, x in rows:
        w = x.split()
        want |= {(i, k) for k in [*w, *map(" ".join, zip(w, w[1:], strict=False))] if k in table}
    found = [(r.id, r.keyword) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 2000
    assert all(re.search(rf"(?<![a-z]){k}(?![a-z])", rows[i][1]) for i, k in found[:50])
