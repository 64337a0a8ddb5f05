import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from trustweave.functions import fulltext, text, vectors


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(*columns).first()
    return row[0] if len(row) == 1 else tuple(row)


def test_sentences_and_tokens(spark):
    c = F.col("t")
    said = "Pay is due. Ask   who? 5 days apply. maybe."
    assert one(spark, text.sentences(c), t=said) == ["Pay is due.", "Ask who?", "5 days apply. maybe."]
    assert one(spark, text.sentences_capital(c), t=said) == ["Pay is due.", "Ask who? 5 days apply. maybe."]
    assert set(one(spark, text.content_tokens(c), t="The cost of 80% leave, cost")) == {"cost", "80%", "leave"}
    assert one(spark, text.sentences(c), t="  ") == []


def test_facts(spark):
    c = F.col("t")
    assert one(spark, text.numeric_facts(c), t="Within 5 working days, or 10 percent; 5 days, €98,000.") == ["5 days", "10 %", "€98.000"]
    units = one(spark, text.by_unit(text.numeric_facts(c)), t="5 days then 7 days and 2 weeks")
    assert units == {"days": "5", "weeks": "2"}


def test_contradictions(spark):
    a, b = (text.by_unit(text.numeric_facts(F.col(x))) for x in "ab")
    said = one(spark, text.contradictions(a, b), a="5 days", b="7 days")
    assert [tuple(x) for x in said] == [("days", "5", "7")]
    assert one(spark, text.contradictions(a, b), a="5 days after 2 years", b="7 days after 3 years") == []


def test_claims(spark):
    c = F.col("t")
    assert one(spark, text.asserts(c), t="It is 5 days.")
    assert not one(spark, text.asserts(c), t="Is it 5 days?")
    assert not one(spark, text.asserts(c), t="Is it so? It is 5 days")
    assert not one(spark, text.asserts(c), t="The old file says 100% is paid.") and not one(spark, text.asserts(c), t=" \n")
    assert one(spark, text.asserts(c), t="According to Ann. It is 5 days.")
    assert one(spark, text.non_answer(c), t="This guide does not determine the amount.") and one(spark, text.non_answer(c), t="Trips are not covered by this.")
    assert one(spark, text.says_stale(c), t="I have not checked this.") and not one(spark, text.says_stale(c), t="This page is no longer valid.")
    assert one(spark, text.title_stem(c), t="Leave Policy v2.1 (final) 2024") == "leave policy"


def test_key_facts_and_lead(spark):
    c = F.col("t")
    assert one(spark, text.facts(c), t="The run is charged. 5 working days, no exceptions.") == ["correction run cost=charged", "exceptions after cutoff=none", "5 days"]
    assert one(spark, text.by_unit(text.facts(c)), t="It is free of charge within 3 weeks") == {"correction run cost": "free", "weeks": "3"}
    lead = text.lead_sentence(text.content_tokens(F.col("q")), c)
    assert one(spark, lead, q="notice period length", t="Leave is long. The notice period is long. The notice period is 5 days.") == "The notice period is 5 days."


def test_similarity(spark):
    a, b = F.split("a", " "), F.split("b", " ")
    assert one(spark, text.jaccard(a, b), a="x y", b="y z") == 1 / 3
    assert one(spark, text.containment(a, b), a="x y", b="y x z") == 1.0
    assert one(spark, text.phrase_in(F.col("a"), F.col("b")), a="On leave.", b="leave")
    assert not one(spark, text.phrase_in(F.col("a"), F.col("b")), a="leaves", b="leave")


def test_hashed_embedding(spark):
    said = "Notice is 5 weeks notice"
    got = vectors.hashed_embeddings(spark.createDataFrame([(1, said), (2, "")], "k int, t string"), "k", "t").collect()
    want = np.zeros(768)
    tokens = re.findall("[a-z0-9€£%]+", said.lower())
    for g in tokens + [f"{x}_{y}" for x, y in zip(tokens, tokens[1:], strict=False)]:
        h = int(hashlib.md5(g.encode()).hexdigest(), 16)
        want[h % 768] += 1 if h >> 20 & 1 else -1
    got = {r.k: r.vector for r in got}
    assert np.allclose(got[1], want / np.linalg.norm(want)) and not any(got[2])


def test_stems():
    assert fulltext.stem("running") == "run" and fulltext.stem("policies") == fulltext.stem("policy")
