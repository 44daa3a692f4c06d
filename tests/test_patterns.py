"""Many patterns at once: equal to looking for each term in each text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.functions import vocabulary
from quillion.operators import expand, patterns, route


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("shard_terms, empty", [(patterns.SHARD_TERMS, False), (4, True)])
def test_occurring_equals_brute_force(spark, monkeypatch, shard_terms, empty):
    monkeypatch.setattr(patterns, "MATCHES", 50)
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("abé") for _ in range(rng.randint(1, most)))
    terms = [word(4) for _ in range(30)] + ["a", "a", None] + ([""] if empty else [])
    texts = [(i, word(60), "x") for i in range(40)] + [(100, None, None), (101, "", "y"), (5, "ab", "twin"), (5, "ab", "twin"), (None, "abab", "z"), (102, "a" * 200_000, "long")]
    held = spark.createDataFrame(texts, "id long, text string, other string").repartition(3)
    found = patterns.occurring(held, "text", spark.createDataFrame([(t,) for t in terms], "term string"), shard_terms=shard_terms)
    want = [(*r, t) for r in texts if r[1] is not None for t in {t for t in terms if t is not None} if t in r[1]]
    assert found.columns == ["id", "text", "other", "term"] and rows(found) == sorted(want, key=str)


def test_occurring_of_nothing(spark):
    texts, terms = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a",)], "term string")
    assert patterns.occurring(texts, "text", terms.limit(0)).count() == 0
    assert patterns.occurring(texts.limit(0), "text", terms).count() == 0
    with pytest.raises(ValueError, match="term"):
        patterns.occurring(texts.withColumn("term", F.lit("")), "text", terms)


def test_labelled_equals_expressions(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["comment émettre un billet", "que faire ?", "", "Robot et SNCF", "rien", "galileo-sabre procédure"])], "id long, text string")
    folded = texts.withColumn("f", X.fold(F.col("text")))
    names = list(vocabulary.TAXONOMY)
    want = texts.select("id", *(c.alias(n) for n, c in route.matches(F.col("text")).items()))
    assert rows(patterns.labelled(folded, "f").select("id", *names)) == rows(want)
    own = patterns.labelled(spark.createDataFrame([(1, None), (2, "xy")], "id long, f string"), "f", {"p": ["x", ""], "q": ["z"], "none": []})
    assert rows(own) == [(1, None, None, None, None), (2, "xy", True, False, False)]


def test_thesaurus_of_a_thousand_terms_from_a_file(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({f"term{i}x": [f"other {i}", f"more {i}"] for i in range(1000)}))
    terms = vocabulary.load_thesaurus(str(tmp_path / "t.json"))
    asked = [(i, f"Is term{i}x like Term{i + 1}X?") for i in range(0, 999, 37)] + [(2000, None), (2001, "term")]
    found = expand.synonyms(spark.createDataFrame(asked, "q long, question string"), expand.thesaurus(spark, terms), "q")
    want = set()
    for q, text in asked:
        for term, alternatives in terms.items():
            if text and term in text.lower():
                for made in (text.lower().replace(term, a) for a in alternatives):
                    want |= {(q, made), (q, made[:1].upper() + made[1:].lower())}
    assert rows(found) == sorted(want, key=str)
