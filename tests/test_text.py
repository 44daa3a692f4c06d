import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.functions.vocabulary import TAXONOMY, load_taxonomy


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], [*values]).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_fold_matches_unicode_decomposition(spark):
    texts = ["Émission  été À", "straße œuvre", "  a\tb ", "", "ÇÑ ÿ"]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(X.fold(F.col("t")).alias("x")).collect()]
    want = [" ".join("".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)).split()) for t in texts]
    assert got == want


def test_tokens_sentences_windows(spark):
    assert one(spark, X.tokens(F.lit("Le Café d'été, le x1_b AB"), 2, ["le"])) == ["café", "été", "x1_b"]
    assert one(spark, X.sentences(F.lit("- First sentence here. Short. Second one; and a third part!\n* bullet item line"))) == ["First sentence here", "Second one", "and a third part", "bullet item line"]
    assert one(spark, X.windows(F.array(*map(F.lit, ["a" * 20, "b" * 20, "c" * 5])))) == ["a" * 20 + " " + "b" * 20 + " " + "c" * 5]
    assert one(spark, X.word_count(F.lit("  a  b c "))) == 3
    assert one(spark, X.word_count(F.lit("   "))) == 0


def test_cut_escape_preview(spark):
    assert one(spark, X.cut_at_sentence(F.lit("aaaa. bbbb. cccc"), F.lit(13))) == "aaaa. bbbb...."
    assert one(spark, X.cut_at_sentence(F.lit("a.bbbbbbbbbbbb"), F.lit(10))) == "a.bbbbbbbb..."
    assert one(spark, X.cut_at_sentence(F.lit("short"), F.lit(10))) == "short"
    assert one(spark, X.escape_html(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    assert one(spark, X.preview(F.lit("x" * 201))) == "x" * 200 + "..."


def test_stable_id_drops_zero(spark):
    assert one(spark, X.stable_id(F.lit("a"), F.lit(0), F.lit(None).cast("string"))) == one(spark, F.md5(F.lit("a||")))


def test_taxonomy_file(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"broad": ["x"], "specific": "no list"}')
    found = load_taxonomy(str(path))
    assert found["broad"] == ["x"] and found["specific"] == TAXONOMY["specific"]
    assert load_taxonomy(str(tmp_path / "none.json")) == TAXONOMY


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), max_codepoint=0x2FF), max_size=30), min_size=1, max_size=5))
def test_fold_is_idempotent(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("f", X.fold(F.col("t"))).withColumn("g", X.fold(F.col("f"))).collect()
    assert all(r["f"] == r["g"] for r in rows)
