"""Best overlap by bounds against comparing all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillion.operators import overlap, verify


def _sets(seed, groups, count, vocabulary):
    made = random.Random(seed)
    common = [f"w{i}" for i in range(vocabulary)]
    draw = lambda: sorted(set(made.choices(common, weights=[1 / (i + 1) for i in range(vocabulary)], k=made.randint(0, 14))))
    return [(made.randint(0, groups - 1), draw()) for _ in range(count)]


def _jaccard(a, b):
    return len(a & b) / max(1, len(a | b)) if a else 0.0


@pytest.mark.parametrize("levels", [(0.5, 0.2, 0.0), (0.0,), (0.9, 0.6, 0.3, 0.1, 0.0)])
def test_equals_all_pairs_and_compares_fewer(spark, levels):
    windows = _sets(1, 3, 300, 60)
    windows += windows[:40]  # repeats
    asked = _sets(2, 4, 120, 70) + [(g, words[:-1]) for g, words in windows[:40]] + [(0, []), (0, ["nowhere"]), (3, ["w1"]), (None, ["w1"])]
    c = spark.createDataFrame([(g, i, words) for i, (g, words) in enumerate(asked)], "g long, i long, words array<string>")
    w = spark.createDataFrame([*windows, (None, ["w1"])], "g long, words array<string>")
    got = {r["i"]: r for r in overlap.best(c, w, ["g"], ["i"], levels).collect()}
    want = {i: [_jaccard(set(words), set(b)) for h, b in windows if h == g] for i, (g, words) in enumerate(asked)}
    assert {i: r["best_overlap"] for i, r in got.items()} == {i: max(all_) for i, all_ in want.items() if all_}
    assert all(r["n_windows"] == len(want[i]) and r["n_compared"] <= r["n_windows"] for i, r in got.items())
    pairs, compared = (sum(r[n] for r in got.values()) for n in ("n_windows", "n_compared"))
    assert compared < pairs * (0.9 if len(levels) == 1 else 0.5)


def test_levels_and_empty_tables(spark):
    c = spark.createDataFrame([(1, 1, ["a"])], "g long, i long, words array<string>")
    w = spark.createDataFrame([(1, ["a", "b"])], "g long, words array<string>")
    for levels in ((), (0.5,), (0.2, 0.5, 0.0)):
        with pytest.raises(ValueError):
            overlap.best(c, w, ["g"], ["i"], levels)
    assert overlap.best(c, w.where("false"), ["g"], ["i"]).count() == 0 and overlap.best(c.where("false"), w, ["g"], ["i"]).count() == 0


def test_verdicts_are_alike_for_short_and_long_evidence(spark):
    made = random.Random(3)
    words = [f"mot{i}" for i in range(80)]
    line = lambda n: "Le " + " ".join(made.choices(words, k=n)) + " est permis"
    windows = spark.createDataFrame([(g, "", line(9)) for g, n in (("a", 100), ("b", 5), ("c", 70)) for _ in range(n)], "answer_id string, evidence_key string, window string")
    claims = spark.createDataFrame([(g, "", i, line(6)) for g in "abcd" for i in range(12)], "answer_id string, evidence_key string, claim_no int, claim string")
    group = ["answer_id", "evidence_key"]
    rows = lambda long: verify.overlap_best(claims, windows, group, ["claim_no"], long).orderBy("answer_id", "claim_no").select("answer_id", "claim_no", F.col("best_overlap")).collect()
    assert rows(10**9) == rows(64) == rows(0) and len(rows(64)) == 36


def test_large_groups_are_cut_into_cells_and_pairs_are_never_shuffled(spark, monkeypatch):
    windows = _sets(4, 3, 200, 40) + [(1, ["w1", "w2"])] * 50 + [(1, [])] * 20
    asked = _sets(5, 4, 90, 50) + [(1, ["w2", "w1"]), (1, []), (2, ["nowhere"])]
    c = spark.createDataFrame([(g, 0, words) for g, words in asked] * 2, "g long, i long, words array<string>")  # ids that repeat
    w = spark.createDataFrame(windows, "g long, words array<string>")
    n = {g: sum(h == g for h, _ in windows) for g, _ in windows}
    want = sorted((g, max(_jaccard(set(words), set(b)) for h, b in windows if h == g), n[g]) for g, words in asked * 2 if g in n)
    whole = overlap.best(c, w, ["g"], ["i"])
    assert "Join" not in whole._jdf.queryExecution().toString()
    monkeypatch.setattr(overlap, "PAIRS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for df in (whole, overlap.best(c, w, ["g"], ["i"]), overlap.best(c, w, ["g"], ["i"], cell_words=60)):
            assert sorted(df.select("g", "best_overlap", "n_windows").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="unit separator"):
        overlap.best(spark.createDataFrame([(1, 1, ["a\x1fb"])], c.schema), w, ["g"], ["i"]).collect()
