"""Stored indexes: the same results as direct searches, fewer blocks read, updates that equal a rebuild."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillion.operators import index, postings, retrieve, vectors


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def corpus(spark):
    # word "rare" is frequent in few documents, "often" is in all; ids in one stretch hold the best
    texts = [(i, "often " * (1 + i % 3) + ("rare " * 9 if i < 40 else "rare " if i % 7 == 0 else "") + f"word{i % 50} filler " * 4) for i in range(3000)]
    texts += [(5000, None), (5001, ""), (5002, "often " * 400)]
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([(1, "rare often"), (2, "word7 rare"), (3, "absent"), (4, None), (5, "often often filler")], "item_id long, text string")


@pytest.mark.parametrize("variant", ["plus1", "okapi"])
def test_stored_index_equals_direct_search(spark, corpus, questions, tmp_path, variant):
    stored = postings.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.build(corpus, variant, shard_docs=1000)
    columns = ("item_id", "rank", "doc_id", "score")
    for k in (3, 25):
        assert rows(stored.search(questions, k), *columns) == rows(index.bm25_top(corpus, questions, k, variant), *columns)


def test_blocks_are_skipped_and_full(spark, corpus, questions, tmp_path):
    stored = postings.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.build(corpus, shard_docs=10_000)
    told = {r["item_id"]: (r["blocks"], r["read"]) for r in stored.pruning(questions, 3).collect()}
    assert set(told) == {1, 2, 5} and all(0 < read <= blocks for blocks, read in told.values())
    assert told[1][1] < told[1][0] / 2
    sizes = [r[0] for r in stored.part("blocks").where("term = 'often'").select(F.size("counts")).collect()]
    assert sum(sizes) == 3001 and max(sizes) == postings.BLOCK and sum(s < postings.BLOCK for s in sizes) == 1


def test_update_equals_rebuild(spark, corpus, questions, tmp_path):
    stored = postings.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.build(corpus, shard_docs=1000)
    text = F.when(F.col("doc_id") == 7, "rare rare and new").otherwise(F.col("text"))
    later = corpus.where("doc_id <> 11 AND doc_id <> 5002").withColumn("text", text).unionByName(spark.createDataFrame([(9000, "often unheard")], "doc_id long, text string"))
    assert stored.update(corpus, later) == {"inserted": 1, "changed": 1, "deleted": 2}
    whole = postings.StoredIndex(spark, f"file://{tmp_path}/whole")
    whole.build(later, shard_docs=1000)
    for name, columns in (("documents", ("d", "hash", "length")), ("terms", ("term", "df")), ("stats", ("n_docs", "n_tokens"))):
        assert rows(stored.part(name), *columns) == rows(whole.part(name), *columns)
    each = [postings._unpacked(x.part("blocks")) for x in (stored, whole)]
    assert rows(each[0], "term", "d", "count", "length") == rows(each[1], "term", "d", "count", "length")
    assert rows(stored.search(questions, 5), "item_id", "rank", "doc_id", "score") == rows(index.bm25_top(later, questions, 5), "item_id", "rank", "doc_id", "score")
    assert stored.update(later, later) == {"inserted": 0, "changed": 0, "deleted": 0}
    stored.table.restore()
    assert stored.part("terms").where("term = 'unheard'").count() == 1  # the version before the empty update


def test_empty_index(spark, questions, tmp_path):
    stored = postings.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.build(spark.createDataFrame([], "doc_id long, text string"))
    assert stored.search(questions, 3).count() == 0 and stored.stats()["n_docs"] == 0


def test_vector_index_is_exact_and_prunes(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 10
    made = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=16) * 0.1]) for i in range(1200)]
    made += [(2000, made[0][1]), (2001, made[0][1]), (3000, None), (3001, [float("nan")] * 16), (3002, [1.0]), (3003, [None] * 16)]
    held = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    asked = held.where("vec_id % 100 = 0")
    stored = vectors.VectorIndex(spark, f"file://{tmp_path}/vectors")
    stored.build(held, lists=20)
    columns = ("query_id", "rank", "vec_id", "distance", "similarity_score")
    want = rows(retrieve.vector_top(held, asked, 10), *columns)
    assert rows(stored.search(asked, 10, probes=1), *columns) == want
    near = {r[:3:2] for r in rows(stored.search(asked, 10, probes=2, exact=False), *columns)}
    assert len(near & {r[:3:2] for r in want}) >= 0.95 * len(want)
    read, lists = stored.coverage(asked, 10, probes=1).agg(F.sum("read"), F.sum("lists")).first()
    assert read <= 0.5 * lists


def test_more_neighbours_than_vectors(spark, tmp_path):
    held = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    stored = vectors.VectorIndex(spark, f"file://{tmp_path}/vectors")
    stored.build(held)
    assert rows(stored.search(held, 10), "query_id", "rank", "vec_id") == rows(retrieve.vector_top(held, held, 10), "query_id", "rank", "vec_id")


def test_vectors_with_holes_take_no_part(spark):
    made = [(i, [float(i), 0.0]) for i in range(5)] + [(10 + i, [float("nan"), 1.0]) for i in range(20)] + [(50, None), (51, [None, 1.0]), (52, [])]
    held = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    assert [r[0] for r in retrieve.vector_top(held, held.where("vec_id = 0"), 3).select("vec_id").collect()] == [1, 2, 3]


def test_questions_are_answered_alike_from_stored_indexes(spark, tmp_path):
    from dataclasses import replace

    from quillion.plans import pipeline

    texts = ["The red fox sleeps in the old barn near the river. It hunts at night and eats mice.", "A guide to the train: the ticket costs 25 euros.", "The barn is old. The river is wide."]
    docs = spark.createDataFrame([(i, t * 3) for i, t in enumerate(texts)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "where does the red fox sleep at night"), (2, " ")], "item_id long, text string")
    plain = pipeline.Settings()
    words = postings.StoredIndex(spark, f"file://{tmp_path}/words")
    words.build(docs)
    near = vectors.VectorIndex(spark, f"file://{tmp_path}/vectors")
    near.build(pipeline.corpus_vectors(docs.select(F.col("doc_id").alias("d"), F.col("text").alias("content")), plain), "id", "v")
    found = [sorted(map(str, pipeline.ask_batch(docs, questions, s).collect())) for s in (plain, replace(plain, lexical=words, vectors=near))]
    assert found[0] == found[1] and "red fox" in found[0][0]


def test_vector_search_passes_on_few_rows_a_query(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)  # no clusters: bounds leave most vectors open
    held = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(1500)], "vec_id long, embedding array<double>")
    asked = held.where("vec_id % 50 = 0")
    stored = vectors.VectorIndex(spark, f"file://{tmp_path}/vectors")
    stored.build(held, lists=12)
    made, write = [], vectors.materialise
    monkeypatch.setattr(vectors, "materialise", lambda df, tag: made.append(write(df, tag)) or made[-1])
    monkeypatch.setattr(vectors, "BLOCK", 100)  # lists of more are cut
    columns = ("query_id", "rank", "vec_id", "distance")
    assert rows(stored.search(asked, 5), *columns) == rows(retrieve.vector_top(held, asked, 5), *columns)
    assert made and all(df.count() <= 30 * 5 for df in made)


def test_lists_are_changed_where_they_are(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(postings, "UNPACKED", 2)  # lists go on from part to part
    made = [("a", 0, 1, [1, 1], [1, 2, 3]), ("a", 0, 9, [], [4]), ("a", 1, 2, [], []), ("a", 2, 5, [], [7]), ("b", 1, 4, [], []), ("b", 2, 4, [], [5]), ("c", 0, 6, [2], [1, 1]), ("c", 1, 6, [], []), ("c", 1, 8, [], [])]
    column = lambda i, kind: pa.array([m[i] for m in made], kind)
    zero, counts = pa.array([0] * len(made), pa.int32()), column(4, pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([zero, zero, column(0, pa.string()), column(1, pa.int32()), column(2, pa.int64()), column(3, pa.list_(pa.int64())), counts, counts], ["bucket", "shard", "term", "kind", "first", "gaps", "counts", "lengths"])
    got = [(r["term"], r["d"], r["count"]) for x in postings._merged([batch]) for r in x.to_pylist()]
    assert got == [("a", 1, 1), ("a", 3, 3), ("a", 5, 7), ("a", 9, 4), ("b", 4, 5)]


def test_shards_pass_on_few_rows_a_question(spark, corpus, tmp_path, monkeypatch):
    stored = postings.StoredIndex(spark, f"file://{tmp_path}/index")
    stored.build(corpus, shard_docs=1000)
    monkeypatch.setattr(postings, "ASKING", 8)  # questions in several slices
    asked = spark.createDataFrame([(i, f"often rare word{i}") for i in range(30)], "item_id long, text string")
    passed = stored._gone_through(asked, 3, "item_id", "text", index.K1, index.B, False)
    assert passed.count() <= 30 * stored.stats()["shards"] * (3 + postings.SPARE)
    columns = ("item_id", "rank", "doc_id", "score")
    assert rows(stored.search(asked, 3), *columns) == rows(index.bm25_top(corpus, asked, 3), *columns)
