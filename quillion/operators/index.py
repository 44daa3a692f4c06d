"""Lexical indexes as tables: postings, document frequencies, lengths. BM25 in two forms, TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillion.functions import text as X
from quillion.functions.vocabulary import BM25_STOP_WORDS
from quillion.sources.shared import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of questions' terms (some 50 bytes each) up to which they are broadcast.
BROADCAST_TERMS = 200_000
#: Documents' tokens, and scores (one a question and document), of one task, about.
TASK_ROWS = 1_000_000


def term_frequencies(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """(id, term, tf)."""
    return docs.select(id_col, F.explode(tokens).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    return docs.select(id_col, F.size(tokens).cast("long").alias("length"))


def corpus_stats(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n_docs, n_tokens, avg_length."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("n_tokens")).withColumn("avg_length", F.col("n_tokens") / F.greatest("n_docs", F.lit(1)))


def document_frequencies(tf: DataFrame, n_docs: Column | DataFrame) -> DataFrame:
    """(term, df, idf_tfidf, idf_bm25) from postings."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_docs")
    df = df.crossJoin(n_docs.select("n_docs"))  # one row
    return df.select("term", "df", F.log(n / (F.col("df") + 1)).alias("idf_tfidf"), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf_bm25"))


def bm25_tokens(x: Column) -> Column:
    return X.tokens(x, 2, BM25_STOP_WORDS)


def tasks(spark: SparkSession, n_docs: int, n_tokens: int, n_questions: int) -> int:
    """Tasks that documents are dealt to, at least as many as run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-(n_tokens + n_docs * n_questions) // TASK_ROWS))


def bm25_scores(docs: DataFrame, questions: DataFrame, variant: str = "plus1", id_col: str = "doc_id", text_col: str = "text", question_id: str = "item_id", question_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(question id, id, score) of all documents that share a term with a question.

    ``plus1``: words without stop words, idf = ln((N - n + .5) / (n + .5) + 1), as the reranker's index. ``okapi``:
    white-space words as they are, idf = ln(N - n + .5) - ln(n + .5), negative ones replaced by a quarter of the mean,
    as the retriever's. A question's repeated terms count as often as they occur.

    One pass over the documents counts them, their tokens and the documents that hold each term. Another keeps the
    tokens that questions ask for and deals them out by document, once: term counts, scores and (in ``bm25_top``) the
    first choice of the k best are then made where a document's tokens are, so that a term that stands in most documents
    is spread over all tasks. There are as many tasks as ``TASK_ROWS`` asks for, so that what one holds doesn't grow with
    the corpus. The questions' terms are broadcast up to ``BROADCAST_TERMS`` rows.
    """
    cut = bm25_tokens if variant == "plus1" else X.spaced_words
    tokens = cut(F.coalesce(F.col(text_col), F.lit("")))
    wanted = questions.select(F.col(question_id).alias("q"), F.explode(cut(F.coalesce(F.col(question_col), F.lit("")))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    small = wanted.count() <= BROADCAST_TERMS
    hint = F.broadcast if small else lambda df: df
    rows = docs.select(F.col(id_col).alias("d"), tokens.alias("tokens"))
    # a row without a term for each document stands for the document itself
    held = rows.select(F.size("tokens").alias("length"), F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("term"))
    if variant == "plus1":  # only the questions' terms are counted
        terms = wanted.select("term", F.lit(True).alias("asked")).distinct()
        held = held.join(hint(terms), "term", "left").where("asked or term is null")
    counts = materialise(held.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("lengths")), "term-counts")
    stats = counts.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), (F.coalesce(F.sum("lengths"), F.lit(0)) / F.greatest(F.coalesce(F.sum("df"), F.lit(0)), F.lit(1))).alias("avg_length"))  # one row
    n, df = F.col("n_docs"), F.col("df")
    dfs = counts.where("term is not null").crossJoin(F.broadcast(stats))
    if variant == "plus1":
        dfs = dfs.select("term", "avg_length", F.log((n - df + 0.5) / (df + 0.5) + 1).alias("idf"))
    else:
        dfs = dfs.select("term", "avg_length", (F.log(n - df + 0.5) - F.log(df + 0.5)).alias("raw"))
        mean = dfs.agg(F.avg("raw").alias("mean"))  # one row
        dfs = dfs.crossJoin(F.broadcast(mean)).select("term", "avg_length", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    weights = materialise(wanted.join(dfs, "term"), "term-weights")
    asked = weights.select("term").distinct()
    found = rows.select("d", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).join(hint(asked), "term", "left_semi")
    about = counts.where("term is null").agg(F.sum("df"), F.sum("lengths")).first()
    tf = found.repartition(tasks(docs.sparkSession, about[0] or 0, about[1] or 0, wanted.select("q").distinct().count()), "d").groupBy("d", "length", "term").agg(F.count("*").alias("tf"))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length"))
    hits = tf.join(hint(weights), "term").select("q", "d", (F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("part"))
    return hits.groupBy("q", "d").agg(F.round(F.sum("part"), 6).alias("score")).select(F.col("q").alias(question_id), F.col("d").alias(id_col), "score")


def top_k(scored: DataFrame, by: str, k: Column | int, id_col: str, score: str = "score", descending: bool = True) -> DataFrame:
    """The k best of each group with ``rank``; ties go to the smaller id. Spark limits each partition's groups before the shuffle."""
    order = F.desc(score) if descending else F.asc(score)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order, F.asc(id_col))))
    return ranked.where(F.col("rank") <= k)


def rank_similarity(rank: Column) -> Column:
    """A similarity for results of which only the rank is known."""
    return F.greatest(F.lit(0.35), 1 - (rank - 1) * 0.05)


def bm25_top(docs: DataFrame, questions: DataFrame, k: int, variant: str = "plus1", **columns) -> DataFrame:
    question_id, id_col = columns.get("question_id", "item_id"), columns.get("id_col", "doc_id")
    found = top_k(bm25_scores(docs, questions, variant, **columns), question_id, k, id_col)
    return found.withColumn("similarity_score", rank_similarity(F.col("rank"))).withColumn("retrieval_source", F.lit("bm25"))
