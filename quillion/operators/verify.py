"""Verification of answers against their sources, claim by claim, in relational form.

answers: (answer_id, response). sources: (answer_id, source_id, content). Claims that the first steps can't settle are
compared with windows of sentences of their evidence: TF-IDF weights are rows (group, window, term), cosines are an
equi-join on the term, word overlap is made on arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillion.functions import text as X
from quillion.functions.vocabulary import CLAIM_PATTERNS, COMMON_NUMBERS, EMBEDDING_CLAIM_PATTERNS, OVERLAP_STOP_WORDS
from quillion.operators import overlap
from quillion.sources.shared import materialise

#: Patterns of tokens whose absence from the evidence refutes a claim.
SENSITIVE = (
    r"(?i)\b\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?\b",
    r"(?i)\b\d+(?:[.,]\d+)?\s?(?:%|eur|€|euros?)\b",
    r"\b\d{2,}\b",
    r"(?i)\b[A-Z][A-Z0-9]{2,}(?:-[A-Z0-9]+)?\b",
)
#: Letters beyond ASCII stand as underscores while tokens are looked for, so that they are parts of words there too.
BEYOND_ASCII = r"[^\x00-\x7F€\x{A0}«»…’]"
CITATION = r"(?i)\[(S\d+)\]"
#: Windows of one evidence from which on not every claim is compared with every window.
LONG_EVIDENCE = 64
SIMILAR, OVERLAP, FAR, APART, UNCLEAR_WEIGHT = 0.18, 0.35, 0.08, 0.15, 0.35


def claims(response: Column) -> Column:
    """Sentences that assert something; all sentences if none does."""
    every = X.sentences(F.coalesce(response, F.lit("")))
    kept = F.filter(every, lambda s: _any([F.lower(s).rlike(p) for p in CLAIM_PATTERNS]))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def citations(claim: Column) -> Column:
    return F.transform(F.regexp_extract_all(claim, F.lit(CITATION), F.lit(1)), F.upper)


def sensitive_tokens(text: Column) -> Column:
    """Dates, amounts, numbers and codes in order of pattern and place, distinct, without citations, plain words and common numbers."""
    masked = F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(text, BEYOND_ASCII, "_")).otherwise(text)
    plain = lambda t: (F.upper(t) != t) & t.rlike("[A-Za-z]") & ~t.rlike("[0-9]")
    kept = lambda t, cited: ~plain(t) & ~t.isin(COMMON_NUMBERS) & ~F.array_contains(cited, F.upper(t))
    # an array of one binds both, which each pattern, and a lambda over the tokens, would make again
    bound = F.array(F.struct(masked.alias("masked"), citations(text).alias("cited")))
    found = lambda x: F.concat(*(F.regexp_extract_all(x["masked"], F.lit(p), F.lit(0)) for p in SENSITIVE))
    return F.transform(bound, lambda x: F.array_distinct(F.filter(found(x), lambda t: kept(t, x["cited"]))))[0]


def overlap_words(text: Column) -> Column:
    return F.array_distinct(X.tokens(text, 3, OVERLAP_STOP_WORDS))


def evidence_windows(text: Column, sentences: Column) -> Column:
    """Windows of three of the text's sentences (a column, as they are read once for each window), or the whole text if there is none."""
    found = X.windows(sentences)
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def windows_of(evidence: DataFrame, group: list[str], text: str = "evidence") -> DataFrame:
    """(group, window_no, window) of each group's text, as ``evidence_windows`` has them: a sentence and the two behind it, read once."""
    cut = evidence.select(*group, F.posexplode(X.sentences(F.col(text))).alias("window_no", "s"))
    after = Window.partitionBy(*group).orderBy("window_no")
    made = cut.select(*group, "window_no", F.concat_ws(" ", "s", F.lead("s", 1).over(after), F.lead("s", 2).over(after)).alias("window")).where(F.length("window") > 30)
    whole = evidence.join(made.select(*group).distinct(), group, "left_anti").select(*group, F.lit(0).alias("window_no"), F.col(text).alias("window"))
    return made.unionByName(whole)


def tfidf_best(claims_: DataFrame, windows: DataFrame, group: list[str], claim_id: list[str]) -> DataFrame:
    """(claim ids, best_tfidf): each claim's largest cosine with a window of its group; claims without a positive one are absent.

    claims_: group, claim ids, claim. windows: group, window_no, window.
    """
    w = windows.select(*group, "window_no", X.tokens(F.col("window")).alias("t"))
    numbers = w.groupBy(*group).agg(F.count("*").alias("n"))
    tf = w.select(*group, "window_no", (F.size("t") + 1).alias("total"), F.explode("t").alias("term")).groupBy(*group, "window_no", "total", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy(*group, "term").agg(F.count("*").alias("df")).join(numbers, group).select(*group, "term", F.log(F.col("n") / (F.col("df") + 1)).alias("idf"))
    right = tf.join(idf, [*group, "term"]).select(*group, "window_no", "term", (F.col("tf") / F.col("total") * F.col("idf")).alias("wv"))
    c = claims_.select(*group, *claim_id, X.tokens(F.col("claim")).alias("t"))
    ctf = c.select(*group, *claim_id, (F.size("t") + 1).alias("total"), F.explode("t").alias("term")).groupBy(*group, *claim_id, "total", "term").agg(F.count("*").alias("tf"))
    left = ctf.join(idf, [*group, "term"]).select(*group, *claim_id, "term", (F.col("tf") / F.col("total") * F.col("idf")).alias("cv"))
    norms = lambda rows, keys, v: rows.groupBy(*keys).agg(F.sqrt(F.sum(F.col(v) * F.col(v))).alias(f"n_{v}"))
    dots = left.join(right, [*group, "term"]).groupBy(*group, *claim_id, "window_no").agg(F.sum(F.col("cv") * F.col("wv")).alias("dot"))
    both = dots.join(norms(left, [*group, *claim_id], "cv"), [*group, *claim_id]).join(norms(right, [*group, "window_no"], "wv"), [*group, "window_no"])
    cosine = F.when((F.col("n_cv") > 0) & (F.col("n_wv") > 0), F.col("dot") / (F.col("n_cv") * F.col("n_wv"))).otherwise(0.0)
    return both.groupBy(*group, *claim_id).agg(F.greatest(F.max(cosine), F.lit(0.0)).alias("best_tfidf"))


def overlap_best(claims_: DataFrame, windows: DataFrame, group: list[str], claim_id: list[str], long: int = LONG_EVIDENCE) -> DataFrame:
    """(group, claim ids, best_overlap): each claim's largest word overlap with a window of its group.

    Groups of up to ``long`` windows are compared whole; those of more go by bounds (``overlap.best``), with the same results.
    windows: a written table, as it is read more than once.
    """
    c = claims_.select(*group, *claim_id, overlap_words(F.col("claim")).alias("words"))
    w = windows.select(*group, overlap_words(F.col("window")).alias("words"))
    large = windows.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > long).select(*group)
    if large.isEmpty():
        return _compared(c, w, group, claim_id)
    large = materialise(large, "long_evidence")
    short = _compared(c.join(large, group, "left_anti"), w.join(large, group, "left_anti"), group, claim_id)
    far = overlap.best(c.join(large, group, "left_semi"), w.join(large, group, "left_semi"), group, claim_id)
    return short.unionByName(far.select(*group, *claim_id, "best_overlap"))


def _compared(claims_: DataFrame, windows: DataFrame, group: list[str], claim_id: list[str]) -> DataFrame:
    both = claims_.withColumnRenamed("words", "a").join(windows.withColumnRenamed("words", "b"), group)
    return both.groupBy(*group, *claim_id).agg(F.max(X.jaccard(F.col("a"), F.col("b"))).alias("best_overlap"))


def verdicts(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, claim_no, claim, verdict, reason, best_tfidf, best_overlap) of every claim of answers with source text."""
    packed = sources.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct(F.upper("source_id").alias("id"), F.coalesce("content", F.lit("")).alias("content")))).alias("s"))
    full = F.array_join(F.transform("s", lambda x: x["content"]), " ")
    packed = packed.withColumn("full", full).where(X.strip(F.col("full")) != "")
    c = answers.join(packed, "answer_id").select("answer_id", "s", "full", F.posexplode(claims(F.col("response"))).alias("claim_no", "claim"))
    c = c.withColumn("cited", F.sort_array(F.array_distinct(citations(F.col("claim")))))
    merged = X.strip(F.array_join(F.transform(F.filter("s", lambda x: F.array_contains(F.col("cited"), x["id"])), lambda x: x["content"]), " "))
    c = c.withColumn("cited_text", merged).withColumn("evidence", F.when(F.col("cited_text") != "", F.col("cited_text")).otherwise(F.col("full")))
    c = c.withColumn("low", F.lower("evidence")).withColumn("sensitive", sensitive_tokens(F.col("claim")))  # columns, as a lambda would make them again each time
    missing = F.filter("sensitive", lambda t: ~F.contains(F.col("low"), F.lower(t)))
    c = c.withColumn("missing", F.slice(missing, 1, 5)).withColumn("has_citation", F.size("cited") > 0)
    first = (
        F.when(F.contains(F.lower("full"), F.lower("claim")), F.when(F.col("has_citation"), "supported").otherwise("unclear:citation manquante"))
        .when(F.col("has_citation") & (F.col("cited_text") == ""), "hallucinated:citation inconnue")
        .when(F.size("missing") > 0, F.concat(F.lit("hallucinated:tokens absents: "), F.array_join("missing", ", ")))
    )
    c = c.withColumn("first", first).withColumn("evidence_key", F.when(F.col("cited_text") != "", F.array_join("cited", "+")).otherwise(""))
    open_ = c.where(F.col("first").isNull()).select("answer_id", "evidence_key", "claim_no", "claim", "evidence")
    group = ["answer_id", "evidence_key"]
    windows = materialise(windows_of(open_.select(*group, "evidence").distinct(), group), "windows")
    key = [*group, "claim_no"]
    tfidf, shared = tfidf_best(open_, windows, group, ["claim_no"]), overlap_best(open_, windows, group, ["claim_no"])
    c = c.join(tfidf, key, "left").join(shared, key, "left")
    c = c.withColumn("best_tfidf", F.when(F.col("first").isNull(), F.round(F.coalesce("best_tfidf", F.lit(0.0)), 6))).withColumn("best_overlap", F.when(F.col("first").isNull(), F.round(F.coalesce("best_overlap", F.lit(0.0)), 6)))
    t, o = F.col("best_tfidf"), F.col("best_overlap")
    then = F.when((t > SIMILAR) | (o > OVERLAP), F.when(F.col("has_citation"), "supported").otherwise("unclear:citation manquante")).when((t < FAR) & (o < APART), "hallucinated").otherwise("unclear")
    both = F.coalesce("first", then)
    return c.select("answer_id", "claim_no", "claim", F.split(both, ":")[0].alias("verdict"), F.regexp_extract(both, r"^[^:]*:(.*)$", 1).alias("reason"), "best_tfidf", "best_overlap")


def confidence(answers: DataFrame, sources: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, n_claims, supported, unclear, hallucinated, confidence, reason) of every answer."""
    text = sources.groupBy("answer_id").agg(F.count("*").alias("n_sources"), F.max(X.strip(F.coalesce("content", F.lit(""))) != "").alias("has_text"))
    n = found.groupBy("answer_id").agg(F.count("*").alias("n_claims"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("supported", "unclear", "hallucinated")))
    out = answers.select("answer_id", F.size(claims(F.col("response"))).cast("long").alias("total")).join(text, "answer_id", "left").join(n, "answer_id", "left")
    none, blank = F.col("n_sources").isNull(), ~F.coalesce("has_text", F.lit(False))
    counted = {v: F.coalesce(v, F.lit(0)).cast("long") for v in ("n_claims", "supported", "unclear", "hallucinated")}
    penalty = (counted["hallucinated"] + counted["unclear"] * UNCLEAR_WEIGHT) / F.greatest(counted["n_claims"], F.lit(1))
    value = F.when(none, 1.0).when(blank, 0.5).when(counted["n_claims"] == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - penalty))
    reason = F.when(none, "no sources").when(blank, "no source text").otherwise("")
    unclear = F.when(blank & ~none, F.col("total")).otherwise(counted["unclear"])
    return out.select("answer_id", counted["n_claims"].alias("n_claims"), counted["supported"].alias("supported"), unclear.alias("unclear"), counted["hallucinated"].alias("hallucinated"), F.round(value, 6).alias("confidence"), reason.alias("reason"))


def action(confidence_: Column) -> Column:
    return F.when(confidence_ < 0.25, "REJECT").when(confidence_ < 0.5, "WARN").otherwise("ACCEPT")


def final_answer(response: Column, confidence_: Column, supported: Column) -> Column:
    """The response, with a note if confidence is low, or a replacement with up to three supported claims."""
    listed = F.when(F.size(supported) > 0, F.array_join(F.transform(F.slice(supported, 1, 3), lambda c: F.concat(F.lit("- "), c)), "\n")).otherwise("Aucune information trouvée.")
    reject = F.concat(F.lit("Je ne peux pas répondre à cette question de manière fiable.\n\n**Informations trouvées dans les documents :**\n"), listed, F.lit("\n\n**Pour plus de détails, consultez directement les sources ci-dessous.**"))
    percent = F.floor(confidence_ * 100).cast("int").cast("string")
    warn = F.concat(response, F.lit("\n\n**[CONFIANCE FAIBLE - "), percent, F.lit("%]**\nConsultez les sources pour confirmation."))
    return F.when(action(confidence_) == "REJECT", reject).when(action(confidence_) == "WARN", warn).otherwise(response)


def badge(confidence_: Column, hallucinated: Column) -> Column:
    return F.when((confidence_ > 0.85) & (hallucinated == 0), "high").when(confidence_ > 0.65, "medium").otherwise("low")


def embedding_claims(response: Column) -> Column:
    """Sentences that assert something, as the verifier by embeddings cuts and knows them; all sentences if none does."""
    every = X.plain_sentences(F.coalesce(response, F.lit("")))
    kept = F.filter(every, lambda s: _any([F.lower(s).rlike(p) for p in EMBEDDING_CLAIM_PATTERNS]))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def embedding_confidence(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, n_claims, hallucinated, confidence) of every answer: the share of its claims that aren't hallucinated, 1 without claims."""
    n = found.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if(F.col("verdict") == "hallucinated").alias("hallucinated"))
    out = answers.select("answer_id").join(n, "answer_id", "left").na.fill(0, ["n_claims", "hallucinated"])
    share = (F.col("n_claims") - F.col("hallucinated")) / F.greatest("n_claims", F.lit(1))
    return out.withColumn("confidence", F.when(F.col("n_claims") == 0, 1.0).otherwise(F.round(share, 6)))


def embedding_verdicts(answers: DataFrame, sources: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(answer_id, claim_no, claim, best, verdict) by an injected embedder: below .25 hallucinated, else supported."""

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embed(text.fillna("").tolist())])

    c = answers.select("answer_id", F.posexplode(embedding_claims(F.col("response"))).alias("claim_no", "claim")).withColumn("v", vector("claim"))
    full = sources.groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("source_id", F.coalesce("content", F.lit("")).alias("content"))))["content"], " ").alias("full"))
    found = X.plain_sentences(F.col("full"))
    pieces = full.select("answer_id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.left("full", F.lit(1000))))).alias("piece")).withColumn("w", vector("piece"))
    from quillion.operators.retrieve import cosine

    best = c.join(pieces, "answer_id").groupBy("answer_id", "claim_no", "claim").agg(F.round(F.max(cosine(F.col("v"), F.col("w"))), 6).alias("best"))
    return best.withColumn("verdict", F.when(F.col("best") < 0.25, "hallucinated").otherwise("supported"))
