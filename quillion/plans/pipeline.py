"""The two ways through the engine: ingesting pages into chunks, and answering a batch of questions from documents."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion import models
from quillion.functions import text as X
from quillion.functions.vocabulary import SAMPLE_THESAURUS
from quillion.operators import cache, chunk, context, enrich, evaluate, expand, fuse, index, postings, rerank, retrieve, route, sections, verify
from quillion.operators import vectors as stored_vectors
from quillion.operators.stored_cache import StoredCache
from quillion.sources import html
from quillion.sources.shared import materialise


def ingest(pages: DataFrame, as_of: Column, id_col: str = "page_id", html_col: str = "html", filename: Column | None = None) -> DataFrame:
    """Chunks of pages: parsed, split into sections where they are marked, enriched and cut. One Arrow pass parses, one cuts."""
    read = html.parsed(pages, html_col).where("page.error is null")
    name = filename if filename is not None else F.concat(F.col(id_col).cast("string"), F.lit(".html"))
    docs = read.select(F.col(id_col).alias("id"), name.alias("filename"), html.document_text(F.col("page")).alias("text"), *html.metadata(F.col("page")))
    meta = docs.drop("text")
    marked = sections.split(docs, "id", "text").select("id", "section_num", "total_sections", "section_title", "prev_section_title", "next_section_title", "content", "doc_title", "doc_type", F.lit(False).alias("is_summary"))
    listed = sections.summaries(docs, "id", "text").withColumn("is_summary", F.lit(True))
    whole = docs.where(~F.col("text").rlike(sections.MARKER)).select("id", F.col("text").alias("content"), sections.doc_title(F.col("text")).alias("doc_title"))
    rows = marked.unionByName(listed, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True).join(meta, "id")
    content, length, has = F.coalesce("content", F.lit("")), F.length(F.coalesce("content", F.lit(""))), F.col("section_num").isNotNull()
    signal = enrich.signals(content, enrich.freshness(F.coalesce("modified_date", "created_date"), as_of))
    ids = enrich.chunk_ids(F.col("filename"), F.col("post_id"), F.col("section_num"), F.col("section_title"))
    rows = rows.withColumns(
        {
            "text_length": length,
            "chunk_size": enrich.chunk_size(length, has),
            "chunk_overlap": enrich.chunk_overlap(length, has),
            "reliability_score": enrich.reliability(signal),
            "reliability_signals": F.struct(*(v.alias(k) for k, v in signal.items())),
            "auto_categories": enrich.categories(content),
            "category_string": F.array_join(enrich.categories(content), " "),
            "information_density": enrich.density(content),
            "chunk_size_kb": length / 1024,
            "type": enrich.row_type(F.col("doc_type"), F.col("is_summary")),
            **ids,
        }
    )
    keep = [c for c in rows.columns if c != "content"]
    return chunk.chunked(rows, keep, "content", base_id="child_id")


@dataclass(frozen=True)
class Settings:
    """What stays the same for all questions of a run."""

    embedding_model: str = "hashing"
    embed: models.Embedder | None = None
    generate: models.Generator = models.extractive
    #: Makes variants of vague questions, one a line; none by default.
    rewrite: Callable[[str], str] | None = None
    thesaurus: dict[str, list[str]] = field(default_factory=lambda: dict(SAMPLE_THESAURUS))
    generation_model: str = "extractive"
    corpus_build_id: str = ""
    dynamic_k: bool = True
    top_k: int = 6
    weights: tuple[float, float] = (0.5, 0.5)
    now: float = 0.0
    ttl_seconds: float | None = None
    #: Stored indexes of the corpus: of words (``okapi`` or ``plus1``), and of ``corpus_vectors``. Without them the corpus
    #: is tokenised and embedded for each batch of questions.
    lexical: postings.StoredIndex | None = None
    vectors: stored_vectors.VectorIndex | None = None

    def cache_key(self, question: Column) -> Column:
        return cache.key(question, cache.namespace(F.lit(self.generation_model), F.lit(self.embedding_model), F.lit(self.corpus_build_id)))


#: A stored answer: what ``to_cache`` makes and ``ask_batch`` looks up; sources and metadata are JSON.
CACHE_SCHEMA = "query_hash string, query string, response string, sources string, metadata string, timestamp double, top_k int, entry_id long"
SOURCE = "struct<source_url:string,title:string,category:string,post_id:string,content_preview:string,rerank_score:double>"
DEBUG = "struct<query:string,mode:string,vector_docs:bigint,bm25_docs:bigint,fused_docs:bigint,weights:array<double>>"
CHECK = "struct<has_hallucinations:boolean,confidence_score:double,hallucinated_claims:array<string>,supported_claims:array<string>,unclear_claims:array<string>,summary:string>"
METADATA = f"struct<top_k:int,dynamic_k_used:boolean,retrieval_mode:string,use_hybrid:boolean,num_sources:int,retrieval_debug:array<{DEBUG}>,hallucination_check:{CHECK},confidence:double,action:string,cache_hit:boolean,corpus_build_id:string,error:string>"
NO_DOCUMENTS = "Aucun document pertinent trouvé pour cette question."


def _variants(spark: SparkSession, q: DataFrame, settings: Settings) -> DataFrame:
    """(vid, q, variant_no, query, k): each question, then as many of its variants as its route asks for; blank ones go."""
    own = q.select("q", F.lit(0).alias("variant_no"), F.col("question").alias("query"), "k")
    routed = q.select("q", "k", "question", route.expansion(F.col("question")).alias("most")).where("most > 0")
    extra = None
    if settings.rewrite is not None:
        extra = expand.by_model(routed.where("most = 2"), settings.rewrite, "q", "question")
    made = expand.variants(routed, expand.thesaurus(spark, settings.thesaurus), "q", "question", extra)
    more = made.join(routed.select("q", "k", "most"), "q").where((F.col("variant_no") <= F.col("most")) & (X.strip("variant") != ""))
    every = own.unionByName(more.select("q", F.col("variant_no").cast("int"), F.col("variant").alias("query"), "k"))
    return materialise(every.withColumn("vid", F.monotonically_increasing_id()), "queries")


def corpus_vectors(corpus: DataFrame, settings: Settings) -> DataFrame:
    """(id, v) of the corpus (d, content): what a stored vector index for these settings is built from."""
    hold = models.prefixes(settings.embedding_model)[1]
    return models.embedded(corpus, "content", settings.embed or models.hashing_embedder(), hold).select(F.col("d").alias("id"), retrieve.doubles(F.col("embedding")).alias("v"))


def _retrieved(corpus: DataFrame, queries: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(q, d, arrival, similarity_score) of what is found by all of a question's queries, and (q, retrieval_debug)."""
    embed = settings.embed or models.hashing_embedder()
    ask = models.prefixes(settings.embedding_model)[0]
    k = F.col("k")
    small = queries.select("vid", "q", "variant_no", "query", "k")
    if settings.lexical is not None:
        lexical = settings.lexical.search(queries, 20, "vid", "query", "d").join(small.select("vid", "k"), "vid")
    else:
        lexical = index.bm25_top(corpus, queries, 20, id_col="d", text_col="content", question_id="vid", question_col="query").join(small.select("vid", "k"), "vid")
    lexical = materialise(lexical.where(F.col("rank") <= F.least(F.greatest(3 * k, F.lit(6)), F.lit(20))).drop("k"), "lexical")
    asked = models.embedded(queries, "query", embed, ask).select(F.col("vid").alias("query_id"), retrieve.doubles(F.col("embedding")).alias("q"))
    if settings.vectors is not None:
        near = settings.vectors.search(materialise(asked, "asked").select(F.col("query_id").alias("id"), "q"), 30, "id", "q", same=False)
    else:
        near = retrieve.nearest(materialise(corpus_vectors(corpus, settings), "vectors"), materialise(asked, "asked"), 30, same=False)
    near = near.select(F.col("query_id").alias("vid"), F.col("id").alias("d"), F.round("distance", 6).alias("distance")).join(small.select("vid", "k"), "vid")
    near = index.top_k(near, "vid", F.least(F.greatest(4 * k, F.lit(8)), F.lit(30)), "d", "distance", descending=False)
    near = materialise(near.withColumn("similarity_score", models.similarity_of(F.col("distance"))).drop("k"), "nearest")
    fused = fuse.rrf(near, lexical, "vid", "d", 12, settings.weights).join(small, "vid")
    fused = materialise(fused.where(F.col("rank") <= F.least(3 * k, F.lit(12))), "fused")
    found = fuse.first_arrivals(fused.select("q", "variant_no", "d", "rank", "similarity_score"), "q", "d").select("q", "d", "arrival", "similarity_score")
    counts = [rows.groupBy("vid").agg(F.countDistinct("d").alias(n)) for rows, n in ((near, "vector_docs"), (lexical, "bm25_docs"), (near.select("vid", "d").unionByName(lexical.select("vid", "d")), "fused_docs"))]
    told = small
    for c in counts:
        told = told.join(c, "vid", "left")
    hybrid = F.coalesce("bm25_docs", F.lit(0)) > 0
    one = F.struct(
        "variant_no", "query", F.when(hybrid, "rrf").otherwise("vector").alias("mode"), F.coalesce("vector_docs", F.lit(0)).alias("vector_docs"), F.coalesce("bm25_docs", F.lit(0)).alias("bm25_docs"),
        F.when(hybrid, F.col("fused_docs")).alias("fused_docs"), F.when(hybrid, F.array(*(F.lit(w) for w in settings.weights))).alias("weights"),
    )
    debug = told.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("variant_no")).cast(f"array<{DEBUG}>").alias("retrieval_debug"))
    return found, debug


def _checked(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, confidence, hallucination_check, supported_claims) of every answer."""
    found = materialise(verify.verdicts(answers, sources), "verdicts")
    sure = verify.confidence(answers, sources, found)
    listed = found.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("claim_no", "verdict", "claim"))).alias("v"))
    of = lambda verdict: F.transform(F.filter(F.coalesce("v", F.array().cast("array<struct<claim_no:int,verdict:string,claim:string>>")), lambda x: x["verdict"] == verdict), lambda x: x["claim"])
    out = sure.join(listed, "answer_id", "left")
    summary = F.concat_ws(", ", *(F.concat(F.col(v).cast("string"), F.lit(" "), F.lit(v)) for v in ("supported", "unclear", "hallucinated")))
    check = F.struct((F.col("hallucinated") > 0).alias("has_hallucinations"), F.col("confidence").alias("confidence_score"), of("hallucinated").alias("hallucinated_claims"), of("supported").alias("supported_claims"), of("unclear").alias("unclear_claims"), summary.alias("summary"))
    return out.select("answer_id", "confidence", check.cast(CHECK).alias("hallucination_check"), of("supported").alias("supported_claims"))


def ask_batch(docs: DataFrame, questions: DataFrame, settings: Settings = Settings(), stored: DataFrame | StoredCache | None = None, id_col: str = "doc_id", text_col: str = "text", question_id: str = "item_id", question_col: str = "text") -> DataFrame:
    """(question id, question, answer, sources, metadata): one row for every question.

    A question is answered from ``stored`` (of ``CACHE_SCHEMA``, a table or a stored cache, of which only the questions'
    buckets are read) if its key is there and not too old. Any other is routed
    (how many results, how many variants), each variant is searched by words and by vectors and the two lists are fused;
    what all variants found comes in the order of first arrival, is reranked, packed, put into a prompt, answered and
    verified. Blank and too long questions, and those for which nothing is found, have a row with an error and no
    sources. Times of single steps have no meaning in a batch and are not given. Ids of documents are whole numbers.

    Questions are the small side of every join. What several later steps read is a table in shared storage, so that it
    is made once.
    """
    spark = docs.sparkSession
    every = questions.select(F.col(question_id).alias("q"), F.col(question_col).alias("question")).withColumn("query_hash", settings.cache_key(F.col("question")))
    every = route.validated(every).withColumnRenamed("error", "invalid")
    if isinstance(stored, StoredCache):
        stored = stored.matching(every) if stored.count() else None
    known = (stored if stored is not None else spark.createDataFrame([], CACHE_SCHEMA)).select("query_hash", "response", "sources", "metadata", "timestamp")
    every = cache.lookup(every, known, F.lit(settings.now), settings.ttl_seconds).withColumn("hit", F.col("hit") & F.col("invalid").isNull())
    every = materialise(every, "questions")
    k = route.dynamic_k(F.col("question")) if settings.dynamic_k else F.lit(settings.top_k)
    q = every.where("not hit and invalid is null").select("q", "question", k.cast("int").alias("k"))
    corpus = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("content"))
    found, debug = _retrieved(corpus, _variants(spark, q, settings), settings)
    rows = found.join(corpus, "d").join(q, "q").withColumn("filename", F.concat(F.col("d").cast("string"), F.lit(".html")))
    for name, kind in (("section_title", "string"), ("is_summary", "boolean"), ("reliability_score", "double"), ("source_url", "string"), ("category", "string")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("information_density", enrich.density(F.col("content")))
    best = rerank.top(rerank.score(rerank.with_question(rows)), "q", F.col("k"))
    best = best.select("q", "question", "k", "d", "rank", "content", "filename", "section_title", "source_url", "category", "rerank_score")
    packed = materialise(context.packed(best, "q"), "packed")
    title = F.replace(F.col("filename"), F.lit(".html"), F.lit(""))
    blocks = packed.withColumn("block", context.source_block(F.col("position"), title, F.lit("Unknown"), F.col("packed_text")))
    given = context.contexts(blocks, "q").join(q, "q").withColumn("prompt", context.prompt(F.col("question"), F.col("context")))
    answers = materialise(models.generated(given, "question", "prompt", settings.generate).select(F.col("q").alias("answer_id"), "response"), "answers")
    source = F.struct(*context.source_projection(packed)[:3], F.lit("").alias("post_id"), context.source_projection(packed)[3], F.col("rerank_score"))
    shown = packed.groupBy(F.col("q").alias("answer_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", source.alias("s")))), lambda x: x["s"]).cast(f"array<{SOURCE}>").alias("shown"))
    checked = _checked(answers, packed.select(F.col("q").alias("answer_id"), F.concat(F.lit("S"), F.col("position").cast("string")).alias("source_id"), "content"))
    done = answers.join(checked, "answer_id").join(shown, "answer_id").withColumnRenamed("answer_id", "q").withColumnRenamed("response", "generated")
    out = every.join(done, "q", "left").join(debug, "q", "left").join(q.select("q", "k"), "q", "left")
    answered = F.col("generated").isNotNull()
    metadata = F.struct(
        F.col("k").alias("top_k"), F.lit(settings.dynamic_k).alias("dynamic_k_used"), F.lit("similarity").alias("retrieval_mode"), F.lit(True).alias("use_hybrid"), F.coalesce(F.size("shown"), F.lit(0)).alias("num_sources"),
        F.col("retrieval_debug"), F.col("hallucination_check"), F.col("confidence"), F.when(answered, verify.action(F.col("confidence"))).alias("action"), F.lit(False).alias("cache_hit"), F.lit(settings.corpus_build_id).alias("corpus_build_id"),
        F.coalesce("invalid", F.when(~answered, F.lit("NO_RELEVANT_DOCS"))).alias("error"),
    ).cast(METADATA)
    kept = F.from_json("metadata", METADATA).withField("cache_hit", F.lit(True))
    answer = F.when(F.col("hit"), F.col("response")).when(answered, verify.final_answer(F.col("generated"), F.col("confidence"), F.col("supported_claims"))).when(F.col("invalid").isNull(), F.lit(NO_DOCUMENTS))
    sources = F.when(F.col("hit"), F.from_json("sources", f"array<{SOURCE}>")).otherwise(F.coalesce("shown", F.array().cast(f"array<{SOURCE}>")))
    return out.select(F.col("q").alias(question_id), "question", answer.alias("answer"), sources.alias("sources"), F.when(F.col("hit"), kept).otherwise(metadata).alias("metadata"))


def to_cache(answered: DataFrame, settings: Settings = Settings(), question_id: str = "item_id") -> DataFrame:
    """Rows of ``CACHE_SCHEMA`` of the accepted answers that don't come from the cache; of equal keys the largest question id's."""
    rows = answered.where("metadata.action = 'ACCEPT' and not metadata.cache_hit")
    rows = rows.select(
        settings.cache_key(F.col("question")).alias("query_hash"), X.query_key(F.coalesce("question", F.lit(""))).alias("query"), F.col("answer").alias("response"), F.to_json("sources").alias("sources"), F.to_json("metadata").alias("metadata"),
        F.lit(settings.now).alias("timestamp"), F.col("metadata.top_k").alias("top_k"), F.col(question_id).cast("long").alias("entry_id"),
    )
    return cache.latest(rows)


def evaluate_batch(docs: DataFrame, questions: DataFrame, settings: Settings = Settings(), stored: DataFrame | StoredCache | None = None, by: list[str] | None = None, **columns) -> tuple[DataFrame, DataFrame]:
    """A run over a question set: (each question's outcome and metrics, summary by the question columns ``by``).

    ``seconds`` is the run's time by the clock shared evenly among its questions, as they are answered together.
    """
    question_id = columns.get("question_id", "item_id")
    began = time.monotonic()
    rows = materialise(ask_batch(docs, questions, settings, stored, **columns), "run")
    seconds = (time.monotonic() - began) / max(1, rows.count())
    m = F.col("metadata")
    outcome = evaluate.outcome(m["error"].isNull(), F.when(m["error"].isNull(), 200), m["error"])
    each = rows.select(question_id, "question", outcome.alias("outcome"), m["num_sources"].alias("num_sources"), m["confidence"].alias("confidence"), m["top_k"].alias("top_k"), m["action"].alias("action"), m["cache_hit"].alias("cache_hit"), F.lit(seconds).alias("seconds"))
    kept = questions.select(question_id, *(by or []))
    joined = each.join(kept, question_id).withColumn("success", F.col("outcome.success"))
    return each, evaluate.summary(joined, by or [])


def compare_embedders(docs: DataFrame, questions: DataFrame, embedders: dict[str, models.Embedder], settings: Settings = Settings(), **columns) -> DataFrame:
    """The same questions asked with each embedder: (embedder, question id, num_sources, confidence, top_k, action)."""
    question_id = columns.get("question_id", "item_id")
    out = None
    for name, embed in embedders.items():
        m = F.col("metadata")
        rows = ask_batch(docs, questions, replace(settings, embed=embed, embedding_model=name), **columns)
        rows = rows.select(F.lit(name).alias("embedder"), question_id, m["num_sources"].alias("num_sources"), m["confidence"].alias("confidence"), m["top_k"].alias("top_k"), m["action"].alias("action"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no embedder")
    return out


def probe(docs: DataFrame, texts: list[str], settings: Settings = Settings(), k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query, rank, id, distance, preview): the k nearest documents of a few texts, embedded without prefixes, to see whether an index is sound."""
    spark, embed = docs.sparkSession, settings.embed or models.hashing_embedder()
    corpus = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    vectors = models.embedded(corpus, "content", embed).select("id", retrieve.doubles(F.col("embedding")).alias("v"))
    near = retrieve.nearest(materialise(vectors, "vectors"), models.embedded(asked, "query", embed).select("query_id", retrieve.doubles(F.col("embedding")).alias("q")), k, same=False)
    best = index.top_k(near.withColumn("distance", F.round("distance", 6)), "query_id", k, "id", "distance", descending=False)
    return best.join(corpus, "id").join(asked, "query_id").select("query", "rank", F.col("id").alias(id_col), "distance", F.replace(F.left(F.coalesce("content", F.lit("")), F.lit(200)), F.lit("\n"), F.lit(" ")).alias("preview"))
