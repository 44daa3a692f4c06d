"""Named queries over the standard tables, one or more for each operator, run over whole tables.

Question sets are ``benchmark`` and the user's turns of ``conversations``; answers are the assistant's turns, each with
the turn before it as its source. Vector searches ask with every vector whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion import models
from quillion.functions import text as X
from quillion.functions.vocabulary import SAMPLE_THESAURUS, TAXONOMY
from quillion.operators import cache, chunk, context, enrich, evaluate, expand, fuse, index, overlap, patterns, postings, rerank, retrieve, route, sections, tables, vectors, verify
from quillion.operators.stored_cache import StoredCache
from quillion.plans import pipeline
from quillion.sources import html
from quillion.sources.shared import fresh_path, materialise
from quillion.streaming import ingest as streaming

AS_OF = "2025-01-01 00:00:00"
#: Texts longer than this would be hashed rather than shown: results stay comparable and small.
K = 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, d):
    return _table(spark, d, "documents")


def _bench(spark, d):
    return _table(spark, d, "benchmark")


def _answers(spark, d) -> tuple[DataFrame, DataFrame]:
    """(answers, sources): assistant turns, and the turn before each as source S1."""
    turns = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    answers = turns.where("role = 'assistant'").select(name.alias("answer_id"), F.col("text").alias("response"), "conv_id", "turn")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("content"))
    sources = answers.select("answer_id", "conv_id", "turn").join(before, ["conv_id", "turn"]).select("answer_id", F.lit("S1").alias("source_id"), "content")
    return answers.select("answer_id", "response"), sources


def text_fold(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, d).select("doc_id", F.md5(X.fold(t)).alias("folded_md5"), F.md5(X.query_key(t)).alias("key_md5"), X.word_count(t).cast("long").alias("n_words"))


def term_frequencies(spark, d):
    return index.term_frequencies(_docs(spark, d), "doc_id", index.bm25_tokens(F.col("text")))


def document_frequencies(spark, d):
    docs = _docs(spark, d)
    tokens = index.bm25_tokens(F.col("text"))
    found = index.document_frequencies(index.term_frequencies(docs, "doc_id", tokens), index.corpus_stats(docs, tokens))
    return found.select("term", "df", F.round("idf_tfidf", 6).alias("idf_tfidf"), F.round("idf_bm25", 6).alias("idf_bm25"))


def corpus_stats(spark, d):
    found = index.corpus_stats(_docs(spark, d), index.bm25_tokens(F.col("text")))
    return found.select("n_docs", "n_tokens", F.round("avg_length", 6).alias("avg_length"))


def _bm25(spark, d, variant):
    found = index.bm25_top(_docs(spark, d), _bench(spark, d), retrieve.bm25_fetch(K), variant)
    return found.select("item_id", "rank", "doc_id", "score", F.round("similarity_score", 6).alias("similarity_score"))


def bm25_topk(spark, d):
    return _bm25(spark, d, "plus1")


def bm25_okapi_topk(spark, d):
    return _bm25(spark, d, "okapi")


def _stored_index(spark, d, variant):
    stored = postings.StoredIndex(spark, fresh_path(spark, "index"))
    stored.build(_docs(spark, d), variant)
    return stored


def _stored_bm25(spark, d, variant):
    found = _stored_index(spark, d, variant).search(_bench(spark, d), retrieve.bm25_fetch(K))
    return found.select("item_id", "rank", "doc_id", "score", F.round("similarity_score", 6).alias("similarity_score"))


def stored_bm25_topk(spark, d):
    return _stored_bm25(spark, d, "plus1")


def stored_bm25_okapi_topk(spark, d):
    return _stored_bm25(spark, d, "okapi")


def index_pruning(spark, d):
    return _stored_index(spark, d, "plus1").pruning(_bench(spark, d), retrieve.bm25_fetch(K))


def _later(docs):
    """The corpus after a while: some documents are gone, some have other texts, some are new."""
    text = F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit("what is new here: "), F.col("text"))).otherwise(F.col("text"))
    return docs.where("doc_id % 17 <> 3").select("doc_id", text.alias("text")).unionByName(docs.where("doc_id % 11 = 1").select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))


def _updated_index(spark, d):
    stored, docs = _stored_index(spark, d, "plus1"), _docs(spark, d)
    stored.update(docs, _later(docs))
    return stored


def index_delta_frequencies(spark, d):
    return _updated_index(spark, d).part("terms").select("term", "df")


def index_delta_topk(spark, d):
    return _updated_index(spark, d).search(_bench(spark, d), retrieve.bm25_fetch(K)).select("item_id", "rank", "doc_id", "score")


def _vectors(spark, d):
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    return v, v.where("vec_id % 100 = 0")


def vector_topk(spark, d):
    return retrieve.vector_top(*_vectors(spark, d), retrieve.vector_fetch(K))


def _stored_vectors(spark, d):
    stored = vectors.VectorIndex(spark, fresh_path(spark, "vector-index"))
    stored.build(_vectors(spark, d)[0])
    return stored


def stored_vector_topk(spark, d):
    return _stored_vectors(spark, d).search(_vectors(spark, d)[1], retrieve.vector_fetch(K))


def vector_coverage(spark, d):
    return _stored_vectors(spark, d).coverage(_vectors(spark, d)[1], retrieve.vector_fetch(K))


def vector_cosine(spark, d):
    return retrieve.cosines(*_vectors(spark, d))


def similarity_threshold(spark, d):
    return retrieve.above_threshold(*_vectors(spark, d), threshold=0.4, k=retrieve.vector_fetch(K))


def mmr_topk(spark, d):
    return retrieve.mmr(*_vectors(spark, d), k=min(4 * K, 20))


def _rankings(spark, d):
    """Two rankings of the same questions: by the one and the other kind of BM25."""
    one = index.bm25_top(_docs(spark, d), _bench(spark, d), retrieve.vector_fetch(K), "okapi")
    two = index.bm25_top(_docs(spark, d), _bench(spark, d), retrieve.bm25_fetch(K), "plus1")
    return one, two


def rrf_fusion(spark, d):
    return fuse.rrf(*_rankings(spark, d), "item_id", "doc_id", retrieve.fused_limit(K))


def _halves(spark, d):
    """Three variants of each question: all of it, its first and its second half by words."""
    words = X.spaced_words(F.coalesce(F.col("text"), F.lit("")))
    q = _bench(spark, d).select("item_id", words.alias("w")).withColumn("h", F.expr("cast(size(w) div 2 as int)"))
    parts = F.array(F.array_join("w", " "), F.array_join(F.expr("slice(w, 1, h)"), " "), F.array_join(F.expr("slice(w, h + 1, size(w))"), " "))
    return q.select("item_id", F.posexplode(parts).alias("variant_no", "text")).withColumn("vid", F.col("item_id") * 10 + F.col("variant_no"))


def hybrid_fusion(spark, d):
    """A vector list and a lexical list: vectors' ids stand for documents', and the hundredths of the asking ones for questions'."""
    near = vector_topk(spark, d).select(F.expr("query_id div 100").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank", "similarity_score")
    return fuse.rrf(near, index.bm25_top(_docs(spark, d), _bench(spark, d), retrieve.bm25_fetch(K)), "item_id", "doc_id", retrieve.fused_limit(K))


def multi_query_dedupe(spark, d):
    q = _halves(spark, d)
    found = index.bm25_top(_docs(spark, d), q, retrieve.bm25_fetch(K), question_id="vid")
    rows = found.select((F.expr("vid div 10")).alias("item_id"), (F.col("vid") % 10).alias("variant_no"), "doc_id", "rank")
    return fuse.first_arrivals(rows, "item_id", "doc_id").select("item_id", "doc_id", "variant_no", "rank", "arrival")


def _candidates(spark, d):
    """Fused candidates with what reranking reads; metadata is made from the documents' columns."""
    fused = fuse.rrf(*_rankings(spark, d), "item_id", "doc_id", retrieve.fused_limit(K)).select("item_id", "doc_id", F.col("rank").alias("arrival"), "similarity_score")
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("content"), F.concat(F.col("source"), F.lit("_"), F.col("lang"), F.lit(".html")).alias("filename"), (F.col("doc_id") % 5 == 0).alias("is_summary"))
    rows = fused.join(docs, "doc_id").join(_bench(spark, d).select("item_id", F.col("text").alias("question")), "item_id")
    rows = rows.withColumn("section_title", F.get(F.split("content", "\n"), F.lit(0))).withColumn("information_density", enrich.density(F.col("content")))
    rows = rows.withColumn("reliability_score", enrich.reliability(enrich.signals(F.col("content"), F.lit(0.5))))
    return rerank.score(rerank.with_question(rows))


def rerank_score(spark, d):
    return _candidates(spark, d).select("item_id", "doc_id", F.round("metadata_score", 6).alias("metadata_score"), F.round(F.col("rerank_score") + 1e-9, 6).alias("rerank_score"))  # exact halves round alike in any engine


def rerank_topk(spark, d):
    return rerank.top(_candidates(spark, d), "item_id", K).select("item_id", "rank", "doc_id", "rerank_score")


def rerank_cross(spark, d):
    """The cross-encoder's raw score is stood in for by twenty times the keyword coverage less ten."""
    rows = _candidates(spark, d).withColumn("cross_encoder_raw", rerank.coverage(F.col("_keywords"), F.col("content")) * 20 - 10)
    return rerank.cross_top(rows, "item_id", K).select("item_id", "rank", "doc_id", "rerank_score")


def _questions(spark, d):
    return _table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def keyword_match(spark, d):
    m = route.matches(F.col("text"))
    return _questions(spark, d).select("conv_id", "turn", *(m[name].alias(name) for name in TAXONOMY))


def dynamic_topk(spark, d):
    return _questions(spark, d).select("conv_id", "turn", route.dynamic_k(F.col("text")).alias("k"))


def route_expansion(spark, d):
    return _questions(spark, d).select("conv_id", "turn", route.expansion(F.col("text")).alias("expansion"))


def request_validation(spark, d):
    return route.validated(_questions(spark, d), "text").select("conv_id", "turn", F.coalesce("error", F.lit("")).alias("error"))


def synonym_expand(spark, d):
    return expand.synonyms(_bench(spark, d), expand.thesaurus(spark, SAMPLE_THESAURUS), "item_id", "text")


def keyword_match_many(spark, d):
    """As ``keyword_match``, by one automaton over all words of the taxonomy."""
    asked = _questions(spark, d).select("conv_id", "turn", X.fold(F.coalesce("text", F.lit(""))).alias("folded"))
    return patterns.labelled(asked, "folded").drop("folded")


def synonym_expand_many(spark, d):
    """A thesaurus of a thousand terms: the documents' most frequent words of four letters or more, each with itself reversed."""
    words = _docs(spark, d).select(F.explode(F.split(F.lower("text"), " ")).alias("term")).where(F.col("term").rlike("^[a-z]{4,}$"))
    most = materialise(words.groupBy("term").count().orderBy(F.desc("count"), "term").limit(1000).select("term", F.reverse("term").alias("alternative")), "thesaurus")
    return expand.synonyms(_bench(spark, d), most, "item_id", "text")


def plural_expand(spark, d):
    ends = F.regexp_replace("text", r"[.?!\s]+$", "")
    return _bench(spark, d).select("item_id", F.explode(expand.plurals(ends)).alias("variant"))


def query_variants(spark, d):
    return expand.variants(_bench(spark, d), expand.thesaurus(spark, SAMPLE_THESAURUS), "item_id", "text")


def chunk_config(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    has = F.col("doc_id") % 2 == 0
    return _docs(spark, d).select("doc_id", enrich.chunk_size(n, has).alias("chunk_size"), enrich.chunk_overlap(n, has).alias("chunk_overlap"))


def size_category(spark, d):
    return evaluate.with_total(_docs(spark, d).select(enrich.size_category(F.length("text")).alias("category")), "category")


def _marked(spark, d):
    return _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n+-")).alias("text"))


def section_split(spark, d):
    found = sections.split(_marked(spark, d), "doc_id", "text")
    return found.select("doc_id", "section_num", "total_sections", "section_title", "prev_section_title", "next_section_title", F.md5("content").alias("content_md5"))


def section_summaries(spark, d):
    return sections.summaries(_marked(spark, d), "doc_id", "text").select("doc_id", "section_num", "total_sections", F.md5("content").alias("content_md5"))


def doc_type(spark, d):
    return _docs(spark, d).select("doc_id", sections.doc_type(F.col("text"), ("Apache", "MIT")).alias("doc_type"), sections.doc_title(F.col("text")).alias("doc_title"))


def enrich_documents(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, d).select("doc_id", F.round(enrich.reliability(enrich.signals(t, F.lit(0.5))), 6).alias("reliability_score"), F.array_join(enrich.categories(t), " ").alias("category_string"), F.round(enrich.density(t), 6).alias("information_density"), (F.length(t) / 1024).alias("chunk_size_kb"))


def freshness(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", enrich.freshness(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(AS_OF).cast("timestamp")).alias("freshness"))


def stable_ids(spark, d):
    ids = enrich.chunk_ids(F.concat(F.col("source"), F.lit(".html")), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 7), F.col("lang"))
    return _docs(spark, d).select("doc_id", ids["parent_id"].alias("parent_id"), ids["child_id"].alias("child_id"))


def doc_key(spark, d):
    odd = F.col("doc_id") % 2 == 1
    key = fuse.doc_key(F.when(odd, F.col("source")), F.when(odd, F.col("doc_id")), F.when(odd, F.col("lang")), F.lit(None).cast("int"), F.col("text"))
    return _docs(spark, d).select("doc_id", key.alias("doc_key"))


def html_title(spark, d):
    return html.parsed(_table(spark, d, "pages")).select("page_id", F.col("page.title").alias("title"))


def html_documents(spark, d):
    read = html.parsed(_table(spark, d, "pages"))
    text = html.document_text(F.col("page"))
    return read.select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"), F.size("page.images").alias("n_images"), *html.metadata(F.col("page")), F.coalesce("page.error", F.lit("")).alias("error"))


def _paragraphs(spark, d):
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return _docs(spark, d).select("doc_id", t.alias("content"), enrich.chunk_size(F.length(t), F.lit(False)).alias("chunk_size"), enrich.chunk_overlap(F.length(t), F.lit(False)).alias("chunk_overlap"))


def adaptive_chunks(spark, d):
    found = chunk.chunked(_paragraphs(spark, d), ["doc_id"])
    return found.select("doc_id", "chunk_index", "start_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"), "chunk_id")


def adaptive_chunks_sql(spark, d):
    """``adaptive_chunks`` as SQL text: a lateral join with a table function."""
    tables.register(spark)
    text = """SELECT d.doc_id, c.chunk_index, c.start_index, length(c.chunk) AS n_chars, md5(c.chunk) AS chunk_md5
        FROM {docs} d, LATERAL text_chunks(d.content, d.chunk_size, d.chunk_overlap) c"""
    return spark.sql(text, docs=_paragraphs(spark, d))


def section_split_sql(spark, d):
    """``section_split`` as SQL text: a table function over lines, partitioned by document."""
    tables.register(spark)
    lines = _marked(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    text = """SELECT CAST(id AS BIGINT) AS doc_id, section_num, total_sections, section_title, prev_section_title, next_section_title, md5(content) AS content_md5
        FROM marked_sections(TABLE(SELECT id, line_no, line FROM {lines}) PARTITION BY id ORDER BY line_no)"""
    return spark.sql(text, lines=lines)


def ingest_report(spark, d):
    return evaluate.ingest_report(_paragraphs(spark, d), chunk.chunked(_paragraphs(spark, d), ["doc_id"]), "content")


def ingest_pages(spark, d):
    found = pipeline.ingest(_table(spark, d, "pages").select("page_id", "html"), F.lit(AS_OF).cast("timestamp"))
    return found.select("id", "chunk_index", "start_index", "type", "text_length", "chunk_size", F.md5("chunk").alias("chunk_md5"), "parent_id", "chunk_id")


def sample_document(spark, d):
    """The first document on a subject: one row is the feature."""
    hit = F.lower("text").contains("apache") | F.lower("text").contains("repas")
    return _docs(spark, d).where(hit).orderBy("doc_id").limit(1).select("doc_id", X.preview(F.col("text")).alias("preview"))


def sentences(spark, d):
    turns = _table(spark, d, "conversations")
    return turns.select("conv_id", "turn", F.posexplode(X.sentences(F.coalesce("text", F.lit("")))).alias("sentence_no", "sentence"))


def claims(spark, d):
    answers, _ = _answers(spark, d)
    return answers.select("answer_id", F.posexplode(verify.claims(F.col("response"))).alias("claim_no", "claim"))


def sensitive_tokens(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(verify.sensitive_tokens(F.coalesce("text", F.lit(""))), "|").alias("tokens"))


def citations(spark, d):
    """Every fourth sentence is made to cite a source, as the texts cite none."""
    turns = _table(spark, d, "conversations")
    each = turns.select("conv_id", "turn", F.posexplode(X.sentences(F.coalesce("text", F.lit("")))).alias("n", "s"))
    cited = F.when(F.col("n") % 4 == 0, F.concat("s", F.lit(" [s"), F.col("n").cast("string"), F.lit("]"))).otherwise(F.col("s"))
    return each.select("conv_id", "turn", "n", F.array_join(verify.citations(cited), ",").alias("cited"))


def sentence_windows(spark, d):
    turns = _table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("sentences", X.sentences(F.col("text")))
    found = turns.withColumn("windows", verify.evidence_windows(F.col("text"), F.col("sentences")))
    return found.select("conv_id", "turn", F.posexplode("windows").alias("window_no", "window"))


def claim_verdicts(spark, d):
    return verify.verdicts(*_answers(spark, d)).select("answer_id", "claim_no", "verdict", "reason", "best_tfidf", "best_overlap")


def _shelved(spark, d) -> tuple[DataFrame, DataFrame]:
    """(claims, windows): sentences of 4 documents that stand together, and windows of the 4 documents before them as long evidence."""
    shelf = _docs(spark, d).select("doc_id", F.floor(F.col("doc_id") / 4).alias("shelf"), X.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    asked = shelf.select("doc_id", (F.col("shelf") - 1).alias("shelf"), F.posexplode("s").alias("sentence_no", "s"))
    held = shelf.select("shelf", F.explode(X.windows(F.col("s"))).alias("w"))
    return asked.select("shelf", "doc_id", "sentence_no", verify.overlap_words(F.col("s")).alias("words")), held.select("shelf", verify.overlap_words(F.col("w")).alias("words"))


def _long_overlap(spark, d) -> DataFrame:
    return overlap.best(*_shelved(spark, d), ["shelf"], ["doc_id", "sentence_no"])


def long_evidence_overlap(spark, d):
    return _long_overlap(spark, d).select("doc_id", "sentence_no", F.round("best_overlap", 6).alias("best_overlap"), "n_windows")


def overlap_pruning(spark, d):
    """How many pairs of claims and windows there are, and how many were compared."""
    return _long_overlap(spark, d).agg(F.count("*").alias("n_claims"), F.sum("n_windows").alias("n_pairs"), F.sum("n_compared").alias("n_compared"))


def answer_confidence(spark, d):
    answers, sources = _answers(spark, d)
    found = verify.confidence(answers, sources, materialise(verify.verdicts(answers, sources), "verdicts"))
    return found.withColumn("action", verify.action(F.col("confidence"))).withColumn("badge", verify.badge(F.col("confidence"), F.col("hallucinated")))


def embedding_verdicts(spark, d):
    found = verify.embedding_verdicts(*_answers(spark, d), models.hashing_embedder())
    return found.select("answer_id", "claim_no", "best", "verdict")


def embedding_confidence(spark, d):
    answers, sources = _answers(spark, d)
    return verify.embedding_confidence(answers, verify.embedding_verdicts(answers, sources, models.hashing_embedder()))


def embedding_claims(spark, d):
    answers, _ = _answers(spark, d)
    return answers.select("answer_id", F.posexplode(verify.embedding_claims(F.col("response"))).alias("claim_no", "claim"))


def context_pack(spark, d):
    rows = index.bm25_top(_docs(spark, d), _bench(spark, d), K).select("item_id", "doc_id", "rank").join(_docs(spark, d).select("doc_id", F.col("text").alias("content")), "doc_id")
    return context.packed(rows, "item_id").select("item_id", "position", "doc_id", F.length("packed_text").alias("n_chars"), F.md5("packed_text").alias("text_md5"))


def context_blocks(spark, d):
    block = context.source_block(F.col("doc_id") % 8 + 1, F.col("source"), F.col("lang"), F.coalesce("text", F.lit("")), F.col("source"), F.col("lang"), F.col("doc_id") % 3, F.lit(3))
    return _docs(spark, d).select("doc_id", F.md5(block).alias("block_md5"))


def source_projection(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("source_url"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("section_title"), F.concat(F.col("source"), F.lit("_x.html")).alias("filename"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("category"), F.col("text").alias("content"))
    return rows.select("doc_id", *context.source_projection(rows))


def _cache_rows(spark, d):
    q = _questions(spark, d)
    space = cache.namespace(F.lit("m"), F.lit("e"), F.lit("c"))
    return q.select(cache.key(F.col("text"), space).alias("query_hash"), (F.col("conv_id") * 60.0 + F.col("turn")).alias("timestamp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"))


def cache_upsert(spark, d):
    return cache.latest(_cache_rows(spark, d))


def cache_lookup(spark, d):
    rows = _cache_rows(spark, d)
    now = rows.agg(F.max("timestamp").alias("now"))  # one row
    asked = rows.select(F.col("entry_id").alias("asked"), "query_hash").crossJoin(F.broadcast(now))
    stored = cache.latest(rows.where("entry_id % 2 = 0"))
    return cache.lookup(asked, stored, F.col("now"), 6000.0).select("asked", "query_hash", "hit", "entry_id")


def cache_sweep(spark, d):
    rows = cache.latest(_cache_rows(spark, d))
    now = rows.agg(F.max("timestamp").alias("now"))
    return cache.swept(rows.crossJoin(F.broadcast(now)), F.col("now"), 6000.0).select("query_hash", "timestamp", "entry_id")


def _stored_cache(spark, rows: DataFrame) -> StoredCache:
    """A stored cache that got its entries in two commits; those of the second replace what they are newer than."""
    stored = StoredCache(spark, fresh_path(spark, "cache"), buckets=8)
    for part in (0, 1):
        stored.upsert(rows.where(F.pmod(F.xxhash64("entry_id"), F.lit(2)) == part))
    return stored


def stored_cache_upsert(spark, d):
    return _stored_cache(spark, _cache_rows(spark, d)).read()


def stored_cache_lookup(spark, d):
    rows = _cache_rows(spark, d)
    now = rows.agg(F.max("timestamp")).first()[0] or 0.0
    stored = _stored_cache(spark, rows.where("entry_id % 2 = 0"))
    return stored.lookup(rows.select(F.col("entry_id").alias("asked"), "query_hash"), F.lit(now), 6000.0).select("asked", "query_hash", "hit", "entry_id")


def stored_cache_sweep(spark, d):
    rows = _cache_rows(spark, d)
    stored = _stored_cache(spark, rows)
    now = rows.agg(F.max("timestamp")).first()[0] or 0.0
    stored.sweep(now, 6000.0)
    return stored.read().select("query_hash", "timestamp", "entry_id")


def eval_summary(spark, d):
    """A run is stood in for by turns: it succeeds if it has over 200 characters and takes a hundredth of a second each."""
    turns = _table(spark, d, "conversations").select("role", (F.length("text") > 200).alias("success"), (F.length("text") / 100.0).alias("seconds"))
    return evaluate.summary(turns, ["role"])


def ask_batch(spark, d):
    """Every third question is known to the cache; the last columns are its row's parts."""
    settings = pipeline.Settings(corpus_build_id="standard")
    known = _bench(spark, d).where("item_id % 3 = 0").select(settings.cache_key(F.col("text")).alias("query_hash"), F.lit("known").alias("response"), F.lit("[]").alias("sources"), F.lit('{"action": "ACCEPT"}').alias("metadata"), F.lit(0.0).alias("timestamp"), F.col("item_id").alias("entry_id"))
    found = pipeline.ask_batch(_docs(spark, d), _bench(spark, d), settings, cache.latest(known))
    m = F.col("metadata")
    return found.select("item_id", "question", "answer", F.size("sources").alias("n_sources"), m["cache_hit"].alias("cache_hit"), m["top_k"].alias("top_k"), F.size(m["retrieval_debug"]).alias("n_queries"), m["confidence"].alias("confidence"), m["action"].alias("action"), m["error"].alias("error"))


def probe(spark, d):
    """Two fixed searches, as when an index is looked over: the three nearest of each."""
    return pipeline.probe(_docs(spark, d), ["the first of them", "what is known"])


def embedder_comparison(spark, d):
    embedders = {f"hashing-{n}": models.hashing_embedder(n) for n in (32, 64)}
    return pipeline.compare_embedders(_docs(spark, d), _bench(spark, d), embedders)


def event_activity(spark, d):
    return streaming.activity(_table(spark, d, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        text_fold, term_frequencies, document_frequencies, corpus_stats, bm25_topk, bm25_okapi_topk, stored_bm25_topk, stored_bm25_okapi_topk,
        index_pruning, index_delta_frequencies, index_delta_topk, vector_topk, stored_vector_topk, vector_coverage, vector_cosine,
        similarity_threshold, mmr_topk, rrf_fusion, hybrid_fusion, multi_query_dedupe, rerank_score, rerank_topk, rerank_cross, keyword_match, keyword_match_many, synonym_expand_many,
        dynamic_topk, route_expansion, request_validation, synonym_expand, plural_expand, query_variants, chunk_config, size_category,
        section_split, section_summaries, doc_type, enrich_documents, freshness, stable_ids, doc_key, html_title, html_documents,
        adaptive_chunks, adaptive_chunks_sql, section_split_sql, ingest_report, ingest_pages, sample_document, sentences, claims, sensitive_tokens, citations,
        sentence_windows, claim_verdicts, long_evidence_overlap, overlap_pruning, answer_confidence, embedding_verdicts, embedding_confidence, embedding_claims, context_pack, context_blocks, source_projection,
        cache_upsert, cache_lookup, cache_sweep, stored_cache_upsert, stored_cache_lookup, stored_cache_sweep, eval_summary, ask_batch, probe, embedder_comparison, event_activity,
    )
}
