import json
import math

import pytest
from pyspark.sql import functions as F

from quillion import models
from quillion.functions import vocabulary
from quillion.operators import cache, chunk, context, enrich, evaluate, expand, fuse, index, rerank, retrieve, route, sections, verify
from quillion.operators.stored_cache import StoredCache
from quillion.plans import pipeline
from quillion.sources import files, html


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma delta"), (3, "alpha gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "beta alpha")], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in index.bm25_scores(docs, q).collect()}
    n, avg = 3, 7 / 3
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda df, tf, length: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg))
    assert got == {1: pytest.approx(part(1, 2, 3) + part(2, 1, 3), abs=1e-6), 3: pytest.approx(part(2, 1, 2), abs=1e-6)}
    assert idf(1) == pytest.approx(math.log(2.5 / 1.5 + 1))


def test_rank_similarity_and_fetches(spark):
    got = [r["s"] for r in spark.createDataFrame([(r,) for r in (1, 5, 14, 20)], "rank int").select(F.round(index.rank_similarity(F.col("rank")), 6).alias("s")).collect()]
    assert got == [1.0, 0.8, 0.35, 0.35]
    assert [retrieve.vector_fetch(k) for k in (4, 6, 8)] == [16, 24, 30]
    assert [retrieve.bm25_fetch(k) for k in (4, 6, 8)] == [12, 18, 20]
    assert [retrieve.fused_limit(k) for k in (4, 6, 8)] == [12, 12, 12]


def test_rrf(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.4), (1, 11, 2, 0.9)], "q long, d long, rank int, similarity_score double")
    b = spark.createDataFrame([(1, 12, 1, 1.0), (1, 10, 2, 0.95)], "q long, d long, rank int, similarity_score double")
    rows = fuse.rrf(v, b, "q", "d", 12).orderBy("rank").collect()
    assert rows[0]["d"] == 10 and rows[0]["rrf_score"] == pytest.approx(0.5 / 61 + 0.5 / 62, abs=1e-8) and rows[0]["similarity_score"] == pytest.approx(0.487837, abs=1e-6)
    assert rows[0]["retrieval_source"] == "bm25+vector"
    none = fuse.rrf(v, b.limit(0), "q", "d", 1).collect()
    assert [(r["d"], r["rrf_score"]) for r in none] == [(10, None)]


def test_mmr_prefers_variety(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.05]), (2, [1.0, 0.06]), (3, [0.7, -0.7])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = values(retrieve.mmr(v, v.where("vec_id = 0"), k=2).orderBy("rank"), "vec_id")
    assert got == [(1,), (3,)]


def test_rerank_gates_and_fallback(spark):
    long = "Un texte assez long. " * 20
    rows = [(1, 1, "court", 0.9), (1, 2, "Veuillez consulter Whaller", 0.4), (1, 3, long, 0.29), (1, 4, long, 0.8)]
    df = spark.createDataFrame(rows, "q long, arrival int, content string, similarity_score double").withColumn("question", F.lit("assez texte bonjour"))
    for name, kind in (("filename", "string"), ("section_title", "string"), ("is_summary", "boolean"), ("reliability_score", "double"), ("information_density", "double")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    scored = rerank.score(rerank.with_question(df))
    got = dict(values(scored, "arrival", "rerank_score"))
    assert got[1] == 0.15 and got[2] == 0.60 and 0.10 < got[3] < got[4] <= 1
    best = rerank.top(scored.where("arrival = 1"), "q", 5)
    assert values(best, "arrival", "rank") == [(1, 1)]
    raw = spark.createDataFrame([(-10.0,), (0.0,), (10.0,), (30.0,)], "r double").select(rerank.cross_normalised(F.col("r")).alias("x"))
    assert [r["x"] for r in raw.collect()] == [0.0, 0.5, 1.0, 1.0]
    model = rerank.cross_scores(df, lambda pairs: [len(c) for _, c in pairs])
    assert dict(values(model, "arrival", "cross_encoder_raw"))[1] == 5.0


def test_routing(spark):
    qs = ["code robot", " ".join(["mot"] * 13), "bonjour", "probleme imprimante du bureau"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(qs)], "i int, t string").orderBy("i")
    assert [r["k"] for r in df.select(route.dynamic_k(F.col("t")).alias("k")).collect()] == [4, 8, 6, 6]
    assert [r["e"] for r in df.select(route.expansion(F.col("t")).alias("e")).collect()] == [0, 1, 1, 2]
    bad = spark.createDataFrame([("  ",), ("x" * 1001,), ("ok",)], "question string")
    assert [r["error"] for r in route.validated(bad).collect()] == ["empty", "too long", None]


def test_expansion(spark):
    q = spark.createDataFrame([(1, "Le guide")], "id long, question string")
    terms = expand.thesaurus(spark, {"guide": ["notice"]})
    assert values(expand.variants(q, terms, "id").orderBy("variant_no"), "variant") == [("Le guide",), ("Le notice",), ("le guides",), ("le notice",)]
    assert values(expand.by_model(q, lambda t: "short\nlong enough line\nanother long one\nthird line", "id"), "variant") == [("long enough line",), ("another long one",)]
    assert expand.by_model(q, lambda t: 1 / 0, "id").count() == 0


def test_enrich(spark):
    n = spark.createDataFrame([(x,) for x in (1499, 1500, 2999, 3000, 25000)], "n int")
    assert values(n.select(enrich.chunk_size(F.col("n"), F.lit(False)).alias("s"), enrich.chunk_overlap(F.col("n"), F.lit(False)).alias("o")), "s", "o") == [(0, 0), (600, 100), (600, 100), (800, 150), (1500, 300)]
    assert values(n.where("n = 3000").select(enrich.chunk_size(F.col("n"), F.lit(True)).alias("s"), enrich.chunk_overlap(F.col("n"), F.lit(True)).alias("o")), "s", "o") == [(680, 127)]
    as_of = F.lit("2025-01-01").cast("timestamp")
    ages = spark.createDataFrame([(i, a) for i, a in enumerate((364, 365, 1094, 1095, 1825, 2920))], "i int, a int").orderBy("i").select(F.date_format(F.date_sub(as_of.cast("date"), F.col("a")), "yyyy-MM-dd").alias("d"))
    assert [r["f"] for r in ages.select(enrich.freshness(F.col("d"), as_of).alias("f")).collect()] == [1, 0.8, 0.8, 0.6, 0.4, 0.3]
    odd = spark.createDataFrame([("",), ("x",), (None,)], "d string")
    assert [r["f"] for r in odd.select(enrich.freshness(F.col("d"), as_of).alias("f")).collect()] == [0.5, 0.5, 0.5]


def test_sections(spark):
    text = "Titre du document : Guide\n\n" + "intro " * 12 + "\n+-Un\nCorps un FQBB++-FIRST fin\n+-Deux\nCorps deux"
    docs = spark.createDataFrame([(1, text), (2, "no marker"), (3, None)], "id long, text string")
    rows = sections.split(docs, "id", "text").orderBy("section_num").collect()
    assert [r["section_title"] for r in rows] == ["Un", "FIRST fin", "Deux"]
    assert rows[0]["prev_section_title"] == "" and rows[1]["next_section_title"] == "Deux" and rows[2]["content"] == "Deux\n\nCorps deux"
    assert [r["section_title"] for r in sections.split(docs, "id", "text", anchored=True).orderBy("section_num").collect()] == ["Un", "Deux"]
    summary = sections.summaries(docs, "id", "text").collect()
    assert len(summary) == 1 and summary[0]["content"].startswith("Document: Guide\n\nSommaire:\n\nIntroduction :\nintro") and summary[0]["content"].endswith("\n\nSections :\n  1. Un\n  2. FIRST fin\n  3. Deux")


def test_chunks_cover_the_text():
    text = "\n\n".join(f"paragraph {i} " + "word " * (i % 7 * 10) for i in range(40))
    found = chunk.chunks(text, 200, 40)
    assert all(c["text"] == text[c["start_index"] : c["start_index"] + len(c["text"])] for c in found)
    covered = set()
    for c in found:
        covered.update(range(c["start_index"], c["start_index"] + len(c["text"])))
    assert all(text[i].isspace() for i in set(range(len(text))) - covered)
    assert chunk.chunks(text, 0, 0) == [{"text": text, "start_index": 0}] and chunk.chunks(None, 10, 1) == []
    assert chunk.chunks("aaa\n\nbbb\n\nccc", 9, 5) == [{"text": "aaa\n\nbbb", "start_index": 0}, {"text": "ccc", "start_index": 10}]  # 5 of overlap and 5 are above 9
    assert chunk.chunks("aaa\n\nbbb\n\nccc", 10, 5) == [{"text": "aaa\n\nbbb", "start_index": 0}, {"text": "bbb\n\nccc", "start_index": 5}]


def test_html():
    page = html.parse('<html><head><title>A <b>t</b></title><meta name="post-id" content=" 7 "><meta name="tags" content=""><style>x</style></head><body><p>Hi &amp; you</p><img alt="n"><img src="u"><script>y</script></body></html>')
    assert page["title"] == "A t" and page["meta"] == {"post_id": "7"} and page["images"] == [{"idx": 1, "alt": "n", "src": ""}, {"idx": 2, "alt": None, "src": "u"}]
    assert "Hi & you" in page["text"] and "x" not in page["text"].split("\n") and "y" not in page["text"].split("\n")


def test_html_documents(spark):
    rows = spark.createDataFrame([(1, "<title>T</title><p>Whaller Consulter</p><img src='s'>"), (2, None)], "id long, html string")
    text = html.parsed(rows).orderBy("id").select(html.document_text(F.col("page")).alias("t")).collect()
    assert text[0]["t"].startswith("Titre du document : T\n\nT\nWhaller Consulter") and html.REDIRECT_NOTE in text[0]["t"] and text[0]["t"].endswith("\nImage 1: Sans description\nURL: s\n")


def test_sensitive_tokens(spark):
    text = "Le 12/03/2024 payer 20 eur, vol ABC-12 code 24 25 2025 2023 Galileo [S12] S12 IATA"
    got = spark.createDataFrame([(text,)], "t string").select(verify.sensitive_tokens(F.col("t")).alias("x")).first()["x"]
    assert "12/03/2024" in got and "20 eur" in got and "ABC-12" in got and "IATA" in got and "25" in got and "2023" in got
    assert not {"24", "2025", "Galileo", "S12"} & set(got)


def test_verdicts_and_confidence(spark):
    source = "Le billet est valable deux ans après son achat. Il faut consulter la page du transporteur pour le modifier."
    claims = ["Le billet est valable deux ans après son achat [S1]", "Le billet est valable deux ans", "La règle est inconnue ici [S9]", "Le prix est de 4711 euros [S1]", "Il faut consulter la page du transporteur avant [S1]"]
    answers = spark.createDataFrame([("a", "\n".join(claims)), ("b", "Rien est dit"), ("c", "Tout est dit")], "answer_id string, response string")
    sources = spark.createDataFrame([("a", "S1", source), ("c", "S1", "  ")], "answer_id string, source_id string, content string")
    found = verify.verdicts(answers, sources)
    got = {r["claim"]: (r["verdict"], r["reason"]) for r in found.collect()}
    assert got[claims[1]] == ("unclear", "citation manquante") and got[claims[2]] == ("hallucinated", "citation inconnue")
    assert got[claims[3]][0] == "hallucinated" and "4711" in got[claims[3]][1] and got[claims[4]][0] == "supported"
    sure = {r["answer_id"]: r for r in verify.confidence(answers, sources, found).collect()}
    h, u, n = (sure["a"][c] for c in ("hallucinated", "unclear", "n_claims"))
    assert sure["a"]["confidence"] == pytest.approx(max(0, 1 - (h + 0.35 * u) / n), abs=1e-6)
    assert sure["b"]["confidence"] == 1.0 and sure["c"]["confidence"] == 0.5
    acts = spark.createDataFrame([(0.2499,), (0.25,), (0.4999,), (0.5,)], "c double").select(verify.action(F.col("c")).alias("a"))
    assert [r["a"] for r in acts.collect()] == ["REJECT", "WARN", "WARN", "ACCEPT"]


def test_context_budget(spark):
    texts = ["a" * 5000, "b. " * 600, "c" * 100]
    docs = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "q long, rank int, content string")
    got = [r["packed_text"] for r in context.packed(docs, "q").orderBy("position").collect()]

    def expected(budget=3000):
        total, out = 0, []
        for i, t in enumerate(texts):
            limit = max(1000, (budget - total) // (len(texts) - i))
            if len(t) > limit:
                head = t[:limit]
                dot = head.rfind(".")
                t = (head[: dot + 1] if dot > limit * 0.7 else head) + "..."
            out.append(t)
            total += len(t)
        return out

    assert got == expected()


def test_cache(spark):
    keys = spark.createDataFrame([("Été  à Paris ?",), ("ete a paris",)], "q string").select(cache.key(F.col("q"), F.lit("n")).alias("k")).collect()
    assert keys[0]["k"] == keys[1]["k"]
    rows = spark.createDataFrame([("h", 1.0, 1, "old"), ("h", 2.0, 2, "new"), ("g", 1.0, 3, "x")], "query_hash string, timestamp double, entry_id long, response string")
    latest = cache.latest(rows)
    assert dict(values(latest, "query_hash", "response")) == {"h": "new", "g": "x"}
    asked = spark.createDataFrame([("h",), ("g",), ("z",)], "query_hash string")
    assert dict(values(cache.lookup(asked, latest, F.lit(10.0), 8.5), "query_hash", "hit")) == {"h": True, "g": False, "z": False}
    assert cache.swept(latest, F.lit(10.0), 0).count() == 2 and cache.cleared(latest)[1] == 2
    assert values(cache.misses(asked, latest), "query_hash") == [("z",)]


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_text("<p>é</p>")
    (tmp_path / "in" / "sub" / "b.htm").write_bytes(b"\xff\xfe")
    (tmp_path / "in" / "c.txt").write_text("no")
    assert sorted(values(files.html_files(spark, str(tmp_path / "in")), "filename", "html"), key=str) == [("a.html", "<p>é</p>"), ("b.htm", None)]
    (tmp_path / "q.json").write_text(json.dumps([{"category": "c", "questions": ["a", "b"]}]))
    assert values(files.question_set(spark, str(tmp_path / "q.json")), "category", "question") == [("c", "a"), ("c", "b")]
    assert files.corpus_version(spark, str(tmp_path / "none")) == "missing-corpus"
    assert files.corpus_version(spark, str(tmp_path / "in")) == files.corpus_version(spark, str(tmp_path / "in"))
    table = files.VersionedTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(3))
    table.replace(spark.range(5))
    assert table.count() == 5
    table.restore()
    assert table.count() == 3


def test_evaluation(spark):
    rows = spark.createDataFrame([("x", True, 1.0), ("x", False, 3.0)], "g string, success boolean, seconds double")
    r = evaluate.summary(rows, ["g"]).first()
    assert (r["n_questions"], r["success_pct"], r["mean_seconds"]) == (2, 50.0, 2.0)


# --- from question to answer -----------------------------------------------------------------------------------------


def test_ask_batch_end_to_end(spark, tmp_path):
    texts = ["The red fox sleeps in the old barn near the river. It hunts at night and eats mice in the field.", "A guide to the train: the ticket costs 25 euros. The train leaves at noon and arrives in the evening.", "Nothing here is of use to anyone who asks."]
    docs = spark.createDataFrame([(i, t * 3) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = [(1, "where does the red fox sleep at night"), (2, "   "), (3, None), (4, "x" * 1200), (5, "known question")]
    questions = spark.createDataFrame(asked, "item_id long, text string")
    settings = pipeline.Settings(corpus_build_id="v1", rewrite=lambda q: "the fox in the barn\nanother way to say it")
    stored = questions.where("item_id = 5").select(settings.cache_key(F.col("text")).alias("query_hash"), F.lit("stored").alias("response"), F.lit('[{"title": "t"}]').alias("sources"), F.lit('{"action": "ACCEPT", "cache_hit": false}').alias("metadata"), F.lit(0.0).alias("timestamp"))
    rows = {r["item_id"]: r for r in pipeline.ask_batch(docs, questions, settings, stored).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    one = rows[1]
    assert one["sources"][0]["title"] == "0" and one["sources"][0]["content_preview"].startswith("The red fox") and one["metadata"]["num_sources"] == len(one["sources"]) > 0
    assert one["metadata"]["error"] is None and not one["metadata"]["cache_hit"] and one["metadata"]["corpus_build_id"] == "v1"
    assert one["metadata"]["retrieval_debug"][0]["query"] == asked[0][1] and one["metadata"]["retrieval_debug"][0]["mode"] == "rrf"
    assert one["metadata"]["hallucination_check"]["confidence_score"] == one["metadata"]["confidence"]
    assert [rows[i]["metadata"]["error"] for i in (2, 3, 4)] == ["empty", "empty", "too long"] and rows[2]["sources"] == []
    assert rows[5]["answer"] == "stored" and rows[5]["metadata"]["cache_hit"] and rows[5]["sources"][0]["title"] == "t"
    # nothing to be found
    none = pipeline.ask_batch(docs.limit(0), questions.where("item_id = 1"), settings).collect()[0]
    assert none["answer"] == pipeline.NO_DOCUMENTS and none["metadata"]["error"] == "NO_RELEVANT_DOCS" and none["sources"] == []
    # what was accepted answers the next run
    done = pipeline.ask_batch(docs, questions.where("item_id = 1"), settings)
    kept = pipeline.to_cache(done, settings)
    assert one["metadata"]["action"] == "ACCEPT"
    table = StoredCache(spark, f"file://{tmp_path}/cache")
    assert not pipeline.ask_batch(docs, questions.where("item_id = 2"), settings, table).first()["metadata"]["cache_hit"]
    table.upsert(kept)
    for known in (kept, table):
        again = pipeline.ask_batch(docs, questions.where("item_id = 1"), settings, known).collect()[0]
        assert again["metadata"]["cache_hit"] and again["answer"] == one["answer"] and again["sources"] == one["sources"]


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 7)
    rows = [(i, [float(i % 10), float(i // 10)]) for i in range(60)]
    v = spark.createDataFrame([*rows, (60, None), (61, [1.0])], "vec_id long, embedding array<double>")
    got = retrieve.vector_top(v, v.where("vec_id in (0, 33)"), 5).orderBy("query_id", "rank").collect()
    for q in (0, 33):
        x = rows[q][1]
        want = sorted((round((a - x[0]) ** 2 + (b - x[1]) ** 2, 6), i) for i, (a, b) in rows if i != q)[:5]
        assert [(r["distance"], r["vec_id"]) for r in got if r["query_id"] == q] == want


def test_small_parts(spark, tmp_path):
    assert route.authorised("k", "k") and not route.authorised("x", "k") and not route.authorised(None, "k") and route.authorised(None, None)
    path = tmp_path / "t.json"
    path.write_text('[["a", "b"], ["a", "c"]]')
    assert vocabulary.load_thesaurus(str(path)) == {"a": ["b", "c"]} and vocabulary.load_thesaurus(None)
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    assert files.from_json(files.as_json(df), "id long, name string").orderBy("id").collect() == df.orderBy("id").collect()
    assert files.enveloped(df.where("id = 1"), {"run": "r1"}).first()["value"] == '{"metadata":{"run":"r1"},"result":{"id":1,"name":"x"}}'
    lines = [r["value"] for r in files.report_lines(df, F.concat(F.lit("row "), F.col("id").cast("string")), df.agg(F.count("*").alias("n"))).collect()]
    assert lines == ["REPORT", "row 1", "row 2", "n: 2"]
    chunks = spark.createDataFrame([("p", "c1"), ("q", "c2")], "parent_id string, chunk string")
    found = enrich.with_parents(chunks, spark.createDataFrame([("p", "whole")], "parent_id string, text string")).orderBy("chunk").collect()
    assert [r["parent_text"] for r in found] == ["whole", None]
    assert enrich.with_metadata(df, name=F.lit("y")).columns == df.columns
    answers = spark.createDataFrame([("a", "Il existe une chose ici. Rien de plus là-bas ailleurs."), ("b", "")], "answer_id string, response string")
    got = answers.select("answer_id", verify.embedding_claims(F.col("response")).alias("c")).collect()
    assert got[0]["c"] == ["Il existe une chose ici"]
    verdicts = spark.createDataFrame([("a", 0, "hallucinated"), ("a", 1, "supported")], "answer_id string, claim_no int, verdict string")
    assert {r["answer_id"]: r["confidence"] for r in verify.embedding_confidence(answers, verdicts).collect()} == {"a": 0.5, "b": 1.0}


def test_runs_and_comparisons(spark):
    docs = spark.createDataFrame([(1, "The fox sleeps in the barn. " * 8), (2, "The train leaves at noon. " * 8)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "where does the fox sleep", "a"), (2, "", "b")], "item_id long, text string, category string")
    each, summary = pipeline.evaluate_batch(docs, questions, by=["category"])
    assert {r["item_id"]: r["outcome"]["success"] for r in each.collect()} == {1: True, 2: False}
    assert {r["category"]: r["n_success"] for r in summary.collect()} == {"a": 1, "b": 0}
    both = pipeline.compare_embedders(docs, questions.where("item_id = 1"), {"a": models.hashing_embedder(16), "nomic-embed-text:v1": models.hashing_embedder(32)})
    assert sorted(r["embedder"] for r in both.collect()) == ["a", "nomic-embed-text:v1"]
    near = pipeline.probe(docs, ["fox barn"], k=1).collect()
    assert [(r["rank"], r["doc_id"]) for r in near] == [(1, 1)]


def test_scratch_deletes_its_tables(spark):
    from quillion.sources.shared import materialise, scratch

    with scratch(spark) as kept:
        gone = materialise(spark.range(3), "gone")
        stays = kept(gone.withColumn("x", F.lit(1)), "stays")
        with scratch(spark) as inner:
            inner(spark.range(2), "of-the-outer")
    assert stays.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_bm25_deals_more_tasks_to_more_documents(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 6))) for i in range(40)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "item_id long, text string")
    parallel = spark.sparkContext.defaultParallelism
    assert index.tasks(spark, 10, 100, 2) == parallel
    assert index.tasks(spark, 10**8, 10**10, 40) == 14_000
    whole = {tuple(r) for r in index.bm25_top(docs, asked, 3).collect()}
    monkeypatch.setattr(index, "TASK_ROWS", 10)
    assert index.tasks(spark, 40, 200, 2) == max(parallel, 28)
    assert {tuple(r) for r in index.bm25_top(docs, asked, 3).collect()} == whole


def test_title_keeps_references_without_an_end():
    cut = lambda title: html.parse(f"<html><title>{title}</title><p>x</p></html>")["title"]
    assert cut("a &amp;&amp; b &amp") == "a && b &amp"
    assert cut("a &lt;b&gt; &#233; & c ") == "a <b> é & c"
    assert cut("") == ""


def test_sensitive_tokens_read_citations_once(spark):
    rows = spark.createDataFrame([("Le 12/03/2024, 15 % et 2000 € à CODE-7, CODE-7, [S2] S2 word SIGLE été",), ("",), ("plain words",)], "text string")
    found = rows.select(verify.sensitive_tokens(F.col("text")).alias("t"))
    assert [r["t"] for r in found.collect()] == [["12/03/2024", "03", "2000", "CODE-7", "SIGLE"], [], []]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 5  # four patterns, and the citations once


def test_cosines_make_lengths_once_a_vector(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (100, [3.0, 4.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = retrieve.cosines(v, v.where("vec_id % 100 = 0"))
    got = {(r["query_id"], r["vec_id"]): r["cosine"] for r in found.collect()}
    assert got == {(r["query_id"], r["vec_id"]): r["c"] for r in retrieve.pairs(v, v.where("vec_id % 100 = 0")).select("query_id", "vec_id", F.round(retrieve.cosine(F.col("q"), F.col("v")), 6).alias("c")).collect()}
    assert got[0, 1] == 0.8 and got[0, 2] == got[100, 3] == got[0, 4] == 0.0
    join = found._jdf.queryExecution().optimizedPlan().toString().index("Join")
    assert found._jdf.queryExecution().optimizedPlan().toString()[:join].count("SQRT") == 0  # below the join alone


def test_cosines_are_dealt_out_however_vectors_lie_in_files(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS_BLOCK", 50, raising=False)
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*((F.hash("id", F.lit(i)) / 1e9).cast("float") for i in range(4))).alias("embedding")).coalesce(1)
    found = retrieve.cosines(v, v.where("vec_id % 100 = 0"))
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 4 * 399 and len(tasks) == 8 and max(tasks) <= 4 * 80  # before: all pairs in the one task that reads the file


def test_cosines_of_odd_vectors_equal_those_of_the_expression(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "ROWS_BLOCK", 9, raising=False)
    monkeypatch.setattr(retrieve, "PAIRS", 40, raising=False)
    nan, inf = float("nan"), float("inf")
    five = [[1, 0, 0, 0, 0], [1, 1999999, 1995, 127, 62], [-1, 1999999, 1995, 127, 62], [246913, 1984699, 1962, 19, 5], [-246913, 1984699, 1962, 19, 5], [246911, 1984699, 2199, 41, 14]]  # halves of the sixth digit
    five += [[0, 0, 0, 0, 0], [-0.0, 1, 0, 0, 0], [1e-170, 0, 0, 2e-170, 0], [3e-162, 1e-162, 0, 0, 0], [1e-155, 0, 1e-150, 0, 0], [1e200, 1, 0, 0, 0], [1e150, -1e150, 1e149, 0, 0], [1e308, 1e308, -1e308, 0, 0], [nan, 1, 0, 0, 0], [inf, 1, 0, 0, 0], [-inf, 0, 0, 0, 0], [1e-3, -1e5, 0, 0, 0]]
    five += [[math.sin(i * j) for j in range(1, 6)] for i in range(1, 8)]
    rows = [*five, None, [], [1, 2], [2, 1], [None, 1, 0, 0, 0], [None], [0, 0]]
    for kind in ("long", "string"):
        v = spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
        v = v.union(v.where("vec_id = 1")).union(v.where("vec_id = 3").select(F.lit(None), "embedding")).withColumn("vec_id", F.col("vec_id").cast(kind))
        found = retrieve.cosines(v, v)
        expected = retrieve.pairs(v, v).select("query_id", "vec_id", F.round(retrieve.cosine(F.col("q"), F.col("v")), 6).alias("cosine"))
        assert found.schema == expected.schema
        got = sorted(map(repr, found.collect()))
        assert got == sorted(map(repr, expected.collect())) and len(got) == len(rows) ** 2 - len(rows) + 2 * (len(rows) - 1)
    ties = {(int(r["query_id"]), int(r["vec_id"])): r["cosine"] for r in found.collect()}
    assert ties[0, 1] == 1e-6 and ties[0, 2] == -1e-6 and ties[0, 3] == 0.123457 and ties[0, 5] == 0.123456
