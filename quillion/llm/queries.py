"""The queries of this subpackage: thin callers of its operators that return the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm import align, ann, collocations, decontaminate, licences, linededup, packing, ppm, probminhash, quality, store, tokenio, toxicity, warc


def _scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """score is a UDF; its result is made once for each row."""
    out = docs.select(F.col("doc_id"), store.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, toxicity.scorer(spark, grammar), 0.5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = store.documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _scored(docs, quality.scorer(spark, model), 0.3)


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark, "tokens")
    tokenio.write(store.documents(spark, sf_dir), path, byte_bpe(), end_id=2)
    return tokenio.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(store.documents(spark, sf_dir), byte_bpe(), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(store.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(store.documents(spark, sf_dir))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(store.documents(spark, sf_dir)).select("doc_id", "class_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.classes(store.documents(spark, sf_dir))
    kept = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line")) & (F.col("tie") == F.col("class_tie"))
    return found.select("doc_id", "line_no", "class_doc", "class_line", kept.alias("kept"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, F.col("id") % 50 == 0, k=5)


#: Damage that op9 does to its replica, by the first two digits of the MD5 of a page's id. Of what is added, some has the
#: key of another record, and some (that of these pages and NEW_KEY) a key that the reference lacks.
CHANGED, MISSING, ADDED, NEW = ("0a", "1a", "2a", "3a"), ("0b", "1b", "2b", "3b"), ("0c", "1c", "2c", "3c"), ("0d", "1d", "2d", "3d")
NEW_KEY = 10**12


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    kept = pages.where(~kind.isin(*MISSING)).withColumn("html", F.when(kind.isin(*CHANGED), F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")))
    added = pages.where(kind.isin(*ADDED, *NEW)).withColumn("html", F.lit("added"))
    replica = kept.unionByName(added.withColumn("page_id", F.when(kind.isin(*NEW), F.col("page_id") + NEW_KEY).otherwise(F.col("page_id"))))
    records, nodes = warc.manifest(warc.leaves(pages))
    damaged = warc.audit(records, nodes, store.materialise(warc.leaves(replica), "replica-leaves"))
    return warc.fixity(store.materialise(damaged, "damaged"), records)


OP9_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(coalesce(page_id::VARCHAR, '')), 1, 2) AS kind FROM pages),
versions AS (
  SELECT 0 AS v, * FROM p
  UNION ALL SELECT 1, page_id, url, CASE WHEN kind IN {CHANGED} THEN html || '!' ELSE html END, kind FROM p WHERE kind NOT IN {MISSING}
  UNION ALL SELECT 2, page_id + CASE WHEN kind IN {NEW} THEN {NEW_KEY} ELSE 0 END, url, 'added', kind FROM p WHERE kind IN {ADDED + NEW}),
d AS (SELECT *, sha256(html) AS h FROM versions),
r AS (SELECT v, page_id, kind, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
  || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || chr(13) || chr(10)
  || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Page-Key: ' || coalesce(page_id::VARCHAR, '')
  || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || h || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)::VARCHAR
  || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS raw FROM d),
l AS (SELECT v, page_id AS key, kind, strlen(raw)::BIGINT AS length, sha256(raw) AS leaf FROM r),
ours AS (SELECT *, coalesce(sum(length) OVER (ORDER BY key NULLS FIRST, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM l WHERE v = 0)
SELECT o.key, o."offset", o.length, (o."offset" // {warc.RANGE_BYTES})::BIGINT AS range_no, o.leaf, t.leaf AS replica_leaf,
  CASE WHEN t.leaf IS NULL THEN 'missing' WHEN t.leaf <> o.leaf THEN 'changed' ELSE 'intact' END AS status
FROM ours o LEFT JOIN (SELECT key, leaf FROM l WHERE v = 1) t ON o.key IS NOT DISTINCT FROM t.key
UNION ALL
SELECT l.key, NULL, NULL, (coalesce(o."offset", (SELECT max("offset") FROM ours)) // {warc.RANGE_BYTES})::BIGINT, NULL, l.leaf, 'added' FROM l LEFT JOIN ours o ON o.key IS NOT DISTINCT FROM l.key WHERE l.v = 2"""


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = ppm.trained_on(F.col("doc_id"))
    docs = store.documents(spark, sf_dir).withColumn("_train", training)
    return ppm.scores(docs, F.col("_train"), across=True).select("doc_id", (~training).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.summary(store.documents(spark, sf_dir), byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(store.documents(spark, sf_dir), max_n=5, least=100, percent=100, first=2000)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_quality, op4_token_output, op5_packing, op6_near_duplicates, op7_line_dedup, op8_nearest_neighbours, op9_warc_fixity, op10_licences, op11_language_model, op12_alignment, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc_fixity": OP9_SQL, "op10_licences": licences.oracle(), "op13_collocations": collocations.oracle()}
