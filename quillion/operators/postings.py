"""A stored inverted index: postings written once in blocks, searched by block-max pruning, kept up to date by deltas.

A version of an index is a folder with four tables:

* ``documents`` (d, hash, length): each document's content hash and number of tokens;
* ``terms`` (term, df): in how many documents each term is;
* ``stats``: one row with the number of documents and of tokens, and the index's parameters;
* ``blocks``: the postings, in folders by a hash of the term. Documents are dealt into shards by a hash of their id, so that
  a term of every document is spread evenly. A term's postings of a shard, in order of the id, make blocks of up to
  ``BLOCK``: the first id, the gaps to the next ones, the counts and the documents' lengths as arrays (which Parquet packs
  into as few bits as they need), and the block's ``impacts``, those (count, length) that no other of the block beats in
  both. The block's largest score follows from them for any statistics, so blocks stay valid while a corpus changes.

A search deals the asked terms' blocks by shard and brings the questions to them; postings and scores are never rows of a
shuffle. What a block's documents can score at most is its own bound and the bounds of the other terms' blocks that overlap
it. The k-th best score of the most promising blocks is a threshold that the result must reach, and only blocks that can
reach it are scored. A task passes on the best of a question and shard. The result is the same as without pruning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.functions import text as X
from quillion.operators import index
from quillion.sources.files import VersionedTable
from quillion.sources.shared import materialise

#: Postings of a block.
BLOCK = 128
#: Documents of a shard, about: a task of a search holds their postings of asked terms.
SHARD_DOCS = 1 << 15
#: Folders of blocks.
BUCKETS = 16
#: Of a question's blocks in a shard, so many with the largest bounds are scored first, for the threshold.
SEEDS = 16
#: Scores are rounded to six digits before they are ranked.
SLACK = 1e-6
#: Scores that a shard passes on beyond the k best, as they are rounded before they are ranked.
SPARE = 8
#: Questions that meet a shard in one task, about.
ASKING = 1024
#: Tokens that are counted at once, and blocks that are unpacked at once.
TOKENS, UNPACKED = 1 << 20, 2048
#: Question terms up to which they are handed to the scan as a list.
LISTED_TERMS = 1000

_POSTING = "bucket int, shard int, term string, d long, count int, length int"
_BLOCK = "bucket int, shard int, term string, block int, first long, last long, gaps array<long>, counts array<int>, lengths array<int>, impacts array<struct<count: int, length: int>>"
_PARTS = {"documents": "d long, hash long, length long", "terms": "term string, df long", "stats": "n_docs long, n_tokens long, variant string, buckets int, shards int", "blocks": _BLOCK}


def tokens_of(variant: str, text: Column) -> Column:
    cut = {"plus1": index.bm25_tokens, "okapi": X.spaced_words}[variant]
    return cut(F.coalesce(text, F.lit("")))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets)).cast("int")


def _shard(d: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(d), F.lit(shards)).cast("int")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some ``TOKENS`` tokens, or one document."""
    stop = np.cumsum(pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(stop, (stop[a - 1] if a else 0) + TOKENS, "right")))
        yield batch.slice(a, b - a)
        a = b


def _postings(rows: DataFrame, buckets: int, shards: int) -> DataFrame:
    """One row a document and term, of rows (d, tokens); a document's tokens are counted where they are."""

    def count(batches):
        for batch in (part for whole in batches for part in _slices(whole)):
            tokens = batch.column("tokens")
            of, coded = tokens.value_parent_indices().to_numpy(), tokens.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            keys, n = np.unique(of.astype(np.int64) * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            doc = pa.array(keys // size)
            length = np.bincount(of, minlength=batch.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("d").take(doc), coded.dictionary.take(pa.array(keys % size)), pa.array(n.astype(np.int32)), pa.array(length).take(doc)], ["d", "term", "count", "length"])

    counted = rows.where(F.size("tokens") > 0).select("d", "tokens").mapInArrow(count, "d long, term string, count int, length int")
    return counted.select(_bucket(F.col("term"), buckets).alias("bucket"), _shard(F.col("d"), shards).alias("shard"), "term", "d", "count", "length")


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _blocks(table: pa.Table, begins: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """Blocks that begin at these rows, with their numbers."""
    d, counts, lengths = (table[c].to_numpy() for c in ("d", "count", "length"))
    sizes = np.diff(np.append(begins, len(d)))
    inner = np.ones(len(d), bool)
    inner[begins] = False
    of = np.repeat(np.arange(len(begins)), sizes)
    # a block's impacts: its pairs by falling count, as long as lengths fall too
    order = np.lexsort((lengths, -counts, of))
    falling = lengths[order] - of[order] * (1 << 32)  # each block begins far below the one before it
    least = np.minimum.accumulate(falling)
    new = np.append(True, least[1:] < least[:-1])
    at = order[new]
    impacts = pa.StructArray.from_arrays([pa.array(counts[at]), pa.array(lengths[at])], names=["count", "length"])
    keys = [table[c].combine_chunks().take(pa.array(begins)) for c in ("bucket", "shard", "term")]
    gaps = np.diff(d, prepend=0)[inner]
    columns = [*keys, pa.array(numbers.astype(np.int32)), pa.array(d[begins]), pa.array(d[begins + sizes - 1]), _lists(sizes - 1, pa.array(gaps)), _lists(sizes, pa.array(counts)), _lists(sizes, pa.array(lengths)), _lists(np.bincount(of[at], minlength=len(begins)), impacts)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "shard", "term", "block", "first", "last", "gaps", "counts", "lengths", "impacts"])


def _pack(batches) -> Iterator[pa.RecordBatch]:
    """Blocks from postings in order of bucket, shard, term and id. The last block waits for the next batch, which may go on with it."""
    kept, number = None, 0  # rows of the open block, and its number in its list
    for batch in batches:
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.zeros(table.num_rows, bool)
        for x in (term, table["bucket"].to_numpy(), table["shard"].to_numpy()):
            new[1:] |= x[1:] != x[:-1]
        new[0] = True
        starts = np.flatnonzero(new)
        place = np.arange(table.num_rows) - starts[np.cumsum(new) - 1]
        begins = np.flatnonzero(place % BLOCK == 0)
        numbers = place[begins] // BLOCK + np.where(begins < (starts[1] if len(starts) > 1 else table.num_rows), number, 0)
        if len(begins) > 1:
            yield _blocks(table.slice(0, int(begins[-1])), begins[:-1], numbers[:-1])
        kept, number = table.slice(int(begins[-1])), int(numbers[-1])
    if kept is not None:
        yield _blocks(kept, np.array([0]), np.array([number]))


def _packed(postings: DataFrame) -> DataFrame:
    dealt = postings.select("bucket", "shard", "term", "d", "count", "length").repartition("bucket", "shard")
    return dealt.sortWithinPartitions("bucket", "shard", "term", "d").mapInArrow(_pack, _BLOCK)


def _unpacked(blocks: DataFrame) -> DataFrame:
    """Postings from blocks."""

    def run(batches):
        for batch in batches:
            of, d = _decoded(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in ("bucket", "shard", "term")), pa.array(d), batch.column("counts").flatten(), batch.column("lengths").flatten()], ["bucket", "shard", "term", "d", "count", "length"])

    return blocks.select("bucket", "shard", "term", "first", "gaps", "counts", "lengths").mapInArrow(run, _POSTING)


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """Postings in order, of rows in order of bucket, shard, term and kind: 0 old blocks, 1 documents whose postings go, 2 postings that come."""
    kept = None  # rows of the open list
    keys = ["bucket", "shard", "term"]
    for part in (whole.slice(i, UNPACKED) for whole in batches for i in range(0, whole.num_rows, UNPACKED)):
        table = pa.Table.from_batches([part]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([part])]).combine_chunks()
        last = table.slice(table.num_rows - 1)
        same = np.ones(table.num_rows, bool)
        for c in keys:
            same &= pc.equal(table[c], last[c][0]).to_numpy(zero_copy_only=False)
        done = int(np.argmax(same))  # lists are whole before the last one
        kept = table.slice(done)
        if done:
            yield _left(table.slice(0, done))
    if kept is not None:
        yield _left(kept)


def _left(table: pa.Table) -> pa.RecordBatch:
    """The postings of whole lists after the change."""
    batch = table.combine_chunks().to_batches()[0]
    kind, new = batch.column("kind").to_numpy(), np.zeros(batch.num_rows, bool)
    for c in ("bucket", "shard", "term"):
        x = batch.column(c)
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    of = np.cumsum(new)
    held, gone = batch.filter(pa.array(kind != 1)), np.flatnonzero(kind == 1)
    row, d = _decoded(held)
    row = np.flatnonzero(kind != 1)[row]
    every = np.concatenate([d, batch.column("first").to_numpy()[gone]])
    lists, number = np.concatenate([of[row], of[gone]]), np.unique(every, return_inverse=True)[1]
    pair = lists * (int(number.max(initial=0)) + 1) + number
    go = (kind[row] == 0) & np.isin(pair[: len(d)], pair[len(d) :])
    stay = np.flatnonzero(~go)
    stay = stay[np.argsort(pair[stay], kind="stable")]
    at = pa.array(stay)
    columns = [batch.column(c).take(pa.array(row[stay])) for c in ("bucket", "shard", "term")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(d[stay]), held.column("counts").flatten().take(at), held.column("lengths").flatten().take(at)], ["bucket", "shard", "term", "d", "count", "length"])


def _decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each posting's row in the batch, and its document's id."""
    of = batch.column("counts").value_parent_indices().to_numpy()
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    steps = np.zeros(len(of), np.int64)
    steps[~first] = batch.column("gaps").flatten().to_numpy()
    run = np.cumsum(steps)
    return of, batch.column("first").to_numpy()[of] + run - run[first][np.cumsum(first) - 1]


class StoredIndex:
    """An index of one kind of tokens (``plus1`` or ``okapi``, as in ``index.bm25_scores``) at a path. Ids are whole numbers, one a document."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def part(self, name: str) -> DataFrame:
        return self.spark.read.schema(_PARTS[name]).parquet(f"{self.table.current()}/{name}")

    def stats(self) -> dict:
        return self.part("stats").first().asDict()

    @staticmethod
    def _rows(docs: DataFrame, variant: str, id_col: str, text_col: str) -> DataFrame:
        return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), tokens_of(variant, F.col(text_col)).alias("tokens"))

    @staticmethod
    def _of(docs: DataFrame, wanted: DataFrame, variant: str, id_col: str, text_col: str) -> DataFrame:
        """Rows (d, tokens) of the wanted documents, whose texts alone are cut."""
        texts = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("text")).join(wanted, "d", "left_semi")
        return texts.select("d", tokens_of(variant, F.col("text")).alias("tokens"))

    def _write(self, documents: DataFrame, terms: DataFrame | None, blocks: DataFrame, about: dict) -> str:
        def write(folder: str) -> None:
            documents.write.parquet(f"{folder}/documents")
            blocks.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/blocks")
            held = self.spark.read.schema(_BLOCK).parquet(f"{folder}/blocks").groupBy("term").agg(F.sum(F.size("counts")).cast("long").alias("df")) if terms is None else terms
            held.sortWithinPartitions("term").write.parquet(f"{folder}/terms")
            total = self.spark.read.parquet(f"{folder}/documents").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_tokens"))
            total.select("*", *(F.lit(v).alias(k) for k, v in about.items())).coalesce(1).write.parquet(f"{folder}/stats")

        return self.table.commit(write)

    def build(self, docs: DataFrame, variant: str = "plus1", id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, shard_docs: int = SHARD_DOCS) -> str:
        """Write a version from all documents: they are read twice, and postings are shuffled once."""
        rows = self._rows(docs, variant, id_col, text_col)
        documents = materialise(rows.select("d", "hash", F.size("tokens").cast("long").alias("length")), "index-documents")
        shards = max(1, -(-documents.count() // shard_docs))
        return self._write(documents, None, _packed(_postings(rows, buckets, shards)), {"variant": variant, "buckets": buckets, "shards": shards})

    def update(self, before: DataFrame, after: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
        """Write the next version for a changed corpus, and count what changed.

        Documents whose content hash differs from the stored one are found by a join of ids and hashes. Their old and new
        tokens make signed deltas of term counts. Only lists (a term in a shard) with a delta are unpacked and packed
        again; all other blocks, and all documents that stay, are carried over. ``before`` is the corpus that is indexed;
        only changed and lost documents' texts are read from it. The number of shards stays.
        """
        about = self.stats()
        variant, buckets, shards = about["variant"], about["buckets"], about["shards"]
        old, new = self.part("documents"), self._rows(after, variant, id_col, text_col)
        both = old.select("d", F.col("hash").alias("was"), F.col("length").alias("was_long")).join(new.select("d", "hash"), "d", "full")
        kind = F.when(F.col("was").isNull(), "inserted").when(F.col("hash").isNull(), "deleted").when(F.col("was") != F.col("hash"), "changed")
        both = materialise(both.withColumn("kind", kind), "index-changes")
        changes = both.where("kind is not null")
        gone, come = changes.where("kind <> 'inserted'").select("d"), changes.where("kind <> 'deleted'").select("d")
        fresh = self._of(after, come, variant, id_col, text_col)
        added = materialise(_postings(fresh, buckets, shards), "index-added")
        lost = materialise(_postings(self._of(before, gone, variant, id_col, text_col), buckets, shards), "index-lost")
        signed = added.select("term", F.lit(1).alias("sign")).unionByName(lost.select("term", F.lit(-1).alias("sign"))).groupBy("term").agg(F.sum("sign").alias("sign"))
        terms = self.part("terms").join(signed, "term", "full").select("term", (F.coalesce("df", F.lit(0)) + F.coalesce("sign", F.lit(0))).alias("df")).where("df > 0")
        lists = added.select("bucket", "shard", "term").unionByName(lost.select("bucket", "shard", "term")).distinct()
        keys = ["bucket", "shard", "term"]
        blocks = self.part("blocks")
        touched = blocks.join(lists, keys, "left_semi")
        nothing = lambda kind: F.array().cast(f"array<{kind}>")
        one = lambda c: F.array(F.col(c).cast("int")).alias(f"{c}s")
        rows = touched.select(*keys, F.lit(0).alias("kind"), "first", "gaps", "counts", "lengths")
        rows = rows.unionByName(lost.select(*keys, F.lit(1).alias("kind"), F.col("d").alias("first"), nothing("long").alias("gaps"), nothing("int").alias("counts"), nothing("int").alias("lengths")))
        rows = rows.unionByName(added.select(*keys, F.lit(2).alias("kind"), F.col("d").alias("first"), nothing("long").alias("gaps"), one("count"), one("length")))
        # lists are unpacked, changed and packed where they are
        packed = rows.repartition("bucket", "shard").sortWithinPartitions(*keys, "kind", "first").mapInArrow(lambda batches: _pack(_merged(batches)), _BLOCK)
        kept = blocks.join(lists, keys, "left_anti").select(packed.columns)
        lengths = fresh.select("d", F.size("tokens").cast("long").alias("length"))
        stay = both.where("kind is null").select("d", "hash", F.col("was_long").alias("length"))
        documents = stay.unionByName(changes.where("hash is not null").select("d", "hash").join(lengths, "d"))
        self._write(documents, terms, kept.unionByName(packed), {"variant": variant, "buckets": buckets, "shards": shards})
        return {"inserted": 0, "changed": 0, "deleted": 0} | {r["kind"]: r["count"] for r in changes.groupBy("kind").count().collect()}

    # searching

    def _weights(self, questions: DataFrame, question_id: str, question_col: str, about: dict) -> DataFrame:
        """(q, term, bucket, weight): times and idf of each asked term that the index holds."""
        wanted = questions.select(F.col(question_id).alias("q"), F.explode(tokens_of(about["variant"], F.col(question_col))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
        n, df = F.lit(float(about["n_docs"])), F.col("df")
        if about["variant"] == "plus1":
            idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
        else:
            raw = F.log(n - df + 0.5) - F.log(df + 0.5)
            mean = self.part("terms").agg(F.avg(raw)).first()[0] or 0.0
            idf = F.when(raw < 0, F.lit(mean * index.EPSILON)).otherwise(raw)
        terms = self.part("terms").join(wanted.select("term").distinct(), "term", "left_semi").select("term", idf.alias("idf"))
        weights = wanted.join(terms, "term").select("q", "term", _bucket(F.col("term"), about["buckets"]).alias("bucket"), (F.col("times") * F.col("idf")).alias("weight"))
        return materialise(weights, "index-weights")

    def _asked_blocks(self, weights: DataFrame) -> DataFrame:
        """The blocks of the asked terms: whole folders are left out, and row groups if the terms are few."""
        blocks = self.part("blocks")
        folders = [r[0] for r in weights.select("bucket").distinct().collect()]  # at most as many as there are folders
        blocks = blocks.where(F.col("bucket").isin(folders))
        few = weights.select("term").distinct().limit(LISTED_TERMS + 1).collect()
        return blocks.where(F.col("term").isin([r[0] for r in few])) if len(few) <= LISTED_TERMS else blocks

    def _gone_through(self, questions: DataFrame, k: int, question_id: str, question_col: str, k1: float, b: float, count: bool) -> DataFrame:
        """(q, d, score) of what can be among the k best, or with ``count`` (q, blocks, read) of each shard."""
        about = self.stats()
        average = about["n_tokens"] / max(1, about["n_docs"])
        weights = self._weights(questions, question_id, question_col, about)
        norm = lambda count, length: count + k1 * (1 - b + b * length / average if average else 1 - b)
        most = F.aggregate("impacts", F.lit(0.0), lambda s, x: F.greatest(s, x["count"] * (k1 + 1) / norm(x["count"], x["length"])))
        sinking = weights.groupBy("q").agg(F.min("weight").alias("least"))
        slices = -(-sinking.count() // ASKING)
        blocks = self._asked_blocks(weights).join(weights.select("bucket", "term", _slice("q", slices)).distinct(), ["bucket", "term"])
        blocks = blocks.select("shard", "slice", F.lit(False).alias("asks"), "term", "block", "first", "last", "gaps", "counts", "lengths", most.alias("most"), F.lit(None).cast("long").alias("q"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("threshold"))
        empty = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in ("block", "first", "last", "gaps", "counts", "lengths", "most")}

        def go(threshold: DataFrame | None, mode: str, schema: str) -> DataFrame:
            asks = weights if threshold is None else weights.join(threshold, "q", "left")
            asks = asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(about["shards"] - 1)))).withColumn("slice", _slice("q", slices)).withColumn("asks", F.lit(True))
            asks = asks.withColumns(empty).withColumn("threshold", F.lit(None).cast("double") if threshold is None else F.col("threshold")).select(blocks.columns)
            rows = blocks.unionByName(asks).repartition("shard", "slice").sortWithinPartitions("shard", "slice", "asks", "q", "term", "block")
            return rows.mapInArrow(lambda batches: _shards(batches, mode, k, norm, k1), schema)

        seeds = go(None, "seeds", "q long, d long, score double")
        best = index.top_k(seeds, "q", k, "d")
        # partial sums are lower bounds only if no term can take from a score
        threshold = best.groupBy("q").agg(F.min("score").alias("threshold"), F.count("*").alias("n")).where(F.col("n") >= k).join(sinking.where("least >= 0"), "q", "left_semi")
        threshold = materialise(threshold.select("q", "threshold"), "index-thresholds")
        return go(threshold, "count", "q long, blocks long, read long") if count else go(threshold, "score", "q long, d long, score double")

    def search(self, questions: DataFrame, k: int, question_id: str = "item_id", question_col: str = "text", id_col: str = "doc_id", k1: float = index.K1, b: float = index.B) -> DataFrame:
        """(question id, id, score, rank, similarity_score, retrieval_source) as ``index.bm25_top``; documents aren't read. Question ids are whole numbers."""
        scored = self._gone_through(questions, k, question_id, question_col, k1, b, False).withColumn("score", F.round("score", 6))
        found = index.top_k(scored.select(F.col("q").alias(question_id), F.col("d").alias(id_col), "score"), question_id, k, id_col)
        return found.withColumn("similarity_score", index.rank_similarity(F.col("rank"))).withColumn("retrieval_source", F.lit("bm25"))

    def pruning(self, questions: DataFrame, k: int, question_id: str = "item_id", question_col: str = "text", k1: float = index.K1, b: float = index.B) -> DataFrame:
        """(question id, blocks, read): how many blocks hold a question's terms, and how many of them a search scores."""
        each = self._gone_through(questions, k, question_id, question_col, k1, b, True)
        return each.groupBy(F.col("q").alias(question_id)).agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))


def _slice(q: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(q), F.lit(max(1, slices))).cast("int").alias("slice")


def _shards(batches, mode: str, k: int, norm, k1: float) -> Iterator[pa.RecordBatch]:
    """Of rows in order of shard, slice and question, blocks first: a shard's blocks are held while its questions pass by."""
    now, blocks, shard, open_ = None, [], None, None
    out = _Out(mode)
    for whole in batches:
        keys = whole.column("shard").to_numpy().astype(np.int64) << 32 | whole.column("slice").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for a, z in zip(np.append(0, cuts).tolist(), np.append(cuts, len(keys)).tolist(), strict=True):
            if z > a and keys[a] != now:
                if open_ is not None and shard is not None:
                    out.add(open_.column("q")[0].as_py(), shard.asked(open_, mode, k))
                now, blocks, shard, open_ = keys[a], [], None, None
            part = whole.slice(a, z - a)
            own = int(np.count_nonzero(~part.column("asks").to_numpy(zero_copy_only=False)))
            if own:
                blocks.append(part.slice(0, own).select(["term", "first", "last", "gaps", "counts", "lengths", "most"]))
            asks = part.slice(own)
            if not asks.num_rows or not (blocks or shard):
                continue
            if shard is None:
                shard, blocks = _Shard(blocks, norm, k1), []
            if open_ is not None:
                asks = pa.Table.from_batches([open_, asks]).combine_chunks().to_batches()[0]
            q = asks.column("q").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(q)) + 1, len(q)).tolist()
            for i, j in zip([0, *ends[:-1]], ends, strict=True):
                if j == len(q):  # the last question may go on in the next batch
                    open_ = asks.slice(i)
                else:
                    out.add(int(q[i]), shard.asked(asks.slice(i, j - i), mode, k))
        yield from out.full(1 << 16)
    if open_ is not None and shard is not None:
        out.add(open_.column("q")[0].as_py(), shard.asked(open_, mode, k))
    yield from out.full(1)


class _Out:
    """Rows on their way."""

    def __init__(self, mode: str):
        self.names, self.rows, self.n = (["q", "blocks", "read"] if mode == "count" else ["q", "d", "score"]), [], 0

    def add(self, q: int, found: tuple[np.ndarray, np.ndarray]) -> None:
        self.rows.append((np.full(len(found[0]), q, np.int64), *found))
        self.n += len(found[0])

    def full(self, n: int) -> Iterator[pa.RecordBatch]:
        if self.n >= n:
            columns = [pa.array(np.concatenate(x)) for x in zip(*self.rows, strict=True)]
            self.rows, self.n = [], 0
            yield pa.RecordBatch.from_arrays(columns, self.names)


class _Shard:
    """The asked terms' postings of a shard."""

    def __init__(self, batches: list[pa.RecordBatch], norm, k1: float):
        parts = [(b.slice(i, UNPACKED)) for b in batches for i in range(0, b.num_rows, UNPACKED)]
        ids, values = [], []
        for x in parts:
            ids.append(_decoded(x)[1])
            count, length = (x.column(c).flatten().to_numpy().astype(np.float64) for c in ("counts", "lengths"))
            values.append(count * (k1 + 1) / norm(count, length))
        self.value = np.concatenate(values)
        self.ids, doc = np.unique(np.concatenate(ids), return_inverse=True)
        self.doc = doc.astype(np.int32)
        sizes = np.concatenate([pc.list_value_length(x.column("counts")).to_numpy() for x in parts])
        self.stop = np.cumsum(sizes)
        self.begin = self.stop - sizes
        self.first, self.last, self.most = (np.concatenate([x.column(c).to_numpy() for x in parts]) for c in ("first", "last", "most"))
        coded = pa.chunked_array([x.column("term") for x in parts]).combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy()
        starts = np.append(0, np.flatnonzero(np.diff(term)) + 1)  # a term's blocks stand together
        names = coded.dictionary.to_pylist()
        self.of = {names[term[a]]: (int(a), int(b)) for a, b in zip(starts, np.append(starts[1:], len(term)), strict=True)}

    def asked(self, rows: pa.RecordBatch, mode: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One question's terms: ids and scores of the best documents, or the numbers of blocks there are and to be scored."""
        terms = [(*self.of[t], w) for t, w in zip(rows.column("term").to_pylist(), rows.column("weight").to_pylist(), strict=True) if t in self.of]
        if not terms:
            return np.empty(0, np.int64), np.empty(0, np.int64 if mode == "count" else float)
        at = np.concatenate([np.arange(a, b) for a, b, _ in terms])
        weight = np.repeat([w for *_, w in terms], [b - a for a, b, _ in terms])
        best = _reach(self.first[at], self.last[at], weight * self.most[at])
        chosen, threshold = np.ones(len(at), bool), rows.column("threshold")[0].as_py()
        if mode == "seeds":
            chosen[np.argsort(-best, kind="stable")[SEEDS:]] = False
        elif threshold is not None:
            chosen = best >= threshold - 2 * SLACK
        if mode == "count":
            return np.array([len(at)]), np.array([np.count_nonzero(chosen)])
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        at, weight = at[chosen], weight[chosen]
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(weight) != 0)) + 1
        for i, j in zip(np.append(0, cuts).tolist(), np.append(cuts, len(at)).tolist(), strict=True):
            if j > i:  # blocks that follow each other, maybe of two terms of the same weight
                run = slice(self.begin[at[i]], self.stop[at[j - 1]])
                np.add.at(score, self.doc[run], weight[i] * self.value[run])
                seen[self.doc[run]] = True
        found = np.flatnonzero(seen)
        if len(found) > k + SPARE:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k] - 2 * SLACK]
            found = found[np.lexsort((self.ids[found], -np.round(score[found], 6)))[: k + SPARE]]
        return self.ids[found], score[found]


def _reach(first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """What any document of each block can score at most, of one question and shard: its blocks overlap as intervals of ids.

    The borders of all blocks cut the ids into stretches. In a stretch, a term adds the bound of its block there, if it
    has one and it is above 0; a block reaches the largest sum among its stretches.
    """
    bound = np.maximum(bound, 0.0)
    cuts = np.unique(np.concatenate([first, last + 1]))
    change = np.zeros(len(cuts) + 1)
    begin, stop = np.searchsorted(cuts, first), np.searchsorted(cuts, last + 1)
    np.add.at(change, begin, bound)
    np.add.at(change, stop, -bound)
    sums = np.cumsum(change)[: len(cuts)]
    return np.array([sums[a:b].max() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]) * (1 + 1e-12) + 1e-9
