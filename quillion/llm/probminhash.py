"""Near-duplicate documents by ProbMinHash over weighted shingles.

A document's elements are its five-word shingles, weighted by their counts. Each element is a Poisson process whose rate
is its weight: it arrives again and again, each arrival at a uniformly drawn one of ``REGISTERS`` registers, and a
register keeps the element that arrives first. Two documents' registers agree with the probability Jaccard similarity.
An element stops once its next arrival comes later than every register's first, which is soon. Bands of ``ROWS``
registers give buckets; candidates in a bucket are verified by the exact weighted Jaccard similarity (sum of smaller over
sum of larger counts), and classes are the connected components of links of ``SIMILARITY`` or more. With 28 bands of 5
registers a pair at 0.8 shares no bucket with a probability of 1.5e-5.

Texts whose words are equal are one node from the start (by a 64-bit hash), so copies cost nothing later; candidates in
large buckets are compared as ``components.linked`` says.

Defined results: a text without words (null, empty, marks only) is in a class of its own; a text of under five words is
one shingle; repeated rows share a class; a class's id is the smallest document id in it (null ids last: a class of
null ids alone has a null id); an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import bitmap, components, store
from quillion.llm.words import WORD, batches_of, give_back, hashed, mix

BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
SHINGLE = 5
SIMILARITY = 0.8
_BITS = np.uint64(50)
_LOW = np.uint64((1 << 50) - 1)

_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("node", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
_BAGS = T.StructType([T.StructField("node", T.LongType()), T.StructField("payload", T.BinaryType())])


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Shingle hashes of the texts in order, the text each belongs to, and each text's node (None without words)."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = hashed([w for ws in words for w in ws])
    ends = np.cumsum(sizes)
    nodes = [int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(flat[e - n : e].tobytes())).view(np.int64))) if n else None for n, e in zip(sizes, ends, strict=True)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(flat), np.uint64)
        for j in range(SHINGLE):  # hash of the words at and after each place, as far as the text goes
            ahead = np.zeros(len(flat), np.uint64)
            if j < len(flat):
                same = owner[j:] == owner[: len(flat) - j]
                ahead[: len(flat) - j][same] = flat[j:][same]
            acc = mix(acc + ahead)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    keep = (place + SHINGLE <= np.repeat(sizes, sizes)) | (place == 0)
    return acc[keep], owner[keep], nodes


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The (n, REGISTERS) first-arriving elements of n texts; 0 where a text has none."""
    m = REGISTERS
    key, count = np.unique((owner.astype(np.uint64) << _BITS) | (hashes & _LOW), return_counts=True)
    doc, element, weight = (key >> _BITS).astype(np.int64), key & _LOW, count.astype(np.float64)
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    time, seed, round_ = np.zeros(len(key)), mix(element), 0
    while len(doc):
        round_ += 1
        draw = mix(seed + np.uint64(round_ * 2))
        uniform = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weight
        register = doc * m + (mix(seed + np.uint64(round_ * 2 + 1)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        winner[register[won]] = element[won] + np.uint64(1)
        latest = first.reshape(n, m).max(axis=1)
        on = time < latest[doc]
        doc, element, weight, time, seed = doc[on], element[on], weight[on], time[on], seed[on]
    return winner.reshape(n, m)


def bands(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys."""
    grouped = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(signature), axis=0)
    for j in range(ROWS):
        key = mix(key ^ mix(grouped[:, :, j]))
    return key.view(np.int64)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, node, bands) of every document; node and bands are null without words."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in batches_of(texts, 500_000):
                hashes, owner, nodes = shingles(texts[a:b])
                keys = bands(signatures(hashes, owner, b - a)).tolist()
                rows = [k if node is not None else None for k, node in zip(keys, nodes, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(nodes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "tie", "node", "bands"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text")).mapInArrow(run, _SIGNED)


def bags(docs: DataFrame) -> DataFrame:
    """(node, payload) of docs (text): sorted distinct 64-bit hashes, then their 32-bit counts, as bytes."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in batches_of(texts, 500_000):
                hashes, owner, nodes = shingles(texts[a:b])
                cuts = np.searchsorted(owner, np.arange(b - a + 1))
                out: list[tuple] = []
                for i, node in enumerate(nodes):
                    if node is not None:
                        s, c = np.unique(hashes[cuts[i] : cuts[i + 1]], return_counts=True)
                        out.append((node, s.astype("<u8").tobytes() + c.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["node", "payload"])
        give_back()

    return docs.mapInArrow(run, _BAGS)


def bag(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 12
    return np.frombuffer(payload, "<u8", n), np.frombuffer(payload, "<u4", n, 8 * n)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two payloads."""
    (sa, ca), (sb, cb) = bag(a), bag(b)
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    same = sb[at] == sa
    common = int(np.minimum(ca[same], cb[at[same]]).sum())
    return common / (int(ca.sum()) + int(cb.sum()) - common)


def near_pairs(a: list[bytes], b: list[bytes]) -> list[bool]:
    return [similarity(x, y) >= SIMILARITY for x, y in zip(a, b, strict=True)]


def near_cells(a: list[bytes], b: list[bytes], asked: np.ndarray | None = None) -> np.ndarray:
    """The same for all of a against all of b: sums of smaller counts as products of 0-1 matrices.

    All are compared at once, whichever are asked for. The n-th occurrence of a shingle is a column of its own, so that a row of counts is a row of zeros and ones.
    """
    keys, rows = [], []
    for i, payload in enumerate([*a, *b]):
        s, c = bag(payload)
        nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        keys.append(mix(np.repeat(s, c) + mix(nth.astype(np.uint64))))
        rows.append(np.full(len(nth), i))
    key, row = np.concatenate(keys), np.concatenate(rows)
    sizes = np.bincount(row, minlength=len(a) + len(b)).astype(np.float64)
    _, column, often = np.unique(key, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common, width = np.zeros((len(a), len(b))), 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(a) + len(b), width), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        common += part[: len(a)] @ part[len(a) :].T
    return common >= SIMILARITY * (sizes[: len(a), None] + sizes[None, len(a) :] - common) - 1e-9


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, node, class_id) of every row of docs. ``tie`` is a hash of the text, which tells rows of one id apart."""
    with store.scratch(docs.sparkSession) as kept:
        signed = store.materialise(sign(docs, id_col, text_col), "signed")
        buckets = signed.where(F.col("node").isNotNull()).select("node", F.explode("bands").alias("bucket")).distinct()
        shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
        members = store.materialise(buckets.join(shared, "bucket", "left_semi"), "buckets")
        wanted = store.materialise(members.select("node").distinct(), "nodes")
        # one row of each node that is a candidate: the first by id
        rows = signed.where(F.col("node").isNotNull()).join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tie")).alias("r"))
        rows = store.materialise(rows.select(F.col("r")["doc_id"].alias("_id"), F.col("r")["tie"].alias("_tie")), "candidates")
        flags = bitmap.of(rows.select(F.xxhash64("_id", "_tie").alias("key")), "key")
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
        texts = texts.where(bitmap.passes(docs.sparkSession, flags, F.xxhash64("doc_id", "tie")))  # else all texts would be shuffled
        texts = texts.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left_semi").select("text")
        table = store.materialise(bags(texts).dropDuplicates(["node"]), "bags")
        comps = components.linked(members, table, near_pairs, near_cells)
        placed = signed.select("doc_id", "tie", "node").join(comps, "node", "left").withColumn("c", F.coalesce("component", "node"))
        placed = kept(placed.select("doc_id", "tie", "node", "c"), "placed")
    ids = placed.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("doc_id").alias("class_id"))
    own = placed.where(F.col("c").isNull()).select("doc_id", "tie", "node", F.col("doc_id").alias("class_id"))
    return placed.join(ids, "c").select("doc_id", "tie", "node", "class_id").unionByName(own)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that of the smallest id, of equal ids the one whose text hash is smallest."""
    found = store.materialise(classes(docs, id_col, text_col), "classes")
    grouped = found.where(F.col("node").isNotNull())
    first = grouped.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tie")).alias("r"))
    kept = first.select(F.col("r")["doc_id"].alias("_id"), F.col("r")["tie"].alias("_tie"))
    dropped = grouped.alias("g").join(kept.alias("k"), F.col("g.doc_id").eqNullSafe(F.col("k._id")) & (F.col("g.tie") == F.col("k._tie")), "left_anti")
    dropped = store.materialise(dropped.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct(), "dropped")
    # rows that the filter clears stay without being shuffled; the join decides about the others
    flags = bitmap.of(dropped.select(F.xxhash64("_id", "_tie").alias("key")), "key")
    suspect = bitmap.passes(docs.sparkSession, flags, F.xxhash64(docs[id_col].cast("long"), F.xxhash64(docs[text_col])))
    marked = docs.where(suspect)
    out = docs.where(~suspect).unionByName(marked.join(dropped, marked[id_col].cast("long").eqNullSafe(dropped["_id"]) & (F.xxhash64(marked[text_col]) == dropped["_tie"]), "left_anti"))
    # rows without words are classes of their own, so their repeats stay
    repeated = grouped.groupBy("doc_id", "tie").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"))
    repeated = store.materialise(repeated, "repeated")
    if not store.has_rows(repeated):
        return out
    same = out[id_col].cast("long").eqNullSafe(repeated["_id"]) & (F.xxhash64(out[text_col]) == repeated["_tie"])
    again = out.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(repeated, same, "left_anti").unionByName(again)
