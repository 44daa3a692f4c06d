"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

A benchmark item of n words gets a window size w from a ladder, the largest of which at least two aligned windows fit
into any n words in a row. Documents are cut into aligned windows of each size in use; of the items, the windows at all
offsets are taken. So wherever an item stands in a document, an aligned window of the document meets the item's window
at the same offset, whatever the alignment. Each window has a 60-bit SimHash of its word pairs (the sums of bits are
kept in fields of four bits, sixteen at a time). Fingerprints within ``RADIUS`` bits agree in one of RADIUS + 1 blocks of
bits: joining on (size, block, its bits) finds them all. A pair of windows places the whole item in the document;
there, the item and the item-sized piece of text are compared by the exact weighted Jaccard similarity of five-word
shingles (a shingle's weight is its count).

The items' windows are broadcast where they are few (``BROADCAST_ROWS``) and joined by a shuffle otherwise. Candidate
places are a table in shared storage; only documents with one are read a second time.

Defined results: null and empty texts, and items without words, match nothing; an item of under five words is one
shingle; repeated rows (same id and text) give one result; a null id is an id like any other; empty tables give an
empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillion.llm import store

LADDER = (10, 5, 2, 1)
RADIUS = 3
FIELD_BITS = 60
SHINGLE = 5
SIMILARITY = 0.8
#: Rows of the items' block table up to which it is broadcast: about 40 bytes each.
BROADCAST_ROWS = 200_000
_ONES = 0x0111111111111111  # the low bit of each of fifteen four-bit fields; the top field stays free, so sums don't overflow


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _fingerprint(hashes: Column, n: int) -> Column:
    """SimHash of n (15 at most) 64-bit hashes: bit i is set if more than half of them set it."""
    ones = F.lit(_ones := _ONES)
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in "abcd"))

    def add(acc: Column, h: Column) -> Column:
        return F.struct(*((acc[c] + F.shiftright(h, i).bitwiseAND(ones)).alias(c) for i, c in enumerate("abcd")))

    need = n // 2 + 1

    def bits(acc: Column) -> Column:
        out = None
        for i, c in enumerate("abcd"):
            top = F.shiftright((acc[c] + F.lit((8 - need) * _ones)).bitwiseAND(F.lit(_ones << 3)), 3)
            out = F.shiftleft(top, i) if out is None else out.bitwiseOR(F.shiftleft(top, i))
        return out

    return F.aggregate(hashes, zero, add, bits)


def _blocks(size: Column, fp: Column) -> Column:
    """A key for each of the RADIUS + 1 blocks of a fingerprint."""
    each = FIELD_BITS // (RADIUS + 1)
    mask = F.lit((1 << each) - 1)
    return F.array(*((size.cast("long") * 8 + b) * F.lit(1 << each) + F.shiftrightunsigned(fp, b * each).bitwiseAND(mask) for b in range(RADIUS + 1)))


def _with_hashes(df: DataFrame) -> DataFrame:
    """df (with ``words``) and the hashes of its words' pairs; the words of one-word windows are hashed alone."""
    return df.withColumn("pairs", F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)).otherwise(F.lit(0))))


def _windows(size: int, step: int) -> Column:
    """(size, start, fp) of the windows of a row with ``words`` and ``pairs``; starts are multiples of step."""
    last = F.size("pairs") - size
    if size == 1:
        fp = lambda i: _fingerprint(F.array(F.xxhash64(F.get("words", i))), 1)
    else:
        fp = lambda i: _fingerprint(F.slice("pairs", i + 1, F.lit(size - 1)), size - 1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("start"), fp(i).alias("fp")))


def window_size(n: Column) -> Column:
    """The largest size of the ladder of which two aligned windows fit into any n words in a row."""
    out = F.lit(1)
    for w in reversed(LADDER):
        out = F.when(F.floor((n - w + 1) / w) >= 2, F.lit(w)).otherwise(out)
    return out


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item_words, size, offset, fp) of the items' windows at all offsets."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0).dropDuplicates()
    rows = _with_hashes(rows.withColumn("size", window_size(F.size("words"))))
    each = F.lit(None)
    for w in LADDER:
        each = F.when(F.col("size") == w, _windows(w, 1)).otherwise(each)
    return rows.select("item_id", F.size("words").alias("item_words"), F.explode(each).alias("w")).select("item_id", "item_words", "w.size", F.col("w.start").alias("offset"), "w.fp")


def candidates(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (doc_id, tie, item_id, start): where an item may stand in a document."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # four at most
    indexed = windows.withColumn("key", F.explode(_blocks(F.col("size"), F.col("fp"))))
    if indexed.count() <= BROADCAST_ROWS:
        indexed = F.broadcast(indexed)
    rows = _with_hashes(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("tie"), words(F.col(text_col)).alias("words")))
    if not sizes:
        sizes = [LADDER[0]]
    tiles = rows.select("doc_id", "tie", F.explode(F.concat(*(_windows(w, w) for w in sizes))).alias("t"))
    probes = tiles.select("doc_id", "tie", "t.start", F.col("t.fp").alias("doc_fp"), F.explode(_blocks(F.col("t.size"), F.col("t.fp"))).alias("key"))
    near = F.bit_count(F.col("doc_fp").bitwiseXOR(F.col("fp"))) <= RADIUS
    return probes.join(indexed, "key").where(near).select("doc_id", "tie", "item_id", (F.col("start") - F.col("offset")).alias("start")).dropDuplicates()


def _shingles(ws: Column) -> Column:
    n = F.size(ws)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(n - SHINGLE + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, SHINGLE), " "))).when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles: over all shingles, the sum of the smaller counts over that of the larger."""
    sets = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    count = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    bags = common / (F.size(a) + F.size(b) - common)
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).when(plain, sets).otherwise(bags)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, tie, item_id, start, similarity): each item in each document at its best place, the first of equal ones."""
    windows = store.materialise(item_windows(items, item_id, item_text), "items")
    found = store.materialise(candidates(docs, windows, id_col, text_col), "places")
    wanted = items.select(F.col(item_id).alias("_item"), words(F.col(item_text)).alias("item")).where(F.size("item") > 0).dropDuplicates()
    read = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_tie"), F.col(text_col).alias("text"))
    keys = found.select("doc_id", "tie").dropDuplicates()
    own = read.join(keys, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))).select("doc_id", "tie", "text").dropDuplicates(["doc_id", "tie"])
    placed = found.join(wanted, found["item_id"].eqNullSafe(wanted["_item"])).select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), "item_id", "start", "item")
    own = own.select("doc_id", "tie", words(F.col("text")).alias("words"))
    at = F.greatest(F.col("start"), F.lit(0))
    both = placed.join(own, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("tie"))).select("doc_id", "tie", "item_id", "start", "item", F.slice("words", at + 1, F.greatest(F.col("start") + F.size("item") - at, F.lit(0))).alias("piece"))
    both = both.withColumn("a", _shingles(F.col("item"))).withColumn("b", _shingles(F.col("piece")))
    scored = both.select("doc_id", "tie", "item_id", "start", similarity(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("doc_id", "tie", "item_id").agg(F.min(F.struct(-F.col("similarity"), F.col("start"))).alias("m"))
    return best.select("doc_id", "tie", "item_id", F.col("m")["start"].cast("long").alias("start"), (-F.col("m")["col1"]).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item."""
    found = matches(docs, items, id_col, text_col).select(F.col("doc_id").alias("_hit_id"), F.col("tie").alias("_hit_tie")).dropDuplicates()
    found = store.materialise(found, "contaminated")
    return docs.join(found, docs[id_col].eqNullSafe(found["_hit_id"]) & (F.xxhash64(docs[text_col]) == found["_hit_tie"]), "left_anti")
