"""Phrases that occur together, by Suffix-sigma: one shuffle of truncated suffixes, one stack that counts all prefixes.

Each place of a piece gives the suffix of up to ``max_n`` words that begins there. A phrase occurs as often as there are
suffixes that begin with it. Suffixes are dealt by language and first word, each part is sorted in reverse order, and one
pass keeps a stack of the open prefixes with their counts; a prefix is complete once the next suffix lacks it.

Three things keep this exact and even at any size:

* Words below ``least`` can be in no phrase that reaches it. They are counted first, and suffixes end before them.
* Equal suffixes of a task are added up before the shuffle.
* A first word may hold a third of all places. Words with over a thousandth of them are *hot* (a thousand at most); a
  suffix is dealt by its words up to the first that isn't hot. Every prefix with such a word then lies in one part; counts
  of prefixes of hot words alone are summed over the parts.

A frequent word's number stands for its language too, so phrases of different languages never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillion.llm import store, wordcut
from quillion.llm.words import give_back

SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
NO_LANGUAGE = "und"
#: A word is hot from this share of all places on.
HOT = 1000
#: Frequent words up to which the tasks get them as a table (some 30 bytes each); beyond, words are joined with theirs.
BROADCAST_WORDS = 2_000_000
#: Places whose suffixes one part holds, about.
PART_PLACES = 2_000_000
#: Frequent words below which a word's number takes 21 bits, three to a column; from there on, 32 bits and two.
NARROW_WORDS = 1 << 21


@dataclass(frozen=True)
class Layout:
    """Five words' numbers (0 where there is none) and a count, of ``bits`` bits each, as columns of whole numbers that sort like the words."""

    bits: int

    @property
    def per(self) -> int:
        return 64 // self.bits

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    @property
    def columns(self) -> list[str]:
        return [f"k{i + 1}" for i in range(6 // self.per)]

    @property
    def suffix(self) -> str:
        return ", ".join(f"{c} long" for c in self.columns)

    @property
    def prefix(self) -> str:
        return f"{self.suffix}, n long"

    def word(self, i: int) -> Column:
        """The i-th word of a row."""
        column, after = self.columns[i // self.per], self.bits * (self.per - 1 - i % self.per)
        return F.shiftright(column, after).bitwiseAND(F.lit(self.mask))

    def packed(self, grid: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Columns of rows of up to five numbers and n; a row whose n is too large becomes several that add up to it."""
        if len(n) and n.max() > self.mask:
            times = np.maximum(1, -(-n // self.mask))
            grid, part = np.repeat(grid, times, axis=1), np.full(times.sum(), self.mask)
            part[np.cumsum(times) - 1] = n - (times - 1) * self.mask
            n = part
        full = np.zeros((6, grid.shape[1]), np.int64)
        full[: len(grid)], full[5] = grid, n
        columns = full.reshape(6 // self.per, self.per, -1)
        out = columns[:, 0]
        for i in range(1, self.per):
            out = out << self.bits | columns[:, i]
        return list(out)

    def unpacked(self, columns: list[np.ndarray]) -> np.ndarray:
        """The six numbers of each row."""
        return np.stack([c >> self.bits * (self.per - 1 - i) & self.mask for c in columns for i in range(self.per)])

    def batch(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [*self.columns, "n"][: len(columns)])


def _words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text) under names of our own."""
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(language, rows' numbers in the batch) slice by slice."""
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    texts = wordcut.plain(batch.column("text"))
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        own = texts.take(pa.array(rows))
        for a, b in wordcut.slices(own):
            yield lang, own[a:b], rows[a:b]


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) over all occurrences."""

    def count(batches):
        for batch in batches:
            for lang, texts, _ in _by_language(batch):
                words, codes = wordcut.numbered(wordcut.cut(texts, SPACES, BREAKS)[0])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.bincount(codes, minlength=len(words)))], ["lang", "word", "n"])
        give_back()

    return _words(docs, text_col, lang_col).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _numbered(frequent: DataFrame) -> DataFrame:
    """frequent (lang, word, n) with a number from 1, the most frequent words first; made without one task for all."""

    def place(batches):
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
            at += n

    ordered = frequent.sort(F.desc("n"), "lang", "word")
    table = store.materialise(ordered.mapInArrow(place, "lang string, word string, n long, part long, at long"), "collocation-words")
    sizes = sorted((r["part"], r["count"]) for r in table.groupBy("part").count().collect())  # a row a partition
    before, rows = 0, []
    for part, size in sizes:
        rows.append((part, before))
        before += size
    offsets = frequent.sparkSession.createDataFrame(rows or [(0, 0)], "part long, before long")
    return table.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("at") + 1).alias("id"), "lang", "word", "n")


def _suffixes(ids: np.ndarray, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct suffixes of two words or more (a row of max_n numbers each, 0 where there is none), and how often each occurs.

    ids: words' numbers one after another, with 0 at every border that no phrase may cross.
    """
    ids = ids.astype(np.int32)
    grid = np.zeros((max_n, len(ids)), np.int32)
    alive = ids > 0
    grid[0] = ids
    for k in range(1, max_n):
        alive[: len(ids) - k] &= ids[k:] > 0
        alive[max(0, len(ids) - k) :] = False
        grid[k, : max(0, len(ids) - k)] = ids[k:]
        grid[k][~alive] = 0
    grid = grid[:, grid[1] > 0]
    grid = grid[:, np.lexsort(grid[::-1])]
    new = np.ones(grid.shape[1], bool)
    new[1:] = (grid[:, 1:] != grid[:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return grid[:, at], np.diff(np.append(at, grid.shape[1]))


def _bordered(ids: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """ids with a 0 wherever the piece changes."""
    at = np.flatnonzero(np.diff(piece)) + 1
    return np.insert(ids, at, 0)


def _suffix_rows(docs: DataFrame, known: DataFrame, layout: Layout, max_n: int, broadcast_words: int, text_col: str, lang_col: str) -> DataFrame:
    """Columns of the layout: each task's distinct suffixes. known: (id, lang, word)."""
    texts = _words(docs, text_col, lang_col)
    if known.count() <= broadcast_words:
        table = known.select("lang", "word", F.col("id").cast("long")).toArrow()
        langs = table["lang"].to_numpy(zero_copy_only=False) if table.num_rows else np.empty(0, object)
        words, ids = table["word"].combine_chunks(), table["id"].to_numpy()
        each = {str(lang): (words.take(pa.array(at := np.flatnonzero(langs == lang))), np.append(ids[at], 0)) for lang in set(langs)}
        shared = docs.sparkSession.sparkContext.broadcast(each)

        def look_up(batches):
            for batch in batches:
                for lang, part, _ in _by_language(batch):
                    if lang in shared.value:
                        known_words, numbers = shared.value[lang]
                        found, _, piece = wordcut.cut(part, SPACES, BREAKS)
                        distinct, codes = wordcut.numbered(found)
                        at = wordcut.placed(distinct, known_words)  # -1: the 0 at the end
                        yield layout.batch(layout.packed(*_suffixes(_bordered(numbers[at][codes], piece), max_n)))
            give_back()

        return texts.mapInArrow(look_up, layout.suffix)

    def places(batches):
        doc, part = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for lang, rows, _ in _by_language(batch):
                found, text, piece = wordcut.cut(rows, SPACES, BREAKS)
                if len(found):
                    row = part + doc + text
                    doc += int(text[-1]) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.arange(len(found))), pa.array(piece), pa.array([lang] * len(found), pa.string()), found], ["row", "at", "piece", "lang", "word"])

    every = store.materialise(texts.mapInArrow(places, "row long, at long, piece long, lang string, word string"), "collocation-places")
    numbers = every.join(known.select("lang", "word", "id"), ["lang", "word"], "left")
    rows = numbers.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "piece", F.coalesce("id", F.lit(0)).cast("long").alias("id")))).alias("words"))

    def joined(batches):
        for batch in batches:
            flat = batch.column("words").flatten()  # a list a text
            text = batch.column("words").value_parent_indices().to_numpy()
            ids, piece = flat.field("id").to_numpy(), flat.field("piece").to_numpy()
            border = np.flatnonzero((np.diff(text) != 0) | (np.diff(piece) != 0)) + 1
            yield layout.batch(layout.packed(*_suffixes(np.insert(ids, border, 0), max_n)))

    return rows.select("words").mapInArrow(joined, layout.suffix)


def _dealt_by(layout: Layout, hot: int) -> Column:
    """The hash of a suffix's words up to the first that isn't hot."""
    found = F.hash(*(layout.word(i) for i in range(5)))
    for i in reversed(range(4)):
        found = F.when(layout.word(i) > hot, F.hash(*(layout.word(j) for j in range(i + 1)))).otherwise(found)
    return found


def _stack(layout: Layout, max_n: int, least: int, hot: int):
    """Counts of all prefixes of two words or more, from suffixes in order."""

    def count(batches):
        last, counts = None, [0] * (max_n + 1)  # the open suffix, and the counts of its prefixes by length
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = layout.unpacked([c.to_numpy() for c in batch.columns])
            rows, n = numbers[:max_n], numbers[5]
            before = np.concatenate([(np.full(max_n, -1) if last is None else last)[:, None], rows], axis=1)
            changed = np.zeros(len(n), bool)
            for depth in range(1, max_n + 1):
                changed |= before[depth - 1, 1:] != before[depth - 1, :-1]
                if depth > 1:
                    starts = np.flatnonzero(changed)
                    opens = np.concatenate([[0], starts + 1]).astype(np.int64)  # in before; the first one was open already
                    sums = np.add.reduceat(np.concatenate([[counts[depth]], n]), opens)
                    counts[depth] = int(sums[-1])
                    closed = before[:depth, opens[:-1]]
                    yield from _closed(layout, closed, sums[:-1], depth, least, hot)
            last = rows[:, -1]
        for depth in range(2, max_n + 1):
            if last is not None:
                yield from _closed(layout, last[:depth, None], np.array([counts[depth]]), depth, least, hot)
        give_back()

    return count


def _closed(layout: Layout, prefix: np.ndarray, n: np.ndarray, depth: int, least: int, hot: int) -> Iterator[pa.RecordBatch]:
    keep = (prefix[depth - 1] > 0) & ((n >= least) | (prefix <= hot).all(axis=0))
    if keep.any():
        yield layout.batch([*layout.packed(prefix[:, keep], np.zeros(keep.sum(), np.int64)), n[keep].astype(np.int64)])


def frequent_phrases(docs: DataFrame, counts: DataFrame, max_n: int = 5, least: int = 100, broadcast_words: int = BROADCAST_WORDS, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): (id, lang, word, n), and (words: array of ids, n) of phrases of 2 to max_n (5 at most) words. counts: ``word_counts(docs)``."""
    if not 2 <= max_n <= 5:
        raise ValueError("max_n must be 2 to 5")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    words = store.materialise(_numbered(counts.where(F.col("n") >= least)), "collocation-numbers")
    hot = words.where(F.col("n") * HOT >= total).count()
    layout = Layout(21 if words.count() < NARROW_WORDS else 32)
    suffixes = _suffix_rows(docs, words, layout, max_n, broadcast_words, text_col, lang_col)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_PLACES)
    dealt = suffixes.repartition(parts, _dealt_by(layout, hot)).sortWithinPartitions(*(F.desc(c) for c in layout.columns))
    found = dealt.mapInArrow(_stack(layout, max_n, least, hot), layout.prefix).groupBy(*layout.columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return words, store.materialise(found.select(F.filter(F.array(*(layout.word(i) for i in range(5))), lambda x: x > 0).alias("words"), "n"), "collocation-phrases")


#: 1000 a n / (l r), rounded down; products of counts up to 10**17 fit.
_SCORE = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(total as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def mine(docs: DataFrame, max_n: int = 5, least: int = 100, percent: int = 100, first: int = 2000, broadcast_words: int = BROADCAST_WORDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` best collocations.

    A candidate occurs ``a`` >= least times. Of its cuts into two parts, which occur l and r times, the one with the least
    score counts (ties: the shorter first part). Candidates inside a longer one that occurs ``percent`` % as often or more
    go. As a phrase occurs as often as any longer one around it or more often, looking one word further is enough. Order:
    score, then a (both descending), then the phrase by its bytes. Null text is empty, null language ``und``; a corpus
    without frequent words gives no rows. Rows count as often as they are there, whatever other columns hold.
    """
    counts = store.materialise(word_counts(docs, text_col, lang_col), "collocation-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words, phrases = frequent_phrases(docs, counts, max_n, least, broadcast_words, text_col, lang_col)
    size = F.size("words")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("words"), F.col("n").alias("longer"))
    longest = inner.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longest, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n"))).select("words", F.col("n").alias("a"))
    parts = phrases.unionByName(words.select(F.array("id").alias("words"), "n"))
    cuts = kept.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("*", F.expr("slice(words, 1, k)").alias("left"), F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    cuts = cuts.join(parts.select(F.col("words").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("words").alias("right"), F.col("n").alias("r")), "right")
    language = words.select(F.col("id").alias("_first"), "lang").join(totals, "lang")
    scored = cuts.withColumn("_first", F.get("words", F.lit(0))).join(language, "_first").withColumn("score", F.expr(_SCORE))
    best = scored.groupBy("words").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = best.select("words", F.posexplode("words").alias("at", "id")).join(words.select("id", "word"), "id").groupBy("words").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    rows = best.join(spelt, "words").select("lang", F.array_join("spelt.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, first: int = 2000) -> str:
    """``mine`` over ``documents`` in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH p AS (SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, unnest(list_transform(range(0, least(5, len(w) - i + 1)), lambda k: array_to_string(w[i : i + k], ' '))) AS phrase FROM s),
f AS (SELECT lang, phrase, count(*)::BIGINT AS f, len(string_split(phrase, ' ')) AS size FROM g GROUP BY ALL HAVING count(*) >= {least}),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, f.phrase, f.f AS a, f.size, string_split(f.phrase, ' ') AS w FROM f WHERE f.size > 1),
inside AS (SELECT lang, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:size], ' ')]) AS phrase, a AS longer FROM c WHERE size > 2),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.longer >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts c JOIN t USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM best
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {first}"""
