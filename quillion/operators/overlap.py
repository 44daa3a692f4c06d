"""Best word overlap of claims with windows of long evidence, without comparing every claim with every window.

A set-similarity join with a running maximum. Words of a set are put in order, the rarest of its group first. If the first
word that two sets of m and n words share stands at i and j (from 0), they share at most o = min(m - i, n - j) words, so
their Jaccard similarity is at most o / (m + n - o). Only pairs that share a word whose bound reaches a level, and passes
what the claim has reached already, are compared; levels fall, and claims that have reached a level are done with. The last
level is zero, so results are exactly those of comparing all pairs.

Claims and windows are shuffled once, by their group, and pairs never: a task holds the windows of one cell, a group or a
part of a large one, lets the claims pass by and gives one row a claim. Windows of a large group are dealt into cells by a
hash of their words, so that equal ones meet, and its claims are copied to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.sources.shared import materialise

#: Levels of similarity in turn; the first two settle nearly all claims that are copied or reworded from their evidence.
LEVELS = (0.5, 0.2, 0.0)
#: Words of the windows of a cell, about, repeats included.
CELL_WORDS = 1 << 20
#: Pairs of claims and windows, and meetings by a word, that a task holds at once.
PAIRS = 1 << 21
#: Stands between the words of a set while it is shuffled.
_MARK = "\x1f"


def best(claims: DataFrame, windows: DataFrame, group: list[str], claim_id: list[str], levels: tuple[float, ...] = LEVELS, cell_words: int = CELL_WORDS) -> DataFrame:
    """(group, claim ids, best_overlap, n_windows, n_compared): each claim's largest Jaccard similarity with a window of its group.

    claims: group, claim ids, words (distinct). windows: group, words (distinct); they are read twice. Words hold no unit
    separator. ``n_windows`` counts the group's windows, repeats included, ``n_compared`` those that the claim was compared
    with. Claims of groups without windows, or with nulls in the group, give no row; a claim without words has 0. Levels
    fall and end with 0.
    """
    if not levels or levels[-1] != 0 or list(levels) != sorted(levels, reverse=True):
        raise ValueError("levels fall and end with 0")
    words = F.coalesce(F.array_compact("words"), F.array().cast("array<string>"))
    sent = [F.size("words").alias("_size"), F.array_join("words", _MARK).alias("_words")]
    asked = claims.dropna(subset=group).select(*group, *claim_id, words.alias("words"))
    held = windows.dropna(subset=group).select(*group, words.alias("words"))
    large = held.groupBy(*group).agg(F.sum(F.size("words") + 1).alias("n")).where(F.col("n") > cell_words)
    large = materialise(large.select(*group, F.ceil(F.col("n") / cell_words).cast("int").alias("_cells")), "long_groups")
    cut = not large.isEmpty()
    number, cell, copies = F.lit(0).cast("long"), F.lit(0), F.lit(0)
    if cut:  # a claim's rows of several cells meet again by its number
        asked = materialise(asked.select("*", F.monotonically_increasing_id().alias("_c")), "claims").join(large, group, "left")
        held = held.join(large, group, "left")
        cells = F.coalesce("_cells", F.lit(1))
        number, cell, copies = F.col("_c"), F.pmod(F.col("_hash"), cells).cast("int"), F.explode(F.sequence(F.lit(0), cells - 1))
    held = held.withColumn("_hash", F.xxhash64(F.sort_array("words")))
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in claim_id]
    left = held.select(*group, cell.alias("_cell"), F.lit(False).alias("_asks"), "_hash", *none, F.lit(None).cast("long").alias("_c"), *sent)
    right = asked.select(*group, copies.alias("_cell"), F.lit(True).alias("_asks"), F.lit(None).cast("long").alias("_hash"), *claim_id, number.alias("_c"), *sent)
    dealt = left.unionByName(right).repartition(*group, "_cell").sortWithinPartitions(*group, "_cell", "_asks", "_hash")
    found = T.StructType([T.StructField("best_overlap", T.DoubleType()), T.StructField("n_windows", T.LongType()), T.StructField("n_compared", T.LongType())])
    kept = [*group, *claim_id, "_c"]
    schema = T.StructType([*(T.StructField(c, dealt.schema[c].dataType) for c in kept), *found])
    room = PAIRS
    run = lambda batches: _run(batches, [*group, "_cell"], kept, levels, room)
    out = dealt.mapInArrow(run, schema)
    if cut:
        each = [F.first(c).alias(c) for c in (*group, *claim_id)]
        out = out.groupBy("_c").agg(*each, F.max("best_overlap").alias("best_overlap"), F.sum("n_windows").alias("n_windows"), F.sum("n_compared").alias("n_compared"))
    return out.select(*group, *claim_id, *found.names)


def _run(batches: Iterator[pa.RecordBatch], cell: list[str], kept: list[str], levels: tuple[float, ...], room: int) -> Iterator[pa.RecordBatch]:
    """Of rows in order of cell, windows first: whole cells are worked on as they are there; of the last one, its windows wait for further claims."""
    waiting = None  # windows of the open cell, each once, with its times
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).append_column("_times", pa.array(np.ones(batch.num_rows, np.int64)))
        table = (table if waiting is None else pa.concat_tables([waiting, table])).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for c in cell:
            x = table[c].combine_chunks()
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        of = np.cumsum(new)
        sets = _Sets(table, of)
        yield from _met(sets, table, of, kept, levels, room)
        open_ = np.flatnonzero(sets.single & (of == of[-1]))
        waiting = table.take(pa.array(open_)).drop_columns("_times").append_column("_times", pa.array(sets.times[open_])) if len(open_) else None


class _Sets:
    """Sets of words as numbers: each word of a cell has one, in order of how many of the cell's windows hold it."""

    def __init__(self, table: pa.Table, of: np.ndarray):
        asks = table["_asks"].to_numpy()
        size = table["_size"].to_numpy().astype(np.int64)
        some = np.flatnonzero(size > 0)
        lists = pc.split_pattern(table["_words"].combine_chunks().take(pa.array(some)), _MARK)
        if (np.diff(lists.offsets.to_numpy()) != size[some]).any():
            raise ValueError("words hold no unit separator")
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary
        row = np.repeat(some, size[some])
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
        base = max(1, len(names))
        whole = of[row] * base + rank[coded.indices.to_numpy()]
        self.single, self.times = self._distinct(table, of, asks, size, whole)
        mine = asks[row] | self.single[row]  # repeats of a window take no part
        row, whole = row[mine], whole[mine]
        keys, uid = np.unique(whole, return_inverse=True)
        df = np.bincount(uid[~asks[row]], minlength=len(keys))
        place = np.empty(len(keys), np.int64)
        place[np.lexsort((keys, df))] = np.arange(len(keys))
        word = place[uid]
        order = np.argsort(row * max(1, len(keys)) + word)
        self.row, self.word = row[order], word[order]
        first = np.searchsorted(self.row, self.row)
        self.left = size[self.row] - (np.arange(len(self.row)) - first)
        self.asks, self.size, self.words = asks, size, len(keys)

    @staticmethod
    def _distinct(table, of, asks, size, whole) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are the first of equal windows, and how many those are; equal ones stand together, by their hash."""
        n = len(asks)
        own = ~asks
        stop = np.cumsum(size)
        spread = np.repeat(np.arange(n), size)
        whole = whole[np.argsort(spread * (int(whole.max()) + 1 if len(whole) else 1) + whole, kind="stable")]
        hashes = np.zeros(n, np.int64)
        hashes[own] = pc.fill_null(table["_hash"].combine_chunks(), 0).to_numpy(zero_copy_only=False)[own]
        same = np.zeros(n, bool)
        same[1:] = own[1:] & own[:-1] & (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1]) & (size[1:] == size[:-1])
        at = np.flatnonzero(same)
        full = at[size[at] > 0]
        if len(full):  # compared word by word
            starts = np.repeat(stop[full] - size[full], size[full])
            each = np.arange(len(starts)) - np.repeat(np.cumsum(size[full]) - size[full], size[full])
            equal = whole[starts + each] == whole[starts + each - np.repeat(size[full - 1], size[full])]
            same[full] = np.logical_and.reduceat(equal, np.cumsum(size[full]) - size[full])
        single = own & ~same
        leader = np.maximum.accumulate(np.where(single, np.arange(n), 0))
        times = np.zeros(n, np.int64)
        np.add.at(times, leader[own], table["_times"].to_numpy()[own])
        return single, times


def _met(sets: _Sets, table: pa.Table, of: np.ndarray, kept: list[str], levels: tuple[float, ...], room: int) -> Iterator[pa.RecordBatch]:
    """A row for each claim of the table whose cell has windows, some claims at a time."""
    cells = int(of[-1]) + 1
    of_window = of[sets.single]
    n_windows, first = np.bincount(of_window, minlength=cells), np.searchsorted(of_window, np.arange(cells))
    times = np.bincount(of, sets.times, cells).astype(np.int64)
    claims = np.flatnonzero(sets.asks & (n_windows[of] > 0))
    if not len(claims):
        return
    mine = sets.single[sets.row]
    order = np.flatnonzero(mine)[np.argsort(sets.word[mine], kind="stable")]
    sizes = sets.size[sets.single]
    window = (np.cumsum(sets.single) - 1)[sets.row[order]]
    n, n_left = sets.size[sets.row[order]], sets.left[order]
    held = np.bincount(sets.word[order], minlength=sets.words)
    begin = np.cumsum(held) - held
    # the claims' words that some window holds
    place = np.full(len(of), -1)
    place[claims] = np.arange(len(claims))
    at = np.flatnonzero(place[sets.row] >= 0)
    at = at[held[sets.word[at]] > 0]
    claim, word, m, m_left = place[sets.row[at]], sets.word[at], sets.size[sets.row[at]], sets.left[at]
    pairs = n_windows[of[claims]]
    load = np.cumsum(np.maximum(pairs, np.bincount(claim, held[word], len(claims)).astype(np.int64)))
    a = 0
    while a < len(claims):
        b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + room, "right")))
        best, compared = np.zeros(b - a), np.zeros(b - a, np.int64)
        to = np.cumsum(pairs[a:b])
        lo, hi = np.searchsorted(claim, (a, b))
        each = held[word[lo:hi]]
        entry = np.repeat(np.arange(lo, hi), each)
        post = np.arange(len(entry)) + np.repeat(begin[word[lo:hi]] - (np.cumsum(each) - each), each)
        c = claim[entry] - a
        shift = to - pairs[a:b] - first[of[claims[a:b]]]  # from a window's number to its pair's
        key = shift[c] + window[post]
        shared = np.bincount(key, minlength=int(to[-1]))
        left, left_there = m_left[entry], n_left[post]
        least = np.minimum(left, left_there)
        bound = least / (m[entry] + n[post] - least)
        for level, above in zip(levels, (None, *levels), strict=False):
            go = (left >= m[entry] * level) & (left_there >= n[post] * level) & (bound >= level) & (bound > best[c])
            if above is not None:
                go &= best[c] < above
            meet = np.zeros(len(shared), bool)
            meet[key[go]] = True
            meet = np.flatnonzero(meet)
            who = np.searchsorted(to, meet, "right")
            both = sets.size[claims[a + who]] + sizes[meet - shift[who]] - shared[meet]
            np.maximum.at(best, who, shared[meet] / both)
            compared += np.bincount(who, minlength=b - a)
        rows = pa.array(claims[a:b])
        found = [pa.array(best), pa.array(times[of[claims[a:b]]]), pa.array(compared)]
        yield pa.RecordBatch.from_arrays([*(table[x].combine_chunks().take(rows) for x in kept), *found], [*kept, "best_overlap", "n_windows", "n_compared"])
        a = b
