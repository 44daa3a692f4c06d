"""Documents scored by prediction by partial matching over bytes, from counts of all training documents.

A token is a word (or a document's end), coded byte by byte up to the space behind it. A byte's context is the ``order``
bytes of the text before it, of whatever words, with spaces before the text; shorter contexts are its suffixes (without
``across``, spaces stand before each word instead). If a context has been seen with the byte, that gives its probability;
if not, an escape leads to the next shorter context, in which bytes that the longer ones know are excluded. Below order 0,
all bytes not yet excluded are equally likely. The longest contexts count occurrences, a shorter one in how many different contexts one byte longer it came before the byte, as in an
adaptive coder a byte is only learned where it wasn't predicted.

Escapes are estimated from all contexts of the same order in which about as many distinct bytes (q) came about as often (n):
each occurrence in turn is taken out, and either its byte is still there or the context would have had to escape. To these
counts come two occurrences by the plain rule, an escape with q / 2n. What the escape leaves is shared by the bytes not
excluded, in proportion to their counts.

Each place of each text is coded. One pass cuts texts into parts and packs each part's distinct grams (contexts and bytes)
with their counts. Packs meet by cells, the last two bytes of a context, so all orders from two up are counted and coded
inside a cell, in sorted arrays; the counts of shorter contexts, 65,536 at most, and the escapes are broadcast. The costs go
back to the parts in the order of their grams, and a part's places look them up.

Above these there is one long context, which follows texts that come again: a rare word, one beyond the head of the table
of words. What it codes is a whole path of bytes, through the next rare word or the document's end. A path that came c of n
times after the word has (1 - escape) c / n; the escape, (paths that came once + 1) / (n + 2), leads to its words one by
one (without exclusion, which wastes a little but never makes a text likelier than it is). Rare words are at most a
``HEAD_WORDS``-th of the corpus each, so their windows are small parts of it at any size; paths meet by 64-bit hashes.

Nothing is sampled or pruned, and no table that grows with the corpus is broadcast, only the head of the table of words.
"""

from __future__ import annotations

from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillion.llm import store, wordcut
from quillion.llm.words import give_back, hashed, mix

SPACES = b" \t\n\x0b\x0c\r"
#: The token that ends a document; no word holds a line break.
END = "\n"
#: Rows at most of the head of the table of words; the other has no effect.
HEAD_WORDS, HEAD_BYTES = 1 << 20, 1 << 20
#: A row of paths holds so many at most.
ROW_KEYS = 512
#: Bytes of text of a part, about; grams of a pack at most; grams that a merge gathers before it sums them; that are looked up at once.
PART_BYTES, CELL_KEYS, MERGE_KEYS, LOOK_UP = 12_000_000, 4_096, 1_000_000, 2_000_000
_CELL = np.uint64(0xFFFF << 48)


def trained_on(doc_id: Column) -> Column:
    """True for documents that are learned from; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(False))


def word_counts(docs: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """(word, n, train): occurrences of each token in all documents and in those to train on; ends count too."""

    def count(batches):
        for batch in batches:
            texts, train = wordcut.plain(batch.column("text")), batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([len(train)]), pa.array([int(train.sum())])], ["word", "n", "train"])
            for a, b in wordcut.slices(texts):
                words, text, _ = wordcut.cut(texts[a:b], SPACES)
                words, codes = wordcut.numbered(words)
                n, of = np.bincount(codes, minlength=len(words)), np.bincount(codes, train[a:b][text], len(words))
                yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(of.astype(np.int64))], ["word", "n", "train"])
        give_back()

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    return rows.mapInArrow(count, "word string, n long, train long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def _stream(words: pa.Array, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What codes the texts: bytes, where each token begins (with an end after each text's words), and where each text does."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if words.buffers()[2] is not None else np.empty(0, np.uint8)
    own = np.arange(len(words)) + text  # each word's place among the tokens
    ends = np.cumsum(np.bincount(text, minlength=texts)) + np.arange(texts)
    size = np.ones(len(words) + texts, np.int64)
    size[own] += np.diff(offsets)
    begin = np.cumsum(size) - size
    stream = np.full(int(size.sum()), 32, np.uint8)
    stream[np.arange(len(data)) + np.repeat(begin[own] - offsets[:-1] + offsets[0], np.diff(offsets))] = data
    stream[begin[ends]] = 10
    return stream, begin, begin[np.append(0, ends[:-1] + 1)[:texts]]


def _grams(stream: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """Each byte with its context as one number: the byte lowest, the one before it highest, so that a context's are neighbours.

    Before each place of ``begin`` stand spaces.
    """
    at = np.full(len(stream), order, np.uint8)  # places since the last beginning, as far as they count
    for k in range(order - 1, -1, -1):
        at[(begin + k)[begin + k < len(stream)]] = k
    grid = np.zeros((len(stream), 8), np.uint8)  # written by bytes, as no second array of this size is wanted
    grid[:, 0] = stream
    for k in range(1, order + 1):
        grid[:, 8 - k] = 32
        np.copyto(grid[k:, 8 - k], stream[:-k], where=at[k:] >= k)
    return grid.view(np.uint64).ravel()


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs. Sorts keys in place."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


#: Bytes of a packed gram before compression: six of its distance to the one before, eight of its count.
_PLANES = 14


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending grams of one cell, and their counts."""
    grid = np.empty((_PLANES, len(keys)), np.uint8)
    grid[:6] = np.diff(keys, prepend=keys[:1] & _CELL).view(np.uint8).reshape(-1, 8)[:, :6].T
    grid[6:] = n.astype(np.int64).view(np.uint8).reshape(-1, 8).T
    return pa.compress(grid.tobytes(), codec="zstd", asbytes=True)


def _unpacked(cell: int, size: int, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    grid = np.frombuffer(pa.decompress(blob, _PLANES * size, codec="zstd", asbytes=True), np.uint8).reshape(_PLANES, size)
    apart = np.zeros((size, 8), np.uint8)
    apart[:, :6] = grid[:6].T
    return np.cumsum(apart.view(np.uint64).ravel(), dtype=np.uint64) + (np.uint64(cell) << np.uint64(48)), np.ascontiguousarray(grid[6:].T).view(np.int64).ravel()


def _cells(keys: np.ndarray, most: int) -> list[tuple[int, int, int, int]]:
    """(cell, number, start, stop) of runs of ``most`` ascending grams at most, whose contexts end in the same two bytes."""
    cell = (keys >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
    return [(int(cell[a]), i, x, min(b, x + most)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=False) for i, x in enumerate(range(a, b, most))]


def _pieces(batches, name: str):
    """(value, rows) of runs of equal values; a value's rows may come in several pieces."""
    for batch in batches:
        of = batch.column(name).to_numpy()
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]).tolist()
        for a, b in zip(first, [*first[1:], len(of)], strict=False):
            yield int(of[a]), batch.slice(a, b - a)


def _merged(packs: DataFrame) -> DataFrame:
    """(cell, size, blob): all grams of a cell in one row, from packs (cell, size, blob)."""

    def merge(batches):
        cell, held, total = None, [], 0

        def row():
            keys, n = _summed(*map(np.concatenate, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([_packed(keys, n)])], ["cell", "size", "blob"])

        for value, rows in _pieces(batches, "cell"):
            if value != cell and held:
                yield row()
                held, total = [], 0
            cell = value
            for size, blob in zip(rows.column("size").to_pylist(), rows.column("blob").to_pylist(), strict=True):
                held.append(_unpacked(cell, size, blob))
                total += size
                if total > MERGE_KEYS + 2 * len(held[0][0]):
                    held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                    total = len(held[0][0])
        if held:
            yield row()
        give_back()

    return packs.select("cell", "size", "blob").repartition("cell").sortWithinPartitions("cell").mapInArrow(merge, "cell int, size int, blob binary")


def _class(x: np.ndarray) -> np.ndarray:
    """Exact up to 8, then two classes for each power of 2."""
    return np.where(x <= 8, x, np.floor(2 * np.log2(np.maximum(x, 1))) + 3).astype(np.int64)


#: Classes of counts of occurrences, and of distinct bytes.
_N_CLASSES, _Q_CLASSES = 132, 20


def _escapes(n: np.ndarray, q: np.ndarray, once: np.ndarray) -> np.ndarray:
    """[escaped or seen, class of n, class of q] over contexts, each occurrence taken out once.

    Taking out a byte that came once leaves n - 1 occurrences of q - 1 bytes and an escape; any other leaves q bytes and none.
    """
    out = np.zeros((2, _N_CLASSES, _Q_CLASSES), np.int64)
    lone, other = (n > 1) & (q > 1), n > 1
    np.add.at(out[0], (_class(n[lone] - 1), _class(q[lone] - 1)), once[lone])
    np.add.at(out[1], (_class(n[other] - 1), _class(q[other])), (n - once)[other])
    return out


class _Level:
    """The contexts of one order within a cell, and the bytes that came after them: grams ascending, n of each."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, k: int):
        self.grams, self.n, self.k = grams, n, k
        context = grams >> np.uint64(64 - 8 * k)
        self.first = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        self.contexts, self.q = context[self.first], np.diff(self.first, append=len(grams))
        self.total, self.once = self.summed(n), self.summed((n == 1).astype(np.int64))

    def summed(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0, np.int64)

    def shorter(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The grams one byte shorter, in how many contexts each is, and which of them each gram ends in."""
        cut = self.grams & ~(np.uint64(255) << np.uint64(64 - 8 * self.k))
        grams, of, n = np.unique(cut, return_inverse=True, return_counts=True)
        return grams, n, of


def _levels(keys: np.ndarray, train: np.ndarray, order: int) -> tuple[list[_Level], list[np.ndarray], np.ndarray]:
    """From ``order`` to ``min(order, 2)``: levels, where each level's grams are in the next one, and the last one's shorter grams."""
    grams, n, levels, of = keys[train > 0], train[train > 0], [], []
    for k in range(order, min(order, 2) - 1, -1):
        levels.append(_Level(grams, n, k))
        grams, n, at = levels[-1].shorter()
        of.append(at)
    return levels, of, grams


class _Low:
    """The orders below the cells', which all cells share: at most 65,536 counts, and every order's escapes."""

    def __init__(self, order: int, rows: list):
        self.order, self.escapes = order, np.zeros((order + 1, 2, _N_CLASSES, _Q_CLASSES), np.int64)
        pairs = np.zeros((256, 256), np.int64)
        for k, a, b, x, y in rows:
            if k >= 0:
                self.escapes[k, :, a, b] = x, y
            else:
                pairs[a, b] = x
        low = [pairs, (pairs > 0).sum(axis=0)[None]] if order > 1 else [pairs[:1]]
        self.n = low[::-1]  # by order: [context, byte]
        for k, n in enumerate(self.n):
            self.escapes[k] = _escapes(n.sum(axis=1), (n > 0).sum(axis=1), (n == 1).sum(axis=1))

    def escape(self, k: int, total: np.ndarray, q: np.ndarray) -> np.ndarray:
        at = _class(total), _class(q)
        escaped, seen = self.escapes[k, 0][at], self.escapes[k, 1][at]
        return (escaped + q / np.maximum(total, 1)) / (escaped + seen + 2)

    def costs(self, keys: np.ndarray, train: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram of a cell."""
        levels, of, last = _levels(keys, train, self.order)
        cost, left = np.zeros(len(keys)), np.arange(len(keys))
        gone_n = gone_q = np.zeros(len(keys), np.int64)  # what the longer context knows of this one's

        def step(k, total, q, n):
            nonlocal left, gone_n, gone_q
            total, q = total - gone_n, q - gone_q
            escape = self.escape(k, total, q)
            there = n > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                cost[left] += np.where(total == 0, 0.0, np.log10(np.where(there, (1 - escape) * n / np.maximum(total, 1), escape)))
            left = left[~there]
            return ~there

        for i, level in enumerate(levels):
            x = keys[left]
            if not len(x):
                return cost
            at = np.minimum(np.searchsorted(level.contexts, x >> np.uint64(64 - 8 * level.k)), max(0, len(level.contexts) - 1))
            known = level.contexts[at] == x >> np.uint64(64 - 8 * level.k) if len(level.contexts) else np.zeros(len(x), bool)
            zero = np.zeros(len(x), np.int64)
            gram = x & ~np.uint64((1 << 64 - 8 * level.k) - 256)
            if len(level.grams):
                place = np.minimum(np.searchsorted(level.grams, gram), len(level.grams) - 1)
                n, total, q = np.where(level.grams[place] == gram, level.n[place], 0), np.where(known, level.total[at], 0), np.where(known, level.q[at], 0)
            else:
                n = total = q = zero
            on = step(level.k, total, q, n)
            if i + 1 < len(levels):
                parents = levels[i + 1].n[of[i]]
            else:
                parents = self.n[-1][(last >> np.uint64(56)).astype(np.int64) if self.order > 1 else 0, (last & np.uint64(255)).astype(np.int64)][of[i]]
            excluded = level.summed(parents)
            gone_n = np.where(known, excluded[at], 0)[on] if len(excluded) else zero[on]
            gone_q = q[on]
        for k in range(len(self.n) - 1, -1, -1):
            x, n = keys[left], self.n[k]
            context = (x >> np.uint64(56)).astype(np.int64) if k else np.zeros(len(x), np.int64)
            on = step(k, n.sum(axis=1)[context], (n > 0).sum(axis=1)[context], n[context, (x & np.uint64(255)).astype(np.int64)])
            if k:
                gone_n, gone_q = ((n > 0) * self.n[k - 1][0]).sum(axis=1)[context][on], (n > 0).sum(axis=1)[context][on]
        cost[left] -= np.log10(256 - (self.n[0] > 0).sum())
        return cost


def _low(cells: DataFrame, order: int) -> _Low:
    """What the cells' costs share, from cells as ``_merged`` makes them: some 20,000 and 65,536 rows at most are gathered."""

    def count(batches):
        sums, pairs = np.zeros((order + 1, 2, _N_CLASSES, _Q_CLASSES), np.int64), np.zeros((256, 256), np.int64)
        for cell, rows in _pieces(batches, "cell"):
            levels, _, last = _levels(*_unpacked(cell, rows.column("size")[0].as_py(), rows.column("blob")[0].as_py()), order)
            for level in levels:
                sums[level.k] += _escapes(level.total, level.q, level.once)
            np.add.at(pairs, ((last >> np.uint64(56)).astype(np.int64), (last & np.uint64(255)).astype(np.int64)), 1)
        found = [np.stack([*(x := np.nonzero(sums.any(axis=1))), sums[x[0], 0, x[1], x[2]], sums[x[0], 1, x[1], x[2]]]), np.stack([np.full(len((y := np.nonzero(pairs))[0]), -1), *y, pairs[y], pairs[y]])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, axis=1)], ["k", "a", "b", "x", "y"])
        give_back()

    return _Low(order, cells.mapInArrow(count, "k long, a long, b long, x long, y long").groupBy("k", "a", "b").agg(F.sum("x"), F.sum("y")).collect())


def _trie(words: DataFrame, order: int) -> DataFrame:
    """(key, n, train): the grams of distinct words by themselves; a key's bytes are the text's, the coded one lowest."""

    def count(batches):
        for batch in batches:
            stream, begin, _ = _stream(batch.column("word"), np.arange(batch.num_rows), batch.num_rows)
            own = np.repeat(np.arange(len(begin)), np.diff(begin, append=len(stream)))
            inside = own % 2 == 0  # without the ends
            keys = _grams(stream, begin, order)[inside]
            yield pa.RecordBatch.from_arrays([pa.array(_turned(keys)), pa.array(np.ones(len(keys), np.int64)), pa.array(batch.column("train").to_numpy()[own[inside] // 2])], ["key", "n", "train"])

    return words.select("word", "train").mapInArrow(count, "key long, n long, train long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


def _turned(keys: np.ndarray) -> np.ndarray:
    """Grams with their contexts' bytes the other way round."""
    grid = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)
    return np.concatenate([grid[:, :1], grid[:, :0:-1]], axis=1).view(np.int64).ravel()


def byte_costs(trie: DataFrame, order: int) -> DataFrame:
    """(key, cost): log10 of the probability of each byte in its context. trie: (key, n, train)."""

    def pack(batches):
        for batch in batches:
            keys, n = _summed(_turned(batch.column("key").to_numpy()).view(np.uint64), batch.column("train").to_numpy())
            cells = _cells(keys, CELL_KEYS)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, *_ in cells], pa.int32()), pa.array([b - a for *_, a, b in cells], pa.int32()), pa.array([_packed(keys[a:b], n[a:b]) for *_, a, b in cells], pa.binary())], ["cell", "size", "blob"])

    cells = store.materialise(_merged(trie.select("key", "train").mapInArrow(pack, "cell int, size int, blob binary")), "ppm-cells")
    shared = trie.sparkSession.sparkContext.broadcast(_low(cells, order))

    def cost(batches):
        for cell, rows in _pieces(batches, "cell"):
            keys, n = _unpacked(cell, rows.column("size")[0].as_py(), rows.column("blob")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(_turned(keys)), pa.array(shared.value.costs(keys, n))], ["key", "cost"])

    return cells.mapInArrow(cost, "key long, cost double")


def _lists(of: np.ndarray, values: pa.Array, rows: int) -> tuple[np.ndarray, pa.ListArray]:
    """values in lists of ROW_KEYS at most by the row they are of (ascending), and which row each list is of."""
    each = np.bincount(of, minlength=rows)
    parts = -(-each // ROW_KEYS)
    row = np.repeat(np.arange(rows), parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.minimum(ROW_KEYS, each[row] - nth * ROW_KEYS)
    return row, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


#: Of paths' hashes: an odd number, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_END_HASH = np.uint64(0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _paths(word_hashes: np.ndarray, text: np.ndarray, rare: np.ndarray, cost: np.ndarray, end_cost: np.ndarray, n: int) -> dict:
    """What follows each rare word: rare holds their places among the words, text each word's text, end_cost is of each text's end."""
    last = np.append(text[rare[1:]] != text[rare[:-1]], True)[: len(rare)]
    ends = np.cumsum(np.bincount(text, minlength=n)) - 1  # each text's last word
    stop = np.where(last, ends[text[rare]], np.append(rare[1:], 0))
    through = np.concatenate([[0.0], np.cumsum(cost)])
    up, down = _powers(_BASE, len(word_hashes) + 2), _powers(_INVERSE, len(word_hashes) + 2)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(word_hashes * up[: len(word_hashes)], dtype=np.uint64)])
        path = (sums[stop + 1] - sums[rare + 1]) * down[rare] + last * _END_HASH * up[stop - rare + 1]
        path = mix(path + word_hashes[rare] * np.uint64(3))
    return {"anchor": word_hashes[rare].view(np.int64), "path": path.view(np.int64), "cost": through[stop + 1] - through[rare + 1] + last * end_cost[text[rare]], "next": np.where(last, -1, stop)}


def _coded(docs: DataFrame, training: Column, id_col: str, text_col: str, order: int, across: bool) -> DataFrame:
    """Texts in parts of about ``PART_BYTES``, and packs of each part's distinct grams with how often they are in training: one pass.

    (part, row, doc_id, train, text) and (part, cell, nth, size, blob). A part's packs in order of cell and nth have its
    distinct grams ascending, so that answers to them need no keys.
    """
    names = ["part", "cell", "nth", "size", "blob", "row", "doc_id", "train", "text"]

    def code(batches):
        row = part = TaskContext.get().partitionId() << 36
        held, total = [], 0

        def coded():
            texts = pa.concat_arrays([wordcut.plain(b.column("text")) for b in held])
            train = np.concatenate([b.column("train").to_numpy(zero_copy_only=False) for b in held])
            m = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part)), *(pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.binary())), pa.array(np.arange(row, row + m)), pa.concat_arrays([b.column("doc_id") for b in held]), pa.array(train), texts], names)
            words, text, _ = wordcut.cut(texts, SPACES)
            stream, begin, opens = _stream(words, text, m)
            keys = _grams(stream, opens if across else begin, order)
            own = np.repeat(train, np.diff(opens, append=len(stream)))
            learned, other = keys[own], keys[~own]
            del keys, own, stream, words, text
            learned, other = _counted(learned), _counted(other)
            keys, n = _summed(np.concatenate([learned[0], other[0]]), np.concatenate([learned[1], np.zeros(len(other[0]), np.int64)]))
            for cells in batched(_cells(keys, CELL_KEYS), 256):
                k = len(cells)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, part)), pa.array([c for c, *_ in cells], pa.int32()), pa.array([i for _, i, *_ in cells], pa.int32()), pa.array([b - a for *_, a, b in cells], pa.int32()),
                    pa.array([_packed(keys[a:b], n[a:b]) for *_, a, b in cells]), pa.nulls(k, pa.int64()), pa.nulls(k, held[0].column("doc_id").type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.string()),
                ], names)

        for batch in batches:
            for a, b in wordcut.slices(wordcut.plain(batch.column("text")), PART_BYTES):
                piece = batch.slice(a, b - a)
                size = pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                if held and total + size > PART_BYTES:
                    yield from coded()
                    row, part, held, total = row + sum(x.num_rows for x in held), part + 1, [], 0
                held.append(piece)
                total += size
        if held:
            yield from coded()
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    return rows.mapInArrow(code, f"part long, cell int, nth int, size int, blob binary, row long, doc_id {rows.dtypes[0][1]}, train boolean, text string")


def _answered(packs: DataFrame, cells: DataFrame, low) -> DataFrame:
    """(part, cell, nth, size, costs): the costs of each pack's grams in single precision, compressed. A cell is read first, then packs stream by."""

    def answer(batches):
        cell = keys = costs = None
        for value, rows in _pieces(batches, "cell"):
            out = []
            for part, nth, size, blob in zip(*(rows.column(c).to_pylist() for c in ("part", "nth", "size", "blob")), strict=True):
                if value != cell:  # its first row is the cell itself
                    cell = value
                    keys, train = _unpacked(cell, size, blob)
                    costs = low.value.costs(keys, train).astype(np.float32)
                else:
                    out.append((part, nth, pa.compress(costs[np.searchsorted(keys, _unpacked(cell, size, blob)[0])].tobytes(), codec="zstd", asbytes=True), size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), cell, np.int32)), pa.array([x[1] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], ["part", "cell", "nth", "size", "costs"])
        give_back()

    every = cells.select(F.lit(-1).cast("long").alias("part"), "cell", F.lit(-1).alias("nth"), "size", "blob").unionByName(packs.select("part", "cell", "nth", "size", "blob"))
    return every.repartition("cell").sortWithinPartitions("cell", "part", "nth").mapInArrow(answer, "part long, cell int, nth int, size int, costs binary")


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 7, head_words: int = HEAD_WORDS, head_bytes: int = HEAD_BYTES, across: bool = False) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row a row of docs.

    score: log10 of the probability of the document's tokens, learned from the rows where ``training`` holds. base_score:
    by tokens' counts alone, with one added to each. With ``across``, contexts reach over the beginnings of words, else spaces
    stand before each. Costs travel in single precision (seven digits). Null text is empty: one token, the end. Repeated rows,
    and repeated or null ids, are documents of their own; columns besides id, text and those of ``training`` take no part.
    order is 1 to 7. head_bytes has no effect: bytes' costs are no longer broadcast.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    spark = docs.sparkSession
    with store.scratch(spark) as kept:
        words = kept(word_counts(docs, training, text_col), "ppm-counts")
        tokens, distinct = words.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
        coded = store.materialise(_coded(docs, training, id_col, text_col, order, across), "ppm-coded")
        packs = coded.where("blob IS NOT NULL")
        cells = store.materialise(_merged(packs), "ppm-cells")
        answers = _answered(packs, cells, spark.sparkContext.broadcast(_low(cells, order)))
        found = kept(_looked_up(coded.where("blob IS NULL"), answers, words, order, across, head_words), "ppm-found")
    return _scored(found, words, int(tokens), int(distinct))


def _looked_up(texts: DataFrame, answers: DataFrame, words: DataFrame, order: int, across: bool, head_words: int) -> DataFrame:
    """A row for each text, with its tokens but for rare ones, and rows with the paths after rare words."""
    end = words.where(F.col("word") == END).select("train").first() or (0,)
    top = wordcut.head(words.where(F.col("word") != END), "n", head_words).select("word", "train").toArrow()
    shared = words.sparkSession.sparkContext.broadcast((top["word"].combine_chunks(), np.append(top["train"].to_numpy(), 0)))
    kind = dict(texts.dtypes)["doc_id"]
    names = ["row", "doc_id", "n_tokens", "n_known", "logs", "score", "first", "train", "paths"]
    path_type = pa.struct([("anchor", pa.int64()), ("path", pa.int64()), ("cost", pa.float32()), ("next", pa.string())])

    def look_up(batches):
        keys, train = shared.value
        known = np.append(train[:-1] > 0, False).astype(np.int64)
        logs = np.log10(train + 1.0)
        logs[-1] = 0.0  # words beyond the head come later

        def looked_up(held):
            answers = [rows.filter(rows.column("costs").is_valid()) for rows in held]
            rows = [r for r in (rows.filter(rows.column("row").is_valid()) for rows in held) if r.num_rows]
            answered = np.concatenate([
                np.frombuffer(pa.decompress(blob, 4 * size, codec="zstd", asbytes=True), np.float32)
                for some in answers for size, blob in zip(some.column("size").to_pylist(), some.column("costs").to_pylist(), strict=True)
            ])
            del answers, held
            texts, doc_ids, row = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("text", "doc_id", "row"))
            is_train, n = pa.concat_arrays([r.column("train") for r in rows]), len(texts)
            found, text, _ = wordcut.cut(texts, SPACES)
            stream, begin, opens = _stream(found, text, n)
            grams = _grams(stream, opens if across else begin, order)
            distinct, _ = _counted(grams.copy())
            each = np.empty(len(grams), np.float32)
            for a in range(0, len(grams), LOOK_UP):
                some = grams[a : a + LOOK_UP]
                place = np.argsort(some)
                each[a : a + LOOK_UP][place] = answered[np.searchsorted(distinct, some[place])]
            del grams, distinct, stream
            each = np.add.reduceat(each, begin, dtype=np.float64)
            own = np.arange(len(found)) + text
            cost, end_cost = each[own], np.delete(each, own)
            distinct, codes = wordcut.numbered(found)
            at = wordcut.placed(distinct, keys)[codes]
            rare = np.flatnonzero(at < 0)
            first = np.full(n, len(found))
            np.minimum.at(first, text[rare], rare)  # a text's first rare word
            sums = [np.bincount(text, x[at], n) for x in (known, logs)]
            before = np.bincount(text, cost * (np.arange(len(found)) <= first[text]), n) + end_cost * (first == len(found))
            opening = found.take(pa.array(np.where(first < len(found), first, 0), mask=first == len(found)))
            yield pa.RecordBatch.from_arrays([
                row, doc_ids, pa.array(np.bincount(text, minlength=n) + 1), pa.array(sums[0].astype(np.int64) + int(end[0] > 0)),
                pa.array(sums[1] + np.log10(end[0] + 1.0)), pa.array(before), opening, is_train, pa.nulls(n, pa.list_(path_type)),
            ], names)
            made = _paths(hashed(distinct.to_pylist())[codes], text, rare, cost, end_cost, n)
            stops = made.pop("next")
            following = found.take(pa.array(np.maximum(stops, 0), mask=stops < 0))
            of, lists = _lists(text[rare], pa.StructArray.from_arrays([pa.array(made["anchor"]), pa.array(made["path"]), pa.array(made["cost"].astype(np.float32)), following], fields=list(path_type)), n)
            zero, none, no_words = pa.array(np.zeros(len(of))), pa.array(np.zeros(len(of), np.int64)), pa.nulls(len(of), pa.string())
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays([row.take(of), pa.nulls(len(of), doc_ids.type), none, none, zero, zero, no_words, is_train.take(of), lists], names)

        part, held = None, []
        for value, rows in _pieces(batches, "part"):
            if value != part and held:
                yield from looked_up(held)
                held = []
            part = value
            held.append(rows)
        if held:
            yield from looked_up(held)
        give_back()

    every = answers.unionByName(texts.select("part", "row", "doc_id", "train", "text"), allowMissingColumns=True)
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, logs double, score double, first string, train boolean, paths array<struct<anchor: long, path: long, cost: float, next: string>>"
    return every.repartition("part").sortWithinPartitions("part", "cell", "nth", "row").mapInArrow(look_up, schema)


def _scored(found: DataFrame, words: DataFrame, tokens: int, distinct: int) -> DataFrame:
    ended = F.concat(F.lit(END), F.col("row").cast("string"))  # no word: meets nothing in the join below, in no task of its own
    after, same = Window.partitionBy("anchor"), Window.partitionBy("anchor", "path")
    paths = found.where("paths IS NOT NULL").select("row", F.col("train").cast("long").alias("train"), F.explode("paths").alias("x")).select("row", "train", "x.anchor", "x.path", "x.cost", F.coalesce("x.next", ended).alias("word"))
    met = paths.repartition("anchor").withColumn("c", F.sum("train").over(same)).withColumn("n", F.sum("train").over(after)).withColumn("once", F.sum(F.when(F.col("c") == 1, F.col("train")).otherwise(0)).over(after))
    escape = (F.col("once") + 1) / (F.col("n") + 2)
    seen = F.col("c") > 0
    score = F.when(F.col("n") == 0, F.col("cost")).when(seen, F.log10((1 - escape) * F.col("c") / F.col("n"))).otherwise(F.log10(escape) + F.col("cost"))
    tail = met.select("row", "word", score.cast("float").alias("score"))
    tail = tail.unionByName(found.where("first IS NOT NULL").select("row", F.col("first").alias("word"), F.lit(0.0).cast("float").alias("score")))
    tail = tail.join(words.where(F.col("word") != END).select("word", F.col("train").alias("times")), "word", "left")
    tail = tail.select("row", F.coalesce((F.col("times") > 0).cast("long"), F.lit(0)).alias("n_known"), F.log10(F.coalesce("times", F.lit(0)) + 1.0).alias("logs"), "score")
    parts = found.where("paths IS NULL").select("row", "doc_id", "n_tokens", "n_known", "logs", "score").unionByName(tail, allowMissingColumns=True)
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")))
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + distinct + 1)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
