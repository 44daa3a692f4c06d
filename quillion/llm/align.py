"""Two tokenizers' cuts of the same texts, aligned by byte offsets, and how often their ids stand for each other.

A whole batch of texts is laid end to end. Each tokenizer's token ends are byte offsets into it; one bincount marks A's
ends, one B's, and where both are marked the texts are cut into groups. Prefix sums over the cuts number the groups, and
differences of them at the texts' ends give each document's figures. Every A token is linked to every B token of its group.

Counts of linked id pairs over the corpus are a table of their own. Its head is broadcast (``wordcut.head``), and only
rarer pairs are joined, one row for each document and pair; a pair that every document holds thus never meets in one task.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillion.llm import store, wordcut
from quillion.llm.tokens import Encoder, _distinct, _runs
from quillion.llm.words import give_back

#: Bytes of texts that are aligned at once; a longer text is aligned by itself.
BATCH_BYTES = 2_000_000
#: Pairs in one row of the table of links; a document with more has several rows.
ROW_PAIRS = 512
#: Pairs that are written out at once, of groups of several tokens on either side.
MOST_PAIRS = 2_000_000
#: Rows of the head of the table of pairs at most (16 bytes each).
HEAD_PAIRS = 1 << 20


def _stand_ins() -> dict[str, int]:
    """Character -> byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others come after 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteEncoder(Encoder):
    """A byte-level tokenizer's ids; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special = []
        self.tokenizer.encode_special_tokens = True
        byte = _stand_ins()
        self.entries = [b""] * self.vocabulary
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.entries[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()


class PieceEncoder(Encoder):
    """A sentencepiece model's ids of texts that begin with a space, which the model is left to add.

    No piece of a word-wise model has a word's mark inside it, so words that single spaces or line breaks begin can be
    encoded apart; a model for which that isn't so gets whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        from quillion.llm.tokens import Words

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        self.special = []
        self.vocabulary = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(self.vocabulary)]
        self.entries = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        space, line = self.pieces.piece_to_id("▁"), self._ids("\n").tolist()
        self.by_word = len(line) == 1 and names[space] == "▁" and not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        self.words = Words()
        if self.by_word:
            self.words.add(np.array([[10, 32], [0, 0], [0, 0]], np.uint64), np.array([1, 1]), np.array([line[0], space]))

    def _ids(self, text: str) -> np.ndarray:
        made = self.pieces.encode(text[1:], num_threads=1) if text[:1] == " " else self.pieces.encode(text, num_threads=1)[1:]
        return np.asarray(made, np.uint32)

    def _learn(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        lanes = self._lanes(data, at, size)
        new = _distinct(lanes)
        new = new[self.words.find(lanes[:, new]) < 0]
        for lead, skip in ((32, 0), (10, 1)):
            part = new[data[at[new]] == lead]
            made = self.pieces.encode([data[a + 1 - skip : a + n].tobytes().decode() for a, n in zip(at[part].tolist(), size[part].tolist(), strict=True)], num_threads=1)
            made = [x[skip:] for x in made] if skip else made
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            self.words.add(lanes[:, part], sizes, np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(sizes.sum())))


class Entries:
    """A vocabulary's entries as bytes in one array, and ids written as decimal numbers."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), np.int64, len(entries))
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_runs(self.begin[ids], self.size[ids])]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteEncoder(a_path), PieceEncoder(b_path)
        self.a_entries, self.b_entries = Entries(self.a.entries), Entries(self.b.entries)
        most = max(self.a.vocabulary, self.b.vocabulary)
        numbers = [str(i).encode() for i in range(most)]
        self.digits = np.array([len(x) for x in numbers])
        self.decimal = np.frombuffer(b"".join(x.ljust(8) for x in numbers), np.uint8).reshape(most, 8)

    def _tokens(self, encoder: Encoder, entries: Entries, texts: list[bytes], data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each text has, and which texts' tokens make up its bytes."""
        ids, counts = encoder._chunk(texts)
        ids = ids.astype(np.int64)
        before = np.concatenate([[0], np.cumsum(entries.size[ids])])
        last = np.cumsum(counts)
        size = before[last] - before[last - counts]
        same = size == np.diff(starts)
        if len(data) == before[-1] and same.all() and (entries.joined(ids) == data).all():
            return ids, counts, same
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(entries.joined(ids[last[i] - counts[i] : last[i]]), data[starts[i] : starts[i + 1]])
        return ids, counts, same

    def align(self, texts: list[bytes]) -> dict:
        """Figures of texts that each begin with a space, and their links: rows of (text, A id, B id, times), each once."""
        starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        a, a_counts, a_same = self._tokens(self.a, self.a_entries, texts, data, starts)
        b, b_counts, b_same = self._tokens(self.b, self.b_entries, texts, data, starts)
        good = a_same & b_same
        if not good.all():
            a, b = a[np.repeat(good, a_counts)], b[np.repeat(good, b_counts)]
            a_counts, b_counts = a_counts * good, b_counts * good
            starts = np.concatenate([[0], np.cumsum(np.diff(starts) * good)])
        a_ends, b_ends = np.cumsum(self.a_entries.size[a]), np.cumsum(self.b_entries.size[b])
        end = int(starts[-1])
        cut = (np.bincount(a_ends, minlength=end + 1) > 0) & (np.bincount(b_ends, minlength=end + 1) > 0)
        cuts = np.cumsum(cut)  # at an offset: the groups that end there or before
        a_group, b_group = cuts[a_ends - 1], cuts[b_ends - 1]
        n_groups = int(cuts[end]) if end else 0
        text_groups = np.concatenate([[0], cuts[starts[1:]]]) if end else np.zeros(len(texts) + 1, np.int64)
        in_a, in_b = np.bincount(a_group, minlength=n_groups), np.bincount(b_group, minlength=n_groups)
        links = np.concatenate([[0], np.cumsum(in_a * in_b)])
        group_text = np.repeat(np.arange(len(texts)), np.diff(text_groups))
        return {
            "n_a": a_counts, "n_b": b_counts, "n_groups": np.diff(text_groups), "n_links": links[text_groups[1:]] - links[text_groups[:-1]],
            "groups": self._written(a, b, a_group, b_group, in_a, in_b, text_groups, np.cumsum(a_counts) + np.cumsum(b_counts)), "pairs": self._pairs(a, b, in_a, in_b, group_text),
        }

    def _written(self, a, b, a_group, b_group, in_a, in_b, text_groups, tokens_through) -> list[memoryview]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        total = len(a) + len(b)
        ids, mark = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        a_before, b_before = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        a_at = np.arange(len(a)) + b_before[a_group]
        b_at = np.arange(len(b)) + (a_before + in_a)[b_group]
        ids[a_at], ids[b_at] = a, b
        mark[a_before + b_before + in_a - 1] = ord("|")
        mark[a_before + b_before + in_a + in_b - 1] = ord(";")
        digits = self.digits[ids]
        ends = np.cumsum(digits + 1)
        out = np.zeros(int(ends[-1]) if total else 0, np.uint8)
        begin = ends - digits - 1
        for k in range(int(digits.max()) if total else 0):
            long = digits > k
            out[begin[long] + k] = self.decimal[ids[long], k]
        out[ends - 1] = mark
        stops = np.concatenate([[0], ends])[tokens_through] if total else np.zeros(len(tokens_through), np.int64)
        view = memoryview(out)
        return [view[s : max(s, e - 1)] for s, e in zip(np.concatenate([[0], stops[:-1]]).tolist(), stops.tolist(), strict=True)]

    def _pairs(self, a, b, in_a, in_b, group_text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of distinct links, by text and pair; a pair is A's id times B's vocabulary and B's id."""
        a_begin, b_begin = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        made = []
        size = in_a * in_b
        large = np.flatnonzero(size > MOST_PAIRS)
        for g in large.tolist():  # ids repeat in so long a group
            ua, na = np.unique(a[a_begin[g] : a_begin[g] + in_a[g]], return_counts=True)
            ub, nb = np.unique(b[b_begin[g] : b_begin[g] + in_b[g]], return_counts=True)
            made.append((np.full(len(ua) * len(ub), group_text[g]), (ua[:, None] * self.b.vocabulary + ub).ravel(), (na[:, None] * nb).ravel()))
        rest = np.flatnonzero(size <= MOST_PAIRS)
        through = np.cumsum(size[rest])
        start = 0
        while start < len(rest):
            base = through[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(through, base + MOST_PAIRS, "right")))
            g = rest[start:stop]
            of, k = np.repeat(g, size[g]), _runs(np.zeros(len(g), np.int64), size[g])
            pair = a[a_begin[of] + k // in_b[of]] * self.b.vocabulary + b[b_begin[of] + k % in_b[of]]
            made.append(_summed(group_text[of], pair, None))
            start = stop
        if not made:
            return (np.empty(0, np.int64),) * 3
        return made[0] if len(made) == 1 and not len(large) else _summed(*(np.concatenate([m[i] for m in made]) for i in range(3)))


def _summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (text, pair) added up, in order."""
    order = np.lexsort((pair, text)) if len(text) and text[-1] >= 1 << 20 else np.argsort(text << 42 | pair, kind="stable")
    text, pair = text[order], pair[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return text[at], pair[at], np.diff(np.append(at, len(text))) if times is None else np.add.reduceat(times[order], at)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This process's aligner for the two files."""
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]): each document's alignment and links.

    pairs holds the document's distinct linked id pairs (A's id times B's vocabulary plus B's id), times how many links each
    has. A document with over ``ROW_PAIRS`` of them has further rows, with its row number and links alone. row is only
    fixed once the result is written. Null or empty texts, and those that a tokenizer doesn't give back whole, have zeros.
    """
    kind = dict(docs.dtypes)[id_col] if id_col in docs.columns else docs.select(id_col).dtypes[0][1]
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>" + ", groups string" * with_groups

    def run(batches):
        tool, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for start, stop in wordcut.slices(column, BATCH_BYTES):
                yield _rows(tool, ids[start:stop], column[start:stop].cast(pa.binary()).to_pylist(), row + start, with_groups)
            row += batch.num_rows
        give_back()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _rows(tool: Aligner, ids: pa.Array, texts: list[bytes | None], row: int, with_groups: bool) -> pa.RecordBatch:
    full = np.array([i for i, x in enumerate(texts) if x], np.int64)
    found = tool.align([b" " + texts[i] for i in full]) if len(full) else {k: np.empty(0, np.int64) for k in _FIGURES} | {"groups": [], "pairs": (np.empty(0, np.int64),) * 3}
    figures = np.zeros((4, len(texts)), np.int64)
    figures[:, full] = [found[k] for k in _FIGURES]
    written: list = [None] * len(texts)
    for i, x in zip(full.tolist(), found["groups"], strict=True):
        written[i] = x
    text, pair, times = found["pairs"]
    each = np.zeros(len(texts), np.int64)
    each[full] = np.bincount(text, minlength=len(full))
    # one row a text, and more for those with many pairs
    parts = np.maximum(1, -(-each // ROW_PAIRS))
    of = np.repeat(np.arange(len(texts)), parts)
    nth = _runs(np.zeros(len(texts), np.int64), parts)
    sizes = np.minimum(ROW_PAIRS, each[of] - nth * ROW_PAIRS)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    more = nth > 0
    columns = [pa.array(row + of), ids.take(pa.array(np.where(more, 0, of), mask=more))]
    columns += [pa.array(np.where(more, 0, x[of])) for x in figures]
    hashes = [hashlib.sha256(x).hexdigest() if x is not None and len(x) else "" for x in written]
    columns.append(pa.array(hashes, pa.string()).take(pa.array(np.where(more, 0, of), mask=more)))
    columns += [pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times))]
    if with_groups:
        columns.append(pa.array(["" if x is None else x.tobytes().decode() for x in written], pa.string()).take(pa.array(np.where(more, 0, of), mask=more)))
    names = ["row", "doc_id", *_FIGURES, "groups_sha256", "pairs", "times", "groups"][: len(columns)]
    return pa.RecordBatch.from_arrays(columns, names)


def pair_counts(links: DataFrame, b_vocabulary: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether no pair of its A id is in more. links: ``aligned``, written."""
    counts = store.materialise(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "align-pairs")
    a = F.expr(f"pair div {b_vocabulary}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))  # no more rows than A's vocabulary has
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summary(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row a row of docs.

    n_best: links whose pair is in as many documents as any pair of its A id; count_sum: the sum of all links' counts.
    Repeated rows, and repeated or null ids, are documents of their own; columns besides id and text take no part.
    """
    import sentencepiece

    links = store.materialise(aligned(docs, a_path, b_path, id_col, text_col), "align-links")
    counts = store.materialise(pair_counts(links, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()), "align-counts")
    top = wordcut.head(counts, "n", head_pairs).sort("pair").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(), np.append(top["n"].to_numpy(), 0), np.append(top["best"].to_numpy().astype(np.int64), 0)))
    names = ["row", "doc_id", *_FIGURES, "groups_sha256"]

    def look_up(batches):
        keys, n, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            flat = pairs.flatten()
            of = pairs.value_parent_indices().to_numpy()
            distinct, code = np.unique(flat.to_numpy(), return_inverse=True)
            at = np.searchsorted(keys, distinct)
            at[at == len(keys)] = -1
            at[keys[at] != distinct] = -1  # n and best end with a 0
            at = at[code]
            total, good = (np.bincount(of, times * x[at], batch.num_rows).astype(np.int64) for x in (n, best))
            rest = at < 0
            sizes = np.bincount(of[rest], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            rare = [pa.ListArray.from_arrays(offsets, pa.array(x[rest])) for x in (flat.to_numpy(), times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(good), pa.array(total), *rare], [*names, "n_best", "count_sum", "pairs", "times"])
        give_back()

    def look_up_all(batches):
        if len(shared.value[0]):
            yield from look_up(batches)
        else:  # no pairs at all
            for batch in batches:
                zero = pa.array(np.zeros(batch.num_rows, np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), zero, zero, batch.column("pairs"), batch.column("times")], [*names, "n_best", "count_sum", "pairs", "times"])

    kind = dict(links.dtypes)
    found = store.materialise(links.mapInArrow(look_up_all, ", ".join(f"{c} {kind[c]}" for c in names) + ", n_best long, count_sum long, pairs array<long>, times array<long>"), "align-found")
    rare = found.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "pair").select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    rows = found.drop("pairs", "times").unionByName(rare, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_FIGURES, "n_best", "count_sum")]
    out = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    return out.select("doc_id", *_FIGURES, "n_best", "count_sum", "groups_sha256")
