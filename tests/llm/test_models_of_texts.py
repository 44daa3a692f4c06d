"""Language-model scores, alignment and collocations against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillion.llm import align, collocations, ppm, wordcut

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  The THE\tthe\x0band a  b "), (5, "É é end."), (6, "x" * 3000), (7, "a b a b a. the cat"), (7, "a b a b a. the cat"), (None, "the a"), (11, "zebra unseen"),
    (12, "<|endoftext|> x</s>"), (13, "a▁b"), (14, "日本語 text é\t\x00z"), (15, "The cat sat.\nThe dog"), (16, "\n"), (17, "a "), (18, "\na"), (19, "word\r\nnext"), (20, "ab" * 2000 + "é"),
    *((100 + i, f"the cat sat on the mat, number {i % 7}! the cat sat") for i in range(30)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[n % 3], "name", n) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, n long").repartition(3).cache()


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", low(text)), "\n"]


class Model:
    """Prediction by partial matching as dictionaries."""

    def __init__(self, rows, order, head):
        train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
        self.order, self.count = order, Counter(w for t in train for w in tokens(t))
        levels = {order: Counter()}
        for w, c in self.count.items():
            for g in self.coded(w):
                levels[order][g] += c
        for k in range(order - 1, -1, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        self.nodes = {k: defaultdict(dict) for k in levels}
        self.seen = {k: defaultdict(lambda: [0, 0]) for k in levels}
        for k, grams in levels.items():
            for g, c in grams.items():
                self.nodes[k][g[:-1]][g[-1]] = c
            for node in self.nodes[k].values():
                n, q, once = sum(node.values()), len(node), sum(c == 1 for c in node.values())
                if n > 1:
                    self.seen[k][self.kind(n - 1), self.kind(q)][1] += n - once
                    if q > 1:
                        self.seen[k][self.kind(n - 1), self.kind(q - 1)][0] += once
        every = Counter(w for _, t in rows for w in tokens(t)[:-1])
        self.rare = {w for w, c in every.items() if c < max(1, -(-sum(every.values()) // head))}
        self.after = defaultdict(Counter)
        for t in train:
            for w, path in self.paths(t):
                self.after[w][path] += 1

    @staticmethod
    def kind(x):
        return x if x <= 8 else math.floor(2 * math.log2(x)) + 3

    def coded(self, word):
        b = b"\n" if word == "\n" else word.encode() + b" "
        padded = b" " * self.order + b
        return [padded[i : i + self.order + 1] for i in range(len(b))]

    def paths(self, text):
        w = tokens(text)
        at = [i for i, x in enumerate(w) if x in self.rare]
        for i, j in zip(at, [*at[1:], len(w) - 1], strict=False):
            yield w[i], tuple(w[i + 1 : j + 1])

    def byte(self, g):
        out, total = set(), 0.0
        for k in range(self.order, -1, -1):
            h = g[self.order - k :]
            node = {s: c for s, c in self.nodes[k].get(h[:-1], {}).items() if s not in out}
            if not node:
                continue
            n, q = sum(node.values()), len(node)
            escaped, seen = self.seen[k].get((self.kind(n), self.kind(q)), (0, 0))
            escape = (escaped + q / n) / (escaped + seen + 2)
            if h[-1] in node:
                return total + math.log10((1 - escape) * node[h[-1]] / n)
            total += math.log10(escape)
            out |= set(node)
        return total - math.log10(256 - len(out))

    def word(self, w):
        return sum(map(self.byte, self.coded(w)))

    def text(self, text):
        w = tokens(text)
        first = next((i for i, x in enumerate(w) if x in self.rare), len(w) - 1)
        total = sum(map(self.word, w[: first + 1]))
        for x, path in self.paths(text):
            own, n = sum(map(self.word, path)), sum(self.after[x].values())
            if n:
                escape = (sum(c == 1 for c in self.after[x].values()) + 1) / (n + 2)
                own = math.log10((1 - escape) * self.after[x][path] / n) if self.after[x][path] else math.log10(escape) + own
            total += own
        return total


@pytest.mark.parametrize(("order", "head"), [(7, 1 << 20), (3, 10), (5, 30), (7, 2)])
def test_language_model_equals_brute_force(docs, order, head):
    model = Model(ODD, order, head)
    n, v = sum(model.count.values()), len(model.count)
    want = [(i, len(tokens(t)), sum(model.count[w] > 0 for w in tokens(t)), n, sum(math.log10((model.count[w] + 1) / (n + v + 1)) for w in tokens(t)), model.text(t)) for i, t in ODD]
    got = ppm.scores(docs, ppm.trained_on(F.col("doc_id")), order=order, head_words=head, head_bytes=head).collect()
    for g, w in zip(ordered(got), ordered(want), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-6)


class Across(Model):
    """The same with contexts that reach over the beginnings of words."""

    def __init__(self, rows, order, head):
        super().__init__(rows, order, head)
        self.levels([t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2])

    def places(self, text):
        """The grams of each token."""
        before, out = b" " * self.order, []
        for w in tokens(text):
            b = b"\n" if w == "\n" else w.encode() + b" "
            padded = before + b
            out.append([padded[i : i + self.order + 1] for i in range(len(b))])
            before = padded[-self.order :]
        return out

    def levels(self, train):
        levels = {self.order: Counter(g for t in train for token in self.places(t) for g in token)}
        for k in range(self.order - 1, -1, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        self.nodes = {k: defaultdict(dict) for k in levels}
        self.seen = {k: defaultdict(lambda: [0, 0]) for k in levels}
        for k, grams in levels.items():
            for g, c in grams.items():
                self.nodes[k][g[:-1]][g[-1]] = c
            for node in self.nodes[k].values():
                n, q, once = sum(node.values()), len(node), sum(c == 1 for c in node.values())
                if n > 1:
                    self.seen[k][self.kind(n - 1), self.kind(q)][1] += n - once
                    if q > 1:
                        self.seen[k][self.kind(n - 1), self.kind(q - 1)][0] += once

    def text(self, text):
        w = tokens(text)
        each = [sum(map(self.byte, token)) for token in self.places(text)]
        at = [i for i, x in enumerate(w) if x in self.rare]
        total = sum(each[: (at or [len(w) - 1])[0] + 1])
        for i, j, (x, path) in zip(at, [*at[1:], len(w) - 1], self.paths(text), strict=False):
            own, n = sum(each[i + 1 : j + 1]), sum(self.after[x].values())
            if n:
                escape = (sum(c == 1 for c in self.after[x].values()) + 1) / (n + 2)
                own = math.log10((1 - escape) * self.after[x][path] / n) if self.after[x][path] else math.log10(escape) + own
            total += own
        return total


@pytest.mark.parametrize(("order", "head", "small"), [(7, 1 << 20, False), (3, 10, True), (1, 30, True), (2, 30, False), (7, 2, True)])
def test_contexts_reach_over_words(docs, order, head, small, monkeypatch):
    for name in ("PART_BYTES", "CELL_KEYS", "MERGE_KEYS", "LOOK_UP") if small else ():
        monkeypatch.setattr(ppm, name, 3)
    model = Across(ODD, order, head)
    want = [(i, len(tokens(t)), model.text(t)) for i, t in ODD]
    got = ppm.scores(docs, ppm.trained_on(F.col("doc_id")), order=order, head_words=head, across=True).select("doc_id", "n_tokens", "score").collect()
    for g, w in zip(ordered(got), ordered(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-6)


def test_words_are_likelier_after_words_they_follow(spark):
    texts = ["old cat new dog"] * 40 + ["new cat", "old cat"]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2]
    kept = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*zip(kept, texts[:40], strict=False), *zip(held, texts[40:], strict=False)]
    found = {r["doc_id"]: r["score"] for r in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string"), ppm.trained_on(F.col("doc_id")), across=True).collect()}
    apart = {r["doc_id"]: r["score"] for r in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string"), ppm.trained_on(F.col("doc_id"))).collect()}
    assert found[held[1]] - found[held[0]] > apart[held[1]] - apart[held[0]] + 1


def test_packs_of_grams_hold_any_count():
    keys = np.array([0x6162_0000_0000_0063, 0x6162_0000_0000_0064, 0x6162_FFFF_FFFF_FFFF], np.uint64)
    n = np.array([0, 1 << 40, 3])
    back = ppm._unpacked(0x6162, 3, ppm._packed(keys, n))
    assert (back[0] == keys).all() and (back[1] == n).all()


def test_bytes_probabilities_sum_to_one(spark):
    text = "abra cadabra abracadabra"
    words = spark.createDataFrame([(w, 1, 1) for w in text.split()], "word string, n long, train long")
    context = int.from_bytes(b"    abr", "big") << 8
    extra = spark.createDataFrame([(context + b, 1, 0) for b in range(256) if b != ord("a")], "key long, n long, train long")
    costs = ppm.byte_costs(ppm._trie(words, 7).unionByName(extra).cache(), 7)
    assert sum(10 ** r["cost"] for r in costs.where(F.shiftrightunsigned("key", 8) == context >> 8).collect()) == pytest.approx(1)


def test_language_model_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ppm.scores(none, ppm.trained_on(F.col("doc_id"))).collect() == []


def test_copies_of_training_texts_score_high(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "re", "so"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(80)) for _ in range(120)]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2][:40]
    kept = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2][:80]
    rows = [*zip(kept, texts[:80], strict=True), *zip(held[:20], texts[:20], strict=True), *zip(held[20:], texts[80:100], strict=True)]
    found = {r["doc_id"]: r for r in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string"), ppm.trained_on(F.col("doc_id")), head_words=64).collect()}
    assert all(found[i]["score"] > found[i]["base_score"] for i in held[:20])
    mean = lambda ids: sum(found[i]["score"] for i in ids) / len(ids)
    assert mean(held[:20]) > mean(held[20:])


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = align._stand_ins()
    out, held = [], Counter()
    for i, text in rows:
        ids, pieces = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        x = [bytes(byte[c] for c in a.id_to_token(t)) for t in ids]
        y = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in pieces]
        if not text or not b"".join(x) == b"".join(y) == (" " + text).encode():
            out.append((i, 0, 0, 0, [], ""))
            continue
        ends = [[sum(map(len, z[: n + 1])) for n in range(len(z))] for z in (x, y)]
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[t for t, e in zip(z, own, strict=True) if start < e <= cut] for z, own in zip((ids, pieces), ends, strict=True)])
            start = cut
        links = [(p, q) for g, h in groups for p in g for q in h]
        held.update(set(links))
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, len(ids), len(pieces), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    return [(i, x, y, z, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), h) for i, x, y, z, links, h in out]


SMALL = [(i, t and t[:400]) for i, t in ODD]  # by hand, a text costs the square of its length


@pytest.mark.parametrize("head", [1 << 20, 1])
def test_alignment_equals_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(align, "ROW_PAIRS", 7)
    texts = spark.createDataFrame([(i, t, 1) for i, t in SMALL], "doc_id long, text string, row long").repartition(2)
    assert ordered(align.summary(texts, A, B, head_pairs=head).collect()) == ordered(aligned_by_hand(SMALL))


def test_long_groups_are_counted_by_distinct_ids(monkeypatch):
    tool = align.aligner(A, B)
    texts = [b" " + t.encode() for _, t in ODD if t]
    whole = tool.align(texts)["pairs"]
    monkeypatch.setattr(align, "MOST_PAIRS", 3)
    assert all((x == y).all() for x, y in zip(whole, tool.align(texts)["pairs"], strict=True))


def test_alignment_shows_groups_and_takes_empty_tables(spark):
    shown = align.aligned(spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string"), A, B, with_groups=True).collect()
    assert [r["groups_sha256"] for r in shown] == [hashlib.sha256(shown[0]["groups"].encode()).hexdigest(), ""]
    assert align.summary(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


@pytest.mark.parametrize("broadcast_words", [collocations.BROADCAST_WORDS, 0])
@pytest.mark.parametrize("least", [2, 5])
def test_collocations_equal_sql(docs, least, broadcast_words):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas())
    want = con.sql(collocations.oracle(least, 20)).fetchall()
    assert len(want) > 10
    assert ordered(collocations.mine(docs, least=least, first=20, broadcast_words=broadcast_words).collect()) == ordered(want)


def test_collocations_in_wide_columns(docs, monkeypatch):
    narrow = ordered(collocations.mine(docs, least=20, first=20).collect())
    monkeypatch.setattr(collocations, "NARROW_WORDS", 0)
    assert ordered(collocations.mine(docs, least=20, first=20).collect()) == narrow


def test_suffix_rows_hold_any_count():
    for layout in (collocations.Layout(21), collocations.Layout(32)):
        grid, n = np.array([[7, 1, layout.mask >> 1], [8, 2, 0]]), np.array([1, 3 * layout.mask + 5, layout.mask])
        back = layout.unpacked(layout.packed(grid, n))
        sums = {}
        for *words, count in back.T.tolist():
            sums[tuple(words[:2])] = sums.get(tuple(words[:2]), 0) + count
        assert sums == {tuple(w): c for w, c in zip(grid.T.tolist(), n.tolist(), strict=True)} and back[2:5].max() == 0


def test_collocations_of_hot_words_and_of_nothing(spark):
    rows = [(i, "the the the of the of of the the of", "en") for i in range(30)] + [(99, None, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    con = duckdb.connect()
    con.register("documents", texts.toPandas())
    assert ordered(collocations.mine(texts, least=10).collect()) == ordered(con.sql(collocations.oracle(10)).fetchall())
    assert collocations.mine(texts.limit(0)).collect() == []


def test_words_are_cut_at_every_border():
    import pyarrow as pa

    words, text, piece = wordcut.cut(wordcut.plain(pa.array(["a b", "", "c", None, " D.e ", "f"])), b" ", b".")
    assert words.to_pylist() == ["a", "b", "c", "d", "e", "f"] and text.tolist() == [0, 0, 2, 4, 4, 5]
    assert len(set(piece.tolist())) == 5 and piece[0] == piece[1]
