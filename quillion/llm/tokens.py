"""Token ids by the tokenizers library, with a table of words.

A byte-level BPE tokenizer first cuts a text by a fixed pattern, in which a single space always begins a new piece. So a
text whose words are parted by single spaces and line breaks is encoded word by word, each with the space or line break
before it. Words that the library has encoded once are kept in a table of fixed size, which numpy looks up for all words
of many texts at once; words of up to 24 bytes are compared byte by byte, longer ones always go to the library. Any other
text (runs of white space, unusual characters, special tokens' strings), and any text for another kind of tokenizer, is
encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillion.llm.words import leave

#: Words that a worker keeps, and those that stay (the first to come, which hold the frequent ones) when there are more.
KEEP, STAY = 900_000, 600_000
#: Slots of the table of words are 2**SLOTS.
SLOTS = 21
#: Bytes of text that are looked up at once.
CHUNK = 2_000_000
_LANES, _MASKS = 3, np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)
#: Bytes of texts that can be encoded word by word: printable ASCII, line breaks, and the letters from À to ÿ in UTF-8.
_USUAL = np.zeros(256, bool)
_USUAL[[10, 0xC3, *range(0x20, 0x7F), *range(0x80, 0xC0)]] = True
#: Bytes of those that are letters or parts of them.
_LETTERS = np.zeros(256, np.int64)
_LETTERS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1


class Words:
    """word (three lanes of eight bytes) -> ids, in open addressing."""

    def __init__(self):
        self.lanes = np.zeros((_LANES, 1024), np.uint64)
        self.slots = np.full(1 << SLOTS, -1, np.int32)
        self.begin = np.zeros(1025, np.int64)  # where each word's ids begin in the pool
        self.pool = np.zeros(4096, np.uint32)
        self.n = 0

    @staticmethod
    def _slot(lanes: np.ndarray) -> np.ndarray:
        h = lanes[0] * _ODD[0] + lanes[1] * _ODD[1] + lanes[2] * _ODD[2]
        return (((h ^ (h >> np.uint64(32))) * _ODD[3]) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, lanes: np.ndarray) -> np.ndarray:
        """Numbers of the words; -1 where one isn't there."""
        out, slot = np.full(lanes.shape[1], -1, np.int64), self._slot(lanes)
        open_ = np.arange(lanes.shape[1])
        while len(open_):
            at = self.slots[slot]
            taken = at >= 0
            open_, slot, at = open_[taken], slot[taken], at[taken]
            same = self.lanes[0][at] == lanes[0][open_]
            for k in range(1, _LANES):
                same &= self.lanes[k][at] == lanes[k][open_]
            out[open_[same]] = at[same]
            open_, slot = open_[~same], (slot[~same] + 1) & ((1 << SLOTS) - 1)
        return out

    def add(self, lanes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that aren't there yet, with the number of ids of each and all ids."""
        new = self.n + np.arange(lanes.shape[1])
        self.lanes = _grown(self.lanes, self.n + len(new))
        self.lanes[:, new] = lanes
        self.begin = _grown(self.begin, self.n + len(new) + 1)
        self.begin[new + 1] = self.begin[self.n] + np.cumsum(sizes)
        self.room(len(ids))
        self.pool[self.begin[self.n] : self.begin[self.n] + len(ids)] = ids
        self.n += len(new)
        self._place(new)

    def forget(self) -> None:
        """Make room if there are too many words."""
        if self.n > KEEP:
            self.n, self.slots[:] = STAY, -1
            self._place(np.arange(STAY))

    def _place(self, which: np.ndarray) -> None:
        slot = self._slot(self.lanes[:, which])
        while len(which):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = which[free]  # of several for one slot, one stays
            left = self.slots[slot] != which
            which, slot = which[left], (slot[left] + 1) & ((1 << SLOTS) - 1)

    def room(self, n: int) -> int:
        """Make room for n more ids in the pool; where they would begin."""
        used = int(self.begin[self.n])
        self.pool = _grown(self.pool, used + n)
        return used


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    if n <= x.shape[-1]:
        return x
    return np.concatenate([x, np.zeros((*x.shape[:-1], max(n - x.shape[-1], x.shape[-1] // 2)), x.dtype)], axis=-1)


def _distinct(lanes: np.ndarray) -> np.ndarray:
    """One place of each word."""
    order = np.lexsort(lanes)
    ordered = lanes[:, order]
    return order[np.concatenate([np.ones(min(1, len(order)), bool), (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)])]


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), then those of begin[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + size, size)


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.special = [x["content"].encode() for x in kind.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer") and kind["model"]["type"] == "BPE"
        self.words = Words()
        if self.by_word:
            newline = self._ids("\n")
            self.by_word = len(newline) == 1
        if self.by_word:
            spaced = np.zeros(self.vocabulary, bool)  # ids of tokens that begin with a space
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                spaced[i] = token.startswith("Ġ")
            breaks = np.zeros(self.vocabulary, bool)
            breaks[newline] = True
            self.begins = {10: breaks, 32: spaced}
            # a mark that ends a word of letters is a piece of its own
            self.marks = np.zeros(256, np.uint32)
            for mark in ".,;:!?":
                self.marks[ord(mark)] = self._ids(mark)[0]
            alone = [newline, self._ids(" ")]  # a line break or a space that no word follows
            self.words.add(np.array([[10, 32], [0, 0], [0, 0]], np.uint64), np.array([len(x) for x in alone]), np.concatenate(alone))

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Put the words at these places of data, none of which is in the table, into it."""
        letters = np.cumsum(np.concatenate([[0], _LETTERS[data]]))
        marked = (self.marks[data[at + size - 1]] > 0) & (size > 2) & (letters[at + size - 1] - letters[at + 1] == size - 2)
        core = size - marked
        lanes = self._lanes(data, at, core)
        new = _distinct(lanes)
        new = new[self.words.find(lanes[:, new]) < 0]
        for lead, begins in self.begins.items():
            every = new[data[at[new]] == lead]
            for part in np.split(every, range(5000, len(every), 5000)):
                ids = self._ids(data[_runs(at[part], core[part])].tobytes().decode())
                first = np.flatnonzero(begins[ids])
                if len(first) == len(part):
                    sizes = np.diff(np.append(first, len(ids)))
                else:  # no known tokenizer comes here
                    each = [self._ids(data[a : a + n].tobytes().decode()) for a, n in zip(at[part].tolist(), core[part].tolist(), strict=True)]
                    ids, sizes = np.concatenate([np.empty(0, np.uint32), *each]), np.array([len(x) for x in each], np.int64)
                self.words.add(lanes[:, part], sizes, ids)
        which = np.flatnonzero(marked)
        lanes = self._lanes(data, at[which], size[which])
        one = _distinct(lanes)
        number = self.words.find(self._lanes(data, at[which[one]], core[which[one]]))
        begin = self.words.begin[number]
        sizes = self.words.begin[number + 1] - begin + 1
        ids = self.words.pool[np.minimum(_runs(begin, sizes), len(self.words.pool) - 1)]
        ids[np.cumsum(sizes) - 1] = self.marks[data[at[which[one]] + core[which[one]]]]
        self.words.add(lanes[:, one], sizes, ids)

    def _lanes(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        return np.stack([eight[at + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)] if k else eight[at] & _MASKS[np.minimum(size, 8)] for k in range(_LANES)])

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many of them each has."""
        self.words.forget()
        # a line break before each text, whose id goes again; the last one ends the last word
        joined = b"\n" + b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined + bytes(8 * _LANES + 8), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(sizes) - sizes
        end = int(sizes.sum())
        at = np.flatnonzero((data[:end] == 32) | (data[:end] == 10))
        first = np.searchsorted(at, starts)
        leads = np.zeros(len(at) + 1, bool)
        leads[first], leads[-1] = True, True
        owner = np.cumsum(leads[:-1]) - 1
        size = np.diff(np.append(at, end))
        whole = np.zeros(len(texts), bool)
        if not self.by_word:
            whole[:] = True
        else:
            # white space next to white space, but for a text's first space or last character
            runs = (size == 1) & ~leads[1:]
            runs[:-1] &= ~(leads[:-2] & (data[at[1:]] == 32))
            whole[owner[runs]] = True
            odd = ~_USUAL[data[:end]]
            odd[1:] |= (data[: end - 1] == 0xC3) & ((data[1:end] == 0x97) | (data[1:end] == 0xB7))  # no letters
            whole[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = True
            for s in self.special:
                place = joined.find(s)
                while place >= 0:
                    whole[np.searchsorted(starts, place, "right") - 1] = True
                    place = joined.find(s, place + 1)
        # a text that is encoded whole counts as one word
        keep = ~whole[owner] | leads[:-1]
        at, size, owner, leads = at[keep], size[keep], owner[keep], leads[:-1][keep]
        apart = whole[owner]
        table = ~apart & (size <= 8 * _LANES)
        number = np.full(len(at), -1, np.int64)
        lanes = self._lanes(data, at[table], size[table])
        number[table] = self.words.find(lanes)
        missing = np.flatnonzero(table)[number[table] < 0]
        if len(missing):
            new = missing[_distinct(lanes[:, number[table] < 0])]
            self._learn(data, at[new], size[new])
            number[missing] = self.words.find(lanes[:, number[table] < 0])
        begin = np.zeros(len(at), np.int64)
        count = np.zeros(len(at), np.int64)
        begin[table] = self.words.begin[number[table]]
        count[table] = self.words.begin[number[table] + 1] - begin[table]
        rest = np.flatnonzero(~table)
        if len(rest):
            made = [self._ids(texts[owner[i]].decode()) if apart[i] else self._ids(data[at[i] : at[i] + size[i]].tobytes().decode()) for i in rest.tolist()]
            count[rest] = [len(x) for x in made]
            flat = np.concatenate(made)
            room = self.words.room(len(flat))
            self.words.pool[room : room + len(flat)] = flat  # until the next word comes
            begin[rest] = room + np.cumsum(count[rest]) - count[rest]
        off = leads & ~apart
        begin[off] += 1
        count[off] -= 1
        total = np.bincount(owner, count, len(texts)).astype(np.int64)
        return self.words.pool[_runs(begin, count)], total

    def chunks(self, column: pa.Array, end_id: int | None = None):
        """(start, stop, ids, counts) of runs of the column's texts: all their ids, each text's with end_id behind them, and how many each has; null is as empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(column):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            ids, counts = self._chunk([x or b"" for x in column[start:stop].cast(pa.binary()).to_pylist()])
            if end_id is not None:
                counts = counts + 1
                last = np.cumsum(counts) - 1
                full = np.full(len(ids) + len(counts), end_id, np.uint32)
                inside = np.ones(len(full), bool)
                inside[last] = False
                full[inside] = ids
                ids = full
            yield start, stop, ids, counts
            start = stop

    def encode(self, texts: list) -> list[bytes]:
        """Ids of each text as bytes of little-endian unsigned 32-bit integers; null is as empty."""
        out: list[bytes] = []
        for _, _, ids, counts in self.chunks(pa.array(texts, pa.string())):
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
            out += [data[4 * (e - n) : 4 * e] for e, n in zip(ends, counts.tolist(), strict=True)]
        return out


#: By this name tasks that encode keep the encoders for the next one.
STEP = "tokens"
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the file, until a task of another step gives it back."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
        leave(STEP, _ENCODERS.clear)
    return _ENCODERS[path]
