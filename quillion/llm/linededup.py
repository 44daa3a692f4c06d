"""Line dedup by a segment-partition edit join.

Two lines are linked if their edit distance is at most ``limit_of`` the shorter one's length: none under ``MIN_CHARS``
characters, ``EDITS`` up to ``LONG_CHARS``, then more with the square root of the length (4 at 96 characters, 8 at 384,
16 at 1536). Classes are the connected components of links, and the first occurrence of a class (by document id, then
line number) stays.

Candidates are found without a loss. Each distinct line of n characters, fewer than ``LONG_CHARS``, is split into
EDITS + 1 segments; lines within EDITS edits share at least one of them unchanged. So a line enters an index under
(its length, segment number, segment), and probes the indexes of its own and the EDITS next smaller lengths with those
of its substrings that a match could have left in place (multi-match-aware positions).

Longer lines come in length classes of one limit each. A line split into limit + 1 segments has one that a match holds
unchanged, at most limit places further on; so both hold all substrings of a window's length there, and the smallest
hash in the window is that of the same substring (winnowing). A line enters an index under (class, substring, cell of
its position) for the smallest of each window, and probes the next cell, and the next class below, where a match could
be.

An entry is a record of 21 bytes with the substring's place, the line's length and its bag: how many characters of each of
eight kinds the line has, modulo 16. Each task sorts its records by bucket and sends them as one pack for each partition
(in columns, see ``packed``), where numpy sorts them again; of two lines in a bucket those become candidates of which one is
indexed and whose places, lengths and bags could come from edits within the limit. Large buckets do the same as long as
that leaves few pairs a line; the others go on as members (see ``components.linked``), parted by cells of length; a bucket that holds more than ``HOT`` of a pack's records is spread over
all tasks as members at once, so that no task meets all of a substring that very many lines share. Candidates are
verified by a banded bit-parallel edit distance, for many pairs of lines at once.

Lines are stripped of white space at their ends; every line that isn't blank takes part. Equal lines of any length are
one node (by a 64-bit hash), so repeats cost nothing later. Lines under ``MIN_CHARS`` characters are linked to no others,
as two edits make another line of them. Lines' texts are shuffled only if a fixed-size filter of the candidates lets
them pass.

Defined results: null and empty texts have no lines; repeated rows (same id and text) are one document; a null id comes
before all others; very long lines are joined whole; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillion.llm import bitmap, components, store
from quillion.llm.words import batches_of, give_back, mix

EDITS = 2
#: Characters from which the limit grows with the length.
LONG_CHARS = 96
#: First length and limit of each class of longer lines; lengths grow by the root of 2, limits by its root.
CLASSES = [(int(LONG_CHARS * 2 ** (c / 2)), int(2 * EDITS * 2 ** (c / 4))) for c in range(56)]
_LOWS = np.array([low for low, _ in CLASSES])
#: Positions of a cell, in limits.
CELL_LIMITS = 32
#: Characters from which a line has edit links; shorter ones are grouped with equal ones only.
MIN_CHARS = 20
#: Records that a task sorts and sends at once.
FLUSH = 1_000_000
#: Columns of edit distances after which pairs beyond their limit go.
COLUMNS = 32
#: Nodes of a bucket up to which its pairs are candidates at once.
SMALL = 256
#: Nodes up to which a large bucket's pairs are tried, and pairs a node up to which they are candidates.
TRIED, FEW = 4096, 4
#: Records of one bucket in one flush beyond which they are spread over all tasks.
HOT = 256

_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: low and high: the bucket's 40 first bits; kind: flags, and the class of lengths from the third bit on; what doesn't fit
#: into at and size is _LARGE, which rules nothing out.
_RECORD = np.dtype([("low", "<u4"), ("high", "u1"), ("kind", "u1"), ("node", "<i8"), ("at", "<u2"), ("size", "<u2"), ("bag", "<u4")])
_INDEXED, _SPREAD, _CLASS, _LARGE = 1, 2, 4, 0xFFFF

_LINE = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tie", "<i8"), ("line_no", "<i4"), ("node", "<i8")])
_PACKS = T.StructType([T.StructField("to", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("spread", T.BooleanType()), T.StructField("records", T.BinaryType())])
_FOUND = T.StructType([T.StructField("kind", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("bucket", "a", "b", "doc_id", "tie")), T.StructField("line_no", T.IntegerType()), T.StructField("node", T.LongType())])
#: Kinds of rows that tasks find: lines of documents, candidate pairs (a, b), members (bucket, a) of large
#: buckets, and of those that are spread.
LINE, PAIR, MEMBER, SPREAD = range(4)
_TEXTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("payload", T.BinaryType())])


def split_lines(text: str | None) -> list[tuple[int, str]]:
    """(line number, stripped line) of the lines that take part: all but blank ones."""
    if not text:
        return []
    return [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.strip())]


def limit_of(size: int) -> int:
    """Edits up to which a line of this length is linked to another one that is as long or longer; -1 for no links."""
    if size < LONG_CHARS:
        return EDITS if size >= MIN_CHARS else -1
    return CLASSES[bisect_right(CLASSES, size, key=lambda c: c[0]) - 1][1]


_LIMITS = np.array([limit_of(n) for n in range(_LARGE + 1)])
_CLASS_LIMITS = np.array([EDITS, *(limit for _, limit in CLASSES)])


def node_of(line: str) -> int:
    """A line's 64-bit name."""
    n = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >> 63 else n


# --- index entries and probes ----------------------------------------------------------------------------------------


def _codes(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _substrings(codes: np.ndarray, chars: int) -> np.ndarray:
    """A polynomial modulo 2**64 of every run of ``chars`` codes, from runs of 1, 2, 4, ..."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    span, width, whole, done = (codes + np.uint64(1)) * _ODD, 1, None, 0
    while True:
        if chars & width:
            n = len(codes) - done - width + 1
            whole = span[:n].copy() if whole is None else whole[:n] * power(width) + span[done : done + n]
            done += width
        if 2 * width > chars:
            return whole
        span, width = span[:-width] * power(width) + span[width:], 2 * width


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of ``width`` items of x."""
    span = 1
    while span * 2 <= width:
        x, span = op(x[:-span], x[span:]), span * 2
    return op(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


#: Buckets, places in the list of lines, places in the line, kinds.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _winnowed(lines: list[str], sizes: np.ndarray, which: np.ndarray, c: int, own: bool) -> Entries:
    """Entries of the lines ``which`` in class c; they are indexed there if it is their own."""
    low, limit = CLASSES[c]
    whole = low // (limit + 1)  # characters that a match leaves in one piece, at least
    chars = min(16, max(12, whole // 2))
    window = whole - chars + 1
    sizes, codes = sizes[which], _codes([lines[i] for i in which.tolist()])
    poly = _substrings(codes, chars)
    rank = (poly * _ODD >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    starts = _starts(sizes)
    ends = starts + sizes
    # a run over two lines has rank 0, so that no window with one counts
    rank[(ends[:-1, None] - np.arange(1, chars)).ravel()] = 0
    least = _slide(rank, window, np.minimum)
    most = _slide(np.pad(least, window - 1), window, np.maximum)
    chosen = np.flatnonzero((most == rank) & (rank > 0))
    line = np.searchsorted(ends, chosen, "right")
    at = chosen - starts[line]
    cell = CELL_LIMITS * limit
    home = at // cell
    out = []
    for n, place in enumerate((home, (at - limit) // cell, (at + limit) // cell)):
        ok = np.flatnonzero((place >= 0) & ((place != home) | (n == 0)))
        key = mix(poly[chosen[ok]] ^ mix((place[ok] * 64 + c).astype(np.uint64) + np.uint64(1 << 60)))
        out.append((key, which[line[ok]], at[ok], np.full(len(ok), (c + 1) * _CLASS + (_INDEXED if own and n == 0 else 0), np.uint8)))
    return _together(out)


def _segments(lines: list[str], sizes: np.ndarray, which: np.ndarray) -> Entries:
    """Entries of the lines ``which`` for partners under ``LONG_CHARS`` characters."""
    codes, size, parts = _codes([lines[i] for i in which.tolist()]), sizes[which], EDITS + 1
    starts = _starts(size)
    powers = np.full(len(codes) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.astype(np.uint64)) * powers[:-1], dtype=np.uint64)])
    out = []
    for shorter in range(EDITS + 1):
        length = size - shorter
        short, long_ = length // parts, parts - length % parts  # the first ``long_`` segments have ``short`` characters
        for i in range(parts):
            start = i * short + np.maximum(0, i - long_)
            chars = short + (i >= long_)
            for move in range(max(-i, shorter - (EDITS - i)), min(i, shorter + (EDITS - i)) + 1):
                at = start + move
                ok = np.flatnonzero((at >= 0) & (at + chars <= size) & (length >= MIN_CHARS) & (length < LONG_CHARS))
                a, n = starts[ok] + at[ok], chars[ok]
                sums = (prefix[a + n] - prefix[a]) * powers[len(codes) - a]  # as if it stood at the end, whatever its place
                base = np.uint64(pow(_BASE, -len(codes), 1 << 64))  # nor does the number of characters at hand count
                key = mix(mix(sums * base) ^ mix((length[ok] * parts + i).astype(np.uint64)))
                out.append((key, which[ok], at[ok], np.full(len(ok), _INDEXED if shorter == 0 and move == 0 else 0, np.uint8)))
    return _together(out)


def bags(lines: list[str]) -> np.ndarray:
    """Each line's counts of characters of eight kinds, modulo 16, in four bits each: n edits change them by 2 n together at most."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = (_codes(lines) * np.uint32(0x9E3779B1) >> np.uint32(29)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(lines)) * 8, sizes) + kinds, minlength=8 * len(lines)).reshape(len(lines), 8)
    return (counts % 16 << np.arange(0, 32, 4)).sum(axis=1).astype(np.uint32)


def _byte_apart() -> np.ndarray:
    one = np.arange(256)
    by_nibble = [np.minimum((x := (one[:, None] >> shift) - (one >> shift) & 15), 16 - x) for shift in (0, 4)]
    return sum(by_nibble).astype(np.uint8).ravel()


_APART = _byte_apart()


def bags_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By how much the counts of two bags differ together, at least."""
    total = np.zeros(len(a), np.int64)
    for shift in (0, 8, 16, 24):
        total += _APART[(a >> np.uint32(shift) & np.uint32(255)) << np.uint32(8) | b >> np.uint32(shift) & np.uint32(255)]
    return total


_ZSTD = pa.Codec("zstd", compression_level=1)
#: Bytes of a record, gaps between buckets in place of buckets, that are as good as random: they go as they are.
_RANDOM = np.array([0, 1, *range(6, 14)])
_OTHER = np.setdiff1d(np.arange(_RECORD.itemsize), _RANDOM)


def packed(records: bytes) -> bytes:
    """Records of one pack, in order of bucket, byte by byte in columns: a quarter shorter."""
    rows = np.frombuffer(records, _RECORD).copy()
    bucket = rows["low"].astype(np.int64) | rows["high"].astype(np.int64) << 32
    gaps = np.diff(bucket, prepend=0) & ((1 << 40) - 1)
    rows["low"], rows["high"] = gaps & 0xFFFFFFFF, gaps >> 32
    planes = rows.view(np.uint8).reshape(len(rows), -1).T
    short = [_ZSTD.compress(np.ascontiguousarray(planes[i]), asbytes=True) for i in _OTHER]
    head = np.array([len(rows), *map(len, short)], "<i4").tobytes()
    return b"".join([head, np.ascontiguousarray(planes[_RANDOM]).tobytes(), *short])


def unpacked(pack: bytes) -> np.ndarray:
    n, *sizes = np.frombuffer(pack, "<i4", 1 + len(_OTHER)).tolist()
    planes = np.empty((_RECORD.itemsize, n), np.uint8)
    at = 4 * (1 + len(_OTHER))
    planes[_RANDOM] = np.frombuffer(pack, np.uint8, n * len(_RANDOM), at).reshape(len(_RANDOM), n)
    at += n * len(_RANDOM)
    for i, size in zip(_OTHER, sizes, strict=True):
        planes[i] = np.frombuffer(_ZSTD.decompress(pack[at : at + size], n), np.uint8)
        at += size
    rows = np.ascontiguousarray(planes.T).reshape(-1).view(_RECORD)
    bucket = np.cumsum(rows["low"].astype(np.int64) | rows["high"].astype(np.int64) << 32) & ((1 << 40) - 1)
    rows["low"], rows["high"] = bucket & 0xFFFFFFFF, bucket >> 32
    return rows


def _together(parts: list[Entries]) -> Entries:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def entries(lines: list[str]) -> Entries:
    """What every line is indexed under, and what it looks up."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    parts = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8))]
    own = np.searchsorted(_LOWS, sizes, "right") - 1  # -1: lines under LONG_CHARS
    with np.errstate(over="ignore"):
        if len(short := np.flatnonzero((sizes >= MIN_CHARS) & (sizes < LONG_CHARS + EDITS))):
            parts.append(_segments(lines, sizes, short))
        for c in np.unique(own[own >= 0]).tolist():
            parts.append(_winnowed(lines, sizes, np.flatnonzero(own == c), c, True))
            if c:  # a match may be of the class below
                near = np.flatnonzero((own == c) & (sizes - CLASSES[c - 1][1] < CLASSES[c][0]))
                if len(near):
                    parts.append(_winnowed(lines, sizes, near, c - 1, False))
    return _together(parts)


def _firsts(sorted_: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where runs of equal items begin."""
    differ = np.zeros(max(0, len(sorted_) - 1), bool)
    for x in (sorted_, *more):
        differ |= x[1:] != x[:-1]
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_)), bool), differ]))


def _shared(sorted_: np.ndarray) -> np.ndarray:
    """Which items occur more than once."""
    out = np.zeros(len(sorted_), bool)
    same = sorted_[1:] == sorted_[:-1]
    out[1:] = same
    out[:-1] |= same
    return out


def _repeated(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rows, sorted by bucket, repeat a line in a bucket, and which are the ones that they repeat; those get all their kinds."""
    again, kept = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    order = np.lexsort((rows["node"], bucket))
    first = _firsts(bucket[order], rows["node"][order])
    times = np.diff(np.append(first, len(order)))
    again[order] = True
    again[order[first]] = False
    kept[order[first[times > 1]]] = True
    if len(first):
        rows["kind"][order[first]] = np.bitwise_or.reduceat(rows["kind"][order], first)
    return again, kept


class Packs:
    """Collects lines and gives packs (to, part, spread, records) for ``parts`` partitions."""

    def __init__(self, parts: int, turn: int):
        self.parts, self.turn = parts, turn
        self._empty()

    def _empty(self) -> None:
        self.nodes: set[int] = set()
        self.held: list[tuple] = [tuple(np.empty(0, t) for t in (np.uint64, np.int64, np.uint16, np.uint16, np.uint8, np.uint32))]
        self.size = 0

    def add(self, lines: list[str], nodes: np.ndarray) -> None:
        """Lines that have come since the last flush make no entries again."""
        fresh = {n: s for n, s in zip(nodes.tolist(), lines, strict=True) if n not in self.nodes and len(s) >= MIN_CHARS}
        if not fresh:
            return
        self.nodes.update(fresh)
        lines, nodes = list(fresh.values()), np.fromiter(fresh, np.int64, len(fresh))
        sizes = np.minimum(np.fromiter(map(len, lines), np.int64, len(lines)), _LARGE)
        key, which, at, kind = entries(lines)
        self.held.append((key, nodes[which], np.minimum(at, _LARGE).astype(np.uint16), sizes[which].astype(np.uint16), kind, bags(lines)[which]))
        self.size += len(key)

    def flush(self) -> list[pa.RecordBatch]:
        key, *columns = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self._empty()
        order = np.argsort(key)
        key = key[order]
        rows = np.empty(len(key), _RECORD)
        rows["low"], rows["high"] = (key >> np.uint64(24)).astype(np.uint32), (key >> np.uint64(56)).astype(np.uint8)
        for name, x in zip(("node", "at", "size", "kind", "bag"), columns, strict=True):
            rows[name] = x[order]
        part = ((key >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)
        first = _firsts(key)
        run = np.diff(np.append(first, len(key)))
        begin = np.flatnonzero(run > HOT)
        out = []
        if len(begin):
            hot = np.repeat(run > HOT, run)
            to = (self.turn + np.arange(len(begin))) % self.parts
            self.turn += len(begin)
            out.append(self._batch(to, part[first[begin]], True, rows[hot], np.concatenate([[0], np.cumsum(run[begin])])))
            hot[first[begin]] = False  # one stays as a mark, so that the bucket's other records join those that were spread
            rows["kind"][first[begin]] |= _SPREAD
            rows, part = rows[~hot], part[~hot]
        ends = np.searchsorted(part, np.arange(self.parts + 1))
        some = np.flatnonzero(np.diff(ends))
        out.append(self._batch(some, some, False, rows, np.append(ends[some], len(rows))))
        return out

    @staticmethod
    def _batch(to: np.ndarray, part: np.ndarray, spread: bool, rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        offsets = (cuts * _RECORD.itemsize).astype("<i4")
        records = pa.Array.from_buffers(pa.binary(), len(to), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array([spread] * len(to), pa.bool_()), records], names=["to", "part", "spread", "records"])


# --- candidates ------------------------------------------------------------------------------------------------------


def _bucket(records: np.ndarray, part: int) -> np.ndarray:
    return records["low"].astype(np.uint64) | (records["high"].astype(np.uint64) << np.uint64(32)) | np.uint64(part << 40)


def _by_length(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, node), each large bucket by cells of length, such that lines within the limit share one."""
    size, limit = rows["size"].astype(np.int64), _CLASS_LIMITS[rows["kind"] // _CLASS]
    width = 8 * limit
    home, above = size // width, np.minimum(size + limit, _LARGE) // width
    at = np.concatenate([np.arange(len(rows)), np.flatnonzero(home != above)])
    cell = np.concatenate([home, above[home != above]])
    return mix(mix(bucket[at]) + cell.astype(np.uint64)).view(np.int64), rows["node"][at]


def _fitting(bucket: np.ndarray, rows: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of rows (sorted by bucket) of one bucket, one of which is indexed, whose places, lengths and bags fit; None if they are more than ``most``."""
    size, at, indexed = rows["size"].astype(np.int64), rows["at"].astype(np.int64), rows["kind"] & _INDEXED > 0
    left, right, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    first = _firsts(bucket)
    count = np.diff(np.append(first, len(rows)))
    stop = np.repeat(first + count, count)
    i, step = np.arange(len(rows)), 0
    while True:
        step += 1
        i = i[i + step < stop[i]]
        if not len(i):
            break
        j = i + step
        limit = _LIMITS[np.minimum(size[i], size[j])]
        longer, shift = size[j] - size[i], at[j] - at[i]
        unknown = (at[i] == _LARGE) | (at[j] == _LARGE)
        ok = np.where(unknown, np.abs(longer), np.abs(shift) + np.abs(longer - shift)) <= limit
        ok |= (size[i] == _LARGE) | (size[j] == _LARGE)
        ok = np.flatnonzero(ok & (indexed[i] | indexed[j]))
        ok = ok[bags_apart(rows["bag"][i[ok]], rows["bag"][j[ok]]) <= 2 * limit[ok]]
        left.append(i[ok])
        right.append(j[ok])
        found += len(ok)
        if most is not None and found > most:
            return None
    return np.concatenate(left), np.concatenate(right)


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = left, right
    a, b = np.minimum(a, b), np.maximum(a, b)
    _, one = np.unique(mix(a.view(np.uint64)) * np.uint64(3) + mix(b.view(np.uint64)), return_index=True)
    return a[one], b[one]


def _few(bucket: np.ndarray, rows: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which large rows (distinct nodes) are of buckets whose pairs that fit are few a node, and these pairs."""
    done, pairs = np.zeros(len(rows), bool), [(np.empty(0, np.int64),) * 2]
    at = np.flatnonzero(large)
    cuts = np.append(_firsts(bucket[at]), len(at)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a <= TRIED and (met := _fitting(bucket[at[a:b]], rows[at[a:b]], FEW * (b - a))) is not None:
            done[at[a:b]] = True
            pairs.append(tuple(rows["node"][at[a:b][x]] for x in met))
    return done, *(np.concatenate(x) for x in zip(*pairs, strict=True))


def _named(cell: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, node) where buckets of nearly the same nodes are one, as those of a long substring's parts are: they are named by two least hashes of their nodes, so that what two buckets have in common is how likely they become one. No pair of a bucket is parted."""
    order = np.lexsort((node, cell))
    cell, node = cell[order], node[order]
    first = _firsts(cell)
    count = np.diff(np.append(first, len(cell)))
    if not len(first):
        return cell, node
    hashed = mix(node.view(np.uint64))
    name = np.repeat(mix(np.minimum.reduceat(hashed, first)) ^ np.minimum.reduceat(mix(hashed ^ _ODD), first), count).view(np.int64)[np.repeat(count > 1, count)]
    node = node[np.repeat(count > 1, count)]
    order = np.lexsort((node, name))
    order = order[_firsts(name[order], node[order])]
    return name[order], node[order]


def candidates(packs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of candidate pairs, and (bucket, node) of the members of large buckets, from (part, records)."""
    a, b, own, spread = candidates_and_spread(packs)
    return a, b, *(np.append(x, y) for x, y in zip(own, spread, strict=True))


def candidates_and_spread(packs: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(a, b) of candidate pairs, (bucket, node) of the members of large buckets, and of spread ones, whose other members are elsewhere."""
    bucket = np.concatenate([np.empty(0, np.uint64), *(_bucket(r, p) for p, r in packs)])
    order = np.argsort(bucket)
    bucket = bucket[order]
    shared = _shared(bucket)
    bucket = bucket[shared]
    rows = np.concatenate([np.empty(0, _RECORD), *(r for _, r in packs)])[order[shared]]
    if not len(rows):
        none = np.empty(0, np.int64)
        return none, none, (none, none), (none, none)
    (again, several), first = _repeated(bucket, rows), _firsts(bucket)
    count, kind = np.diff(np.append(first, len(rows))), np.bitwise_or.reduceat(rows["kind"], first)
    lines = np.add.reduceat(~again, first, dtype=np.int64)
    spread = np.repeat(kind & _SPREAD > 0, count)
    large = np.repeat((lines > SMALL) & (kind & _INDEXED > 0), count) & ~spread
    small = ~large & ~spread & ~again
    rows["at"][several] = _LARGE  # a line that holds a substring more than once is at no certain place
    large &= ~again
    few, left, right = _few(bucket, rows, large)
    large &= ~few
    i, j = _fitting(bucket[small], rows[small])
    some = rows["node"][small]
    pairs = _distinct(np.append(some[i], left), np.append(some[j], right))
    return *pairs, _named(*_by_length(bucket[large], rows[large])), _by_length(bucket[spread], rows[spread])


# --- edit distance ---------------------------------------------------------------------------------------------------


def distance(a: str, b: str, limit: int = EDITS) -> int:
    """Edit distance of a and b, or limit + 1 if it is larger: banded and bit-parallel.

    Bit limit + d of the words stands for the cell of the column whose row is d further on; all words move down a row
    with each column. The distance is followed along the diagonal that ends in the last cell.
    """
    ahead = len(a) - len(b)
    if abs(ahead) > limit:
        return limit + 1
    band = (1 << (2 * limit + 2)) - 1
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << (i + limit + 1)
    vp, vn, at, score = band ^ ((1 << (limit + 1)) - 1), 0, limit + 1 + ahead, max(ahead, 0)
    for j, x in enumerate(b):
        match = (masks.get(x, 0) >> j) & band
        zero = ((((match & vp) + vp) ^ vp) | match | vn) & band
        hp, hn = vn | (~(zero | vp) & band), zero & vp
        score += 1 - (zero >> at & 1)
        vp, vn = hn | (~(zero >> 1 | hp) & band), zero >> 1 & hp
    return min(score, limit + 1)


def _bulk(a: list[np.ndarray], b: list[np.ndarray], limit: int) -> np.ndarray:
    """The same for many pairs of lines as code points, with one 64-bit word each; limit is 31 at most.

    A distance never falls along its diagonal, so pairs that are beyond the limit go every ``COLUMNS`` columns.
    """
    n = max(max(map(len, a)), max(map(len, b)))
    ahead = np.array([len(x) - len(y) for x, y in zip(a, b, strict=True)], np.int64)
    # both go on with the same character, which leaves the distance as it is
    left, right = np.full((len(a), n + 2 * limit), 1 << 30, np.uint32), np.full((len(a), n), 1 << 30, np.uint32)
    left[:, :limit] = 1 << 31
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        left[i, limit : limit + len(x)] = x
        right[i, : len(y)] = y
    out, which = np.full(len(a), limit + 1, np.int64), np.arange(len(a))
    vp = np.full(len(a), ((1 << 64) - 1) ^ ((1 << (63 - limit)) - 1), np.uint64)
    vn = np.zeros(len(a), np.uint64)
    at, score, one = (63 - limit + ahead).astype(np.uint64), np.maximum(ahead, 0), np.uint64(1)
    for start in range(0, n, COLUMNS):
        stop = min(n, start + COLUMNS)
        text, pattern = np.ascontiguousarray(right[which, start:stop].T), np.ascontiguousarray(left[which, start : stop + 2 * limit].T)
        match = np.zeros(text.shape, np.uint64)
        for d in range(2 * limit + 1):
            match |= (pattern[d : d + stop - start] == text).astype(np.uint64) << np.uint64(63 - 2 * limit + d)
        same = np.zeros(len(which), np.uint64)
        for x in match:
            zero = (((x & vp) + vp) ^ vp) | x | vn
            hp, hn = vn | ~(zero | vp), zero & vp
            same += (zero >> at) & one
            zero >>= one
            vp, vn = hn | ~(zero | hp), zero & hp
        score = score + (stop - start) - same.astype(np.int64)
        on = score <= limit
        which, vp, vn, at, score = which[on], vp[on], vn[on], at[on], score[on]
        if not len(which):
            break
    out[which] = score
    return out


def _middle(a: str, b: str) -> tuple[str, str]:
    """a and b without what they begin and end with in common, which is no part of a distance."""
    x, y = _codes([a]), _codes([b])
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(x[len(x) - n + start :][::-1] != y[len(y) - n + start :][::-1])
    end = int(differ[0]) if len(differ) else n - start
    return a[start : len(a) - end], b[start : len(b) - end]


def distances(a: list[str], b: list[str], limits: np.ndarray) -> np.ndarray:
    """Edit distance of each pair, or its limit + 1 if that is smaller."""
    out = limits + 1
    sizes, other = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    most = np.maximum(sizes, other)
    open_ = np.flatnonzero(np.abs(sizes - other) <= limits)
    for limit in np.unique(limits[open_]).tolist():
        which = open_[limits[open_] == limit]
        which = which[np.argsort(most[which], kind="stable")].tolist()
        if limit > 31:
            for i in which:
                out[i] = distance(*_middle(a[i], b[i]), limit)
            continue
        while which:
            n = max(1, 1_000_000 // int(most[which[-1]]))
            part, which = which[-n:], which[:-n]
            out[part] = _bulk([_codes([a[i]]) for i in part], [_codes([b[i]]) for i in part], limit)
    return out


def _text(x: bytes) -> str:
    return x.decode("utf-8", "surrogatepass")


def near_pairs(a: list[bytes], b: list[bytes]) -> list[bool]:
    left, right = list(map(_text, a)), list(map(_text, b))
    limits = np.array([limit_of(min(len(x), len(y))) for x, y in zip(left, right, strict=True)], np.int64)
    apart = [np.empty(0, np.int64)]
    for start, stop in batches_of(left):
        apart.append(np.abs(_counts(left[start:stop]) - _counts(right[start:stop])).sum(axis=1))
    near = np.zeros(len(left), bool)
    open_ = np.flatnonzero(np.concatenate(apart) <= 2 * limits)  # n edits change 2 n counts at most
    near[open_] = distances([left[i] for i in open_], [right[i] for i in open_], limits[open_]) <= limits[open_]
    return near.tolist()


def _counts(lines: list[str]) -> np.ndarray:
    """How often each line has characters of each of 64 kinds."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    owner = np.repeat(np.arange(len(lines), dtype=np.int64) * 64, sizes)
    return np.bincount(owner + (_codes(lines) & np.uint32(63)), minlength=64 * len(lines)).reshape(len(lines), 64)


def near_cells(a: list[bytes], b: list[bytes], asked: np.ndarray | None = None) -> np.ndarray:
    """The same for all of a against all of b (or those asked for); only those are compared whose counts of characters n edits could make equal."""
    left, right = list(map(_text, a)), list(map(_text, b))
    out = np.zeros((len(left), len(right)), bool)
    sizes, counts = np.array([len(y) for y in right]), _counts(right)
    limits = np.array([limit_of(n) for n in sizes])
    rows, columns, most = [], [], []
    for i, (x, own) in enumerate(zip(left, _counts(left), strict=True)):
        limit = np.minimum(limits, limit_of(len(x)))  # that of the shorter, as limits grow with the length
        fits = np.abs(sizes - len(x)) <= limit
        fits = np.flatnonzero(fits if asked is None else fits & asked[i])
        fits = fits[np.abs(counts[fits] - own).sum(axis=1) <= 2 * limit[fits]]
        rows.append(np.full(len(fits), i))
        columns.append(fits)
        most.append(limit[fits])
    row, column, limit = (np.concatenate(x) for x in (rows, columns, most))
    out[row, column] = distances([left[i] for i in row.tolist()], [right[j] for j in column.tolist()], limit) <= limit
    return out


# --- on tables -------------------------------------------------------------------------------------------------------


def _lines(docs: pa.Array, ties: pa.Array, texts: list) -> tuple[np.ndarray, list[str]]:
    """Records (of type ``_LINE``) of the lines that take part, and the lines."""
    cut = [split_lines(t) for t in texts]
    lines = [s for each in cut for _, s in each]
    out, counts = np.empty(len(lines), _LINE), [len(each) for each in cut]
    null = docs.is_null().to_numpy(zero_copy_only=False)
    out["doc_id"], out["null"] = np.repeat(docs.fill_null(0).to_numpy(), counts), np.repeat(null, counts)
    out["tie"] = np.repeat(ties.to_numpy(), counts)
    out["line_no"] = np.fromiter((i for each in cut for i, _ in each), np.int32, len(lines))
    out["node"] = np.fromiter(map(node_of, lines), np.int64, len(lines))
    return out, lines


def _linkable(texts: list) -> list[str]:
    return [s for t in texts for _, s in split_lines(t) if len(s) >= MIN_CHARS]


def found_in(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the kinds ``LINE``, ``PAIR``, ``MEMBER`` and ``SPREAD``; docs are read once."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        first = TaskContext.get().partitionId()
        packs, held, turn = Packs(parts, first), [], first

        def flushed():
            for batch in packs.flush():
                short = pa.array([packed(x.as_buffer()) for x in batch.column(3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], short], names=batch.schema.names)

        def lines_so_far():
            to = pa.array([turn % parts], pa.int32())
            return pa.RecordBatch.from_arrays([to, pa.array([-1], pa.int32()), pa.array([False]), pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["to", "part", "spread", "records"])

        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in batches_of(texts):
                records, lines = _lines(batch.column(0)[a:b], batch.column(1)[a:b], texts[a:b])
                packs.add(lines, records["node"])
                held.append(records)
                if sum(map(len, held)) >= FLUSH // 8:
                    yield lines_so_far()
                    held, turn = [], turn + 1
                if packs.size >= FLUSH:
                    yield from flushed()
        if held:
            yield lines_so_far()
        yield from flushed()
        give_back()

    def rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["kind"] = pa.array(np.full(n, kind, np.int32))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def meet(batches):
        packs = []
        for batch in batches:
            for part, spread, records in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if part < 0:
                    x = np.frombuffer(records.as_buffer(), _LINE)
                    yield rows(LINE, doc_id=pa.array(x["doc_id"], mask=x["null"] > 0), tie=pa.array(x["tie"]), line_no=pa.array(x["line_no"]), node=pa.array(x["node"]))
                    continue
                x = unpacked(records.as_py())
                if spread:
                    bucket, node = _by_length(_bucket(x, part), x)
                    yield rows(SPREAD, bucket=pa.array(bucket), a=pa.array(node))
                else:
                    packs.append((part, x))
        a, b, own, spread = candidates_and_spread(packs)
        packs.clear()
        yield rows(PAIR, a=pa.array(a), b=pa.array(b))
        for kind, (bucket, node) in ((MEMBER, own), (SPREAD, spread)):
            yield rows(kind, bucket=pa.array(bucket), a=pa.array(node))
        give_back()

    arrow = pa.schema([(f.name, pa.int32() if f.dataType == T.IntegerType() else pa.int64()) for f in _FOUND])
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    return read.mapInArrow(pack, _PACKS).repartitionById(parts, F.col("to")).mapInArrow(meet, _FOUND)


def _merged(members: DataFrame) -> DataFrame:
    """(bucket, node) of spread buckets, named as by ``_named``."""
    names = members.groupBy("bucket").agg(F.xxhash64(F.min(F.xxhash64("node")), F.min(F.xxhash64("node", F.lit(1)))).alias("name"), F.count("*").alias("n")).where("n > 1")
    return members.join(names, "bucket").select(F.col("name").alias("bucket"), "node").distinct()


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, payload) of the wanted nodes: the line's UTF-8 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.of(wanted, "node"))

    def run(batches):
        flags = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in batches_of(texts):
                lines = list(set(_linkable(texts[a:b])))
                nodes = np.fromiter(map(node_of, lines), np.int64, len(lines))
                some = np.flatnonzero(bitmap.may_hold(flags, nodes))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array([lines[i].encode("utf-8", "surrogatepass") for i in some.tolist()], pa.binary())], names=["node", "payload"])
        give_back()

    return docs.mapInArrow(run, _TEXTS).join(wanted, "node", "left_semi").dropDuplicates(["node"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, line_no, class_doc, class_line) of every line that takes part; the class is named by its first occurrence."""
    texts = docs.select(F.col(text_col).alias("text"))
    with store.scratch(docs.sparkSession) as kept:
        made = store.materialise(found_in(docs, id_col, text_col), "found")
        pairs = store.materialise(made.where(F.col("kind") == PAIR).select("a", "b").distinct(), "line-pairs")
        spread = _merged(made.where(F.col("kind") == SPREAD).select("bucket", F.col("a").alias("node")).distinct())
        members = made.where(F.col("kind") == MEMBER).select("bucket", F.col("a").alias("node")).distinct()
        members = store.materialise(members.unionByName(spread), "line-members")
        wanted = store.materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct(), "wanted")
        table = store.materialise(_texts_of(texts, wanted), "line-texts")
        comps = components.linked(members, table, near_pairs, near_cells, pairs)
        each = made.where(F.col("kind") == LINE).select("doc_id", "tie", "line_no", "node")
        each = kept(each.join(comps, "node", "left").select("doc_id", "tie", "line_no", F.coalesce("component", "node").alias("c"), "node").distinct().drop("node"), "placed")
    first = each.groupBy("c").agg(F.min(F.struct("doc_id", "line_no", "tie")).alias("f"))
    return each.join(first, "c").select("doc_id", "tie", "line_no", F.col("f")["doc_id"].alias("class_doc"), F.col("f")["line_no"].alias("class_line"), F.col("f")["tie"].alias("class_tie"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs without the lines whose class occurs earlier; documents of which only blank lines would be left go.

    ``length_col``, where docs has it, is set to the new length of texts that lose lines.
    """
    repeats = classes(docs, id_col, text_col).where(~(F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line")) & (F.col("tie") == F.col("class_tie"))))
    cuts = repeats.groupBy("doc_id", "tie").agg(F.collect_list("line_no").alias("_cut")).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "_cut")
    cuts = store.materialise(cuts, "cuts")
    here = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))  # no clash with our names
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    both = here.join(cuts, F.col(name[id_col]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(name[text_col]) == F.col("_tie")), "left")
    left = F.array_join(F.filter(F.split(F.col(name[text_col]), "\n"), lambda _, i: ~F.array_contains(F.col("_cut"), i)), "\n")
    both = both.withColumn("_new", F.when(F.col("_cut").isNull(), F.col(name[text_col])).otherwise(left))
    both = both.where(F.col("_cut").isNull() | (F.trim(F.regexp_replace("_new", r"\s+", " ")) != ""))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_new").alias(c))
        elif c == length_col:
            out.append(F.when(F.col("_cut").isNull(), F.col(name[c])).otherwise(F.length("_new").cast(docs.schema[c].dataType)).alias(c))
        else:
            out.append(F.col(name[c]).alias(c))
    return both.select(*out)
