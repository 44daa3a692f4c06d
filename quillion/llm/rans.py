"""A static range asymmetric numeral system over interleaved lanes, vectorised by lane.

Symbol i of a block belongs to lane i mod L; each lane is a 64-bit rANS state in [2**31, 2**63) that is renormalised by
32-bit words, and all lanes share one stream of words. Every ``CHECK_STEPS`` steps the lanes' states and the position in
the stream are kept, with a checksum of the symbols up to the next such point, so that the segments of a block can be
decoded and verified apart from each other.

Block layout (little-endian): magic ``QRNS``, bits u32, lanes u32, symbols u64, segments u32, words u64; per segment: word
position u64, checksum u32, lane states u64 each; the words u32 each; crc32 u32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"QRNS"
LOW = np.uint64(1 << 31)
LANES = 1024
CHECK_STEPS = 128
#: Frequencies sum to 2**BITS; more than half as many distinct symbols don't fit.
BITS = 20
_WORD = np.uint64(32)
_LOW_WORD = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Table:
    """Shared frequencies: freq[s] of 2**bits for each symbol, 0 for those that never occur."""

    freq: np.ndarray  # uint64
    cum: np.ndarray  # uint64
    bits: int
    slots: np.ndarray  # uint32, symbol of each slot

    @staticmethod
    def of(freq: np.ndarray, bits: int = BITS) -> Table:
        freq = np.asarray(freq, np.uint64)
        if int(freq.sum()) not in (0, 1 << bits):
            raise ValueError("frequencies don't sum to the scale")
        return Table(freq, np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else freq, bits, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)))


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to sum to 2**bits, at least 1 wherever a count isn't 0; the largest give or take what is off."""
    counts = np.asarray(counts, np.float64)
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << (bits - 1):
        raise ValueError(f"{len(seen)} distinct symbols don't fit into {bits} bits")
    out = np.zeros(len(counts), np.int64)
    if not len(seen):
        return out
    out[seen] = np.maximum(1, np.floor(counts[seen] / counts[seen].sum() * (1 << bits))).astype(np.int64)
    off = (1 << bits) - int(out.sum())
    order = seen[np.argsort(-out[seen], kind="stable")]
    if off > 0:
        out[order[0]] += off
    for s in order if off < 0 else ():
        take = min(-off, int(out[s]) - 1)
        out[s] -= take
        off += take
        if not off:
            break
    return out


def lanes_for(n: int) -> int:
    """Fewer lanes for short blocks, so that their states don't outweigh the words."""
    return max(1, min(LANES, n // 64))


def encode(symbols: np.ndarray, table: Table) -> bytes:
    symbols = np.asarray(symbols, np.int64)
    n, lanes = len(symbols), lanes_for(len(symbols))
    steps = -(-n // lanes)
    f, c, scale, renorm = table.freq, table.cum, np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    kept: list[tuple[int, np.ndarray]] = []  # states with which decoding of a step begins
    for i in range(steps - 1, -1, -1):
        s = symbols[i * lanes : (i + 1) * lanes]
        fs, x = f[s], state[: len(s)]
        over = x >= (fs << renorm)
        words.append((x[over] & _LOW_WORD).astype("<u4"))
        x = np.where(over, x >> _WORD, x)
        q = x // fs
        state[: len(s)] = (q << scale) + (x - q * fs) + c[s]
        if i % CHECK_STEPS == 0:
            kept.append((i, state.copy()))
    words.reverse()
    kept.reverse()
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    head = [MAGIC, struct.pack("<IIQIQ", table.bits, lanes, n, len(kept), int(before[-1]))]
    for k, (i, states) in enumerate(kept):
        end = kept[k + 1][0] * lanes if k + 1 < len(kept) else n
        head += [struct.pack("<QI", int(before[i]), zlib.crc32(symbols[i * lanes : end].astype("<u4").tobytes())), states.astype("<u8").tobytes()]
    body = b"".join([*head, *(w.tobytes() for w in words)])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """An encoded block whose segments are decoded one by one, in any order."""

    def __init__(self, data: bytes, table: Table):
        if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("not a whole block")
        bits, self.lanes, self.n, self.segments, n_words = struct.unpack_from("<IIQIQ", data, 4)
        if bits != table.bits:
            raise ValueError("encoded by another table")
        at, self.table, self.points = 4 + struct.calcsize("<IIQIQ"), table, []
        for _ in range(self.segments):
            position, checksum = struct.unpack_from("<QI", data, at)
            self.points.append((position, checksum, np.frombuffer(data, "<u8", self.lanes, at + 12).astype(np.uint64)))
            at += 12 + 8 * self.lanes
        self.words = np.frombuffer(data, "<u4", n_words, at)

    def segment(self, k: int) -> np.ndarray:
        """Symbols of a segment; raises ValueError if its checksum differs."""
        at, checksum, start = self.points[k]
        t, lanes, state = self.table, self.lanes, start.copy()
        first, last = k * CHECK_STEPS, min((k + 1) * CHECK_STEPS, -(-self.n // lanes))
        out = np.empty(min(last * lanes, self.n) - first * lanes, np.uint32)
        mask, scale = np.uint64((1 << t.bits) - 1), np.uint64(t.bits)
        for i in range(first, last):
            k_ = min(lanes, self.n - i * lanes)
            x = state[:k_]
            slot = x & mask
            s = t.slots[slot]
            out[(i - first) * lanes : (i - first) * lanes + k_] = s
            x = t.freq[s] * (x >> scale) + slot - t.cum[s]
            under = np.flatnonzero(x < LOW)
            x[under] = (x[under] << _WORD) | self.words[at : at + len(under)]
            at += len(under)
            state[:k_] = x
        if zlib.crc32(out.astype("<u4", copy=False).tobytes()) != checksum:
            raise ValueError(f"segment {k} is damaged")
        return out

    def decode(self) -> np.ndarray:
        return np.concatenate([self.segment(k) for k in range(self.segments)]) if self.segments else np.empty(0, np.uint32)
