"""Words and their hashes, vectorised over batches of texts."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"\w+")
#: Words and runs of other marks.
TOKEN = re.compile(r"\w+|[^\w\s]+")
_MASK = 0xFFFFFFFFFFFFFFFF
#: Distinct words whose hashes a worker keeps; beyond that it starts afresh.
CACHE_WORDS = 200_000


class WordHashes(dict):
    """word -> 64-bit hash, computed once a word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_HASHES = WordHashes()


def hashed(words: list[str]) -> np.ndarray:
    """uint64 hashes of the words, in order."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


#: What steps leave in a worker for their next task, by the step's name: how to forget it.
_LEFT: dict[str, Callable[[], None]] = {}


def leave(step: str, forget: Callable[[], None]) -> None:
    """Says that this worker holds something that only the step's own tasks use."""
    _LEFT[step] = forget


def give_back(step: str | None = None) -> None:
    """At a task's end: forget cached words and what steps other than ``step`` have left, and return freed memory to the system, as workers live on through later stages."""
    _HASHES.clear()
    for other in [x for x in _LEFT if x != step]:
        _LEFT.pop(other)()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def batches_of(texts: list, limit: int = 1_000_000, most: int = 8_192):
    """(start, stop) of runs of ``most`` texts at most, with about ``limit`` characters each, so that scratch arrays stay small."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= limit or i + 1 - start >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
