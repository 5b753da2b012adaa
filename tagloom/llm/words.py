"""Words and rolling hashes of many texts at once, on one byte buffer.

A word is a maximal run of bytes outside space and 0x09-0x0D.  These are the
separators of ``bytes.split()``, and none occurs inside a multi-byte UTF-8
character, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, last row + 1, their texts) of about SLICE_BYTES each, one text at least.

    Only one slice is held as Python objects at a time, and memory goes back to
    the system when a column is done, since workers outlive their tasks.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + SLICE_BYTES, "right")), at + 1)
        yield at, to, texts_of(column.slice(at, to - at))
        at = to
    tidy()


def tidy() -> None:
    """Return free memory to the system: cycles left by unpickled functions, Arrow's pool, the allocator's free pages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """A value that is made once in each worker process and shared by its tasks."""
    shelf = sys.modules.setdefault("_tagloom_shelf", types.ModuleType("_tagloom_shelf"))
    if not hasattr(shelf, name):
        setattr(shelf, name, make())
    return getattr(shelf, name)


class Words:
    """The words of some texts: ``doc`` is each word's text, ``first[d]`` the first word of text d."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self._cut(data, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))))

    @classmethod
    def mapped(cls, data: np.ndarray, ends: np.ndarray) -> Words:
        """Words of texts that stand one after the other in ``data``, each ended by a separator before ``ends[d]``."""
        own = cls.__new__(cls)
        own._cut(data, ends)
        return own

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.ends = data, ends
        gap = _SEPARATOR[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate((np.zeros(1, edge.dtype), edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.concatenate((np.zeros(1, np.int64), np.searchsorted(self.start, ends)))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(ends)), self.count)
        self._total: np.ndarray | None = None

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: its bytes' numbers weighed by powers of an odd base."""
        return self.range_hashes(self.start, self.end)

    def range_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same of any ranges of bytes; equal bytes have equal hashes wherever they stand."""
        if self._total is None:
            power = np.full(len(self.data), _BASE, U)
            power[0] = 1
            with np.errstate(over="ignore"):
                power = np.multiply.accumulate(power)
                self._total = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[self.data] * power)))
        with np.errstate(over="ignore"):
            return mix((self._total[end] - self._total[start]) * _inverse_powers(start))

    def beginnings(self, points: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the first so many code points of each longer word."""
        heads = np.flatnonzero((self.data & 0xC0) != 0x80)
        to = heads[np.minimum(np.searchsorted(heads, self.start) + points, len(heads) - 1)]
        longer = to < self.end
        return self.doc[longer], self.range_hashes(self.start[longer], to[longer])


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    held = per_process("inverse_powers", lambda: [np.ones(1, U)])
    need = int(at.max()) + 1 if len(at) else 1
    if len(held[0]) < need:
        grown = np.full(max(need, min(2 * len(held[0]), 2 * SLICE_BYTES)), _BASE_INV, U)
        grown[0] = 1
        with np.errstate(over="ignore"):
            held[0] = np.multiply.accumulate(grown)
    return held[0][at]


def grams(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of the n words from each position on (across texts too; callers mask those)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out, b = words[:m].copy(), U(base)
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out *= b
            out += words[k : k + m]
        return mix(out)
