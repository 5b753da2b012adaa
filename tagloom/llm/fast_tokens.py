"""Token ids of many texts at once, equal to the tokenizer library's for the word-BPE file.

That tokenizer composes (NFC), folds white space, lower-cases, splits into
runs of letters, single digits and runs of other signs, and encodes each piece
by itself.  So ids of a text are the ids of its pieces in order, and a piece
needs encoding once.  For texts of code points below U+0300, where composing
is the identity and lower-casing is a table, pieces are found on arrays; other
texts, and those that hold an added token such as an end-of-text mark, go
through the library whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

from tagloom.llm.words import mix, per_process

_LIMIT = 0x300
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
#: Pieces kept per worker process; the store starts anew beyond it, so memory is bounded and results never change.
CACHE_PIECES = 400_000


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_LIMIT + 1, _SIGN, np.uint8)
    lower = np.arange(_LIMIT + 1, dtype=np.uint32)
    for c in range(_LIMIT):
        group = unicodedata.category(chr(c))[0]
        kind[c] = {"L": _LETTER, "N": _DIGIT, "C": _OTHER}.get(group, _SIGN)
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
        else:
            kind[c] = _OTHER
    kind[[*range(0x09, 0x0E), 0x20]] = _SPACE
    kind[[0x85, 0xA0, _LIMIT]] = _OTHER
    return kind, lower


class _Store:
    """Ids of pieces by the pieces' 64-bit hashes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts that may hold one of these, in any case, go through the library.
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, k in vocabulary.items():
            self.last[k] = piece.endswith("</w>")
        self.kind, self.lower = _tables()
        rng = np.random.Generator(np.random.PCG64(7))
        self.number = rng.integers(1, 2**63, _LIMIT + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base, self.inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
        self.powers = np.ones((2, 1), np.uint64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)  # of each key, in flat
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def power(self, n: int) -> np.ndarray:
        if self.powers.shape[1] < n:
            grown = np.empty((2, max(n, 2 * self.powers.shape[1])), np.uint64)
            grown[0], grown[1] = self.base, self.inverse
            grown[:, 0] = 1
            with np.errstate(over="ignore"):
                self.powers = np.multiply.accumulate(grown, axis=1)
        return self.powers

    def encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has."""
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch([" ".join(pieces[k : k + 512]) for k in range(0, len(pieces), 512)], add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):  # a piece that the library splits further: encode one by one
            each = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
            return np.concatenate(each), np.asarray([len(e) for e in each], np.int64)
        return ids, np.diff(np.concatenate(([0], ends)))

    def add(self, keys: np.ndarray, pieces: list[str]) -> None:
        ids, size = self.encode_new(pieces)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, ids))
        all_keys = np.concatenate((self.keys, keys))
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def plain(self, points: np.ndarray) -> bool:
        low = np.minimum(points, _LIMIT)
        kind = self.kind[low]
        if (kind == _OTHER).any():
            return False
        # a contraction is a piece of its own where an apostrophe begins a piece before a letter
        quote = np.flatnonzero(points[:-1] == 0x27)
        return not len(quote) or not (kind[quote + 1] == _LETTER).any()

    def holds_added(self, text: str) -> bool:
        """Whether the library might take part of the text for an added token of the vocabulary."""
        if "<|" not in text and all("<|" in t for t in self.added):
            return False
        low = text.lower()
        return any(t in low for t in self.added)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        points = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
        fast = [k for k, p in enumerate(points) if self.plain(p) and not self.holds_added(texts[k])]
        if slow := sorted(set(range(len(texts))) - set(fast)):
            for k, e in zip(slow, self.tokenizer.encode_batch([texts[k] for k in slow], add_special_tokens=False), strict=True):
                out[k] = np.asarray(e.ids, np.uint32)
        if fast:
            for k, ids in zip(fast, self._encode_plain([points[k] for k in fast]), strict=True):
                out[k] = ids
        return out  # type: ignore[return-value]

    def _encode_plain(self, points: list[np.ndarray]) -> Iterator[np.ndarray]:
        gap = np.array([0x20], np.uint32)
        joined = self.lower[np.concatenate([x for p in points for x in (p, gap)])]
        ends = np.cumsum([len(p) + 1 for p in points])
        kind = self.kind[joined]
        begins = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))))
        begins = begins[kind[begins] != _SPACE]
        if not len(begins):
            yield from (np.zeros(0, np.uint32) for _ in points)
            return
        edge = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT), [True])))
        stop = edge[np.searchsorted(edge, begins, "right")]
        power = self.power(len(joined) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.number[joined] * power[0, : len(joined)])))
            keys = mix((total[stop] - total[begins]) * power[1, begins])
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        if len(self.keys) + np.count_nonzero(~known) > CACHE_PIECES:
            self.clear()
            known[:] = False
        if not known.all():
            new = first[~known]
            text = joined.tobytes().decode("utf-32-le")
            self.add(unique[~known], [text[a:b] for a, b in zip(begins[new].tolist(), stop[new].tolist(), strict=True)])
            place = np.searchsorted(self.keys, unique)
        size, at = self.size[place][inverse], self.at[place][inverse]
        to = np.cumsum(size)
        ids = self.flat[np.repeat(at - (to - size), size) + np.arange(to[-1])]
        token_end = np.concatenate(([0], to))[np.searchsorted(begins, ends)]
        yield from np.split(ids, token_end[:-1])


def store(path: str) -> _Store:
    """This process's store for a tokenizer file; Python workers keep it between tasks."""
    stores = per_process("token_stores", dict)
    if path not in stores:
        stores[path] = _Store(path)
    return stores[path]
