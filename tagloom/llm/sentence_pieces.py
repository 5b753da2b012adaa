"""SentencePiece ids of whole texts by a table of last tokens, and texts of ids.

A merge-type model has one encoding for each text, and so each prefix of a text
has one last token.  An automaton finds all pieces that end at a place; of
these the last token is the one that is compatible with the last token of the
prefix before it, that is, the two of them alone encode to just these two.  The
table is filled left to right in one pass and the ids are read off backwards,
in time proportional to the text, with no queue of merges.

A cut between two characters that stand side by side in no piece is no place
where a token can lie, so the text falls into segments there; each worker keeps
the ids of the segments that it has met and fills tables for new ones only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.words import Words, per_process, slices

#: How the models write a space.
SPACE = "▁"
#: Segments kept per worker process; the store starts anew beyond it, so memory is bounded and results never change.
CACHE_SEGMENTS = 400_000
#: Pairs of tokens whose compatibility is kept per worker process.
CACHE_PAIRS = 2_000_000
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = -1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The tables of one model file: pieces with merge ranks, the automaton over them, and known segments and pairs.

    Models of the merge type without rules of normalisation are taken; another
    is an error, since its ids would be wrong.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            model = proto.ModelProto.FromString(file.read())
        spec, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError(f"{path}: a merge model with byte fallback and without rules of normalisation is needed")
        self.prefix = b" " if spec.add_dummy_prefix else b""
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        pieces = [(k, p.piece, p.type) for k, p in enumerate(model.pieces)]
        normal = {text: k for k, text, kind in pieces if kind == _NORMAL}
        # merges go by score, then from the left; equal scores share a rank
        place = {s: r for r, s in enumerate(sorted({model.pieces[k].score for k in normal.values()}, reverse=True))}
        self.rank, self.no_merge = {text: place[model.pieces[k].score] for text, k in normal.items() if len(text) > 1}, len(place)
        self.text = [text for _, text, _ in pieces]
        self.bytes = np.zeros(256, np.int64)
        for k, text, kind in pieces:
            if kind == _BYTE:
                self.bytes[int(text[3:5], 16)] = k
        self.automaton = ahocorasick.Automaton()
        for text, k in normal.items():
            if self.merged(text) == [text]:  # a piece that its own characters do not merge to is never a token
                self.automaton.add_word(text, (k, len(text)))
        self.automaton.make_automaton()
        alphabet = {c for text in normal for c in text}
        self.gap = next(chr(c) for c in range(1, 0x110000) if chr(c) not in alphabet)
        self._tables_of_cuts(normal)
        self._tables_of_surfaces(pieces, model.trainer_spec.unk_surface)
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _tables_of_cuts(self, normal: dict[str, int]) -> None:
        # bytes below 0x80 stand for themselves, 0x20 for the space mark, all others for any other character
        code = lambda c: 0x20 if c == SPACE else min(ord(c), 0x80)
        self.joins = np.zeros((0x81, 0x81), bool)
        self.joins[0x80, 0x80] = True  # also within a character
        for text in normal:
            for x, y in zip(text, text[1:], strict=False):
                self.joins[code(x), code(y)] = True

    def _tables_of_surfaces(self, pieces: list[tuple[int, str, int]], unknown: str) -> None:
        shown = []
        for _, text, kind in pieces:
            shown.append({_NORMAL: text.replace(SPACE, " ").encode(), _UNKNOWN: unknown.encode(), _CONTROL: b"", _BYTE: bytes([int(text[3:5], 16)]) if kind == _BYTE else b""}[kind])
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.is_byte = np.array([kind == _BYTE for _, _, kind in pieces])
        self.is_control = np.array([kind == _CONTROL for _, _, kind in pieces])
        self.spaced = np.array([kind == _NORMAL and text.startswith(SPACE) for _, text, kind in pieces])

    def merged(self, text: str) -> list[str]:
        """A short text merged step by step, best rank first and leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(x + y, self.no_merge) for x, y in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == self.no_merge:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two tokens may stand side by side: together they encode to themselves."""
        key = before * len(self.text) + token
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            x, y = self.text[before], self.text[token]
            found = self.pairs[key] = self.merged(x + y) == [x, y]
        return found

    def last_tokens(self, text: str) -> list[int]:
        """For each length of prefix its last token; none after a character that is no piece, nor at the start."""
        last = [_NONE] * (len(text) + 1)
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] == _NONE:
                before = last[end + 1 - size]
                if before == _NONE or self.compatible(before, token):
                    last[end + 1] = token
        return last

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments one after the other, and how many each has."""
        text = self.gap.join(segments)
        last = self.last_tokens(text)
        ids: list[int] = []
        sizes, start = [], 0
        for segment in segments:
            at, own = start + len(segment), []
            while at > start:
                token = last[at]
                if token == _NONE:
                    own.extend(self.bytes[b] for b in reversed(text[at - 1].encode("utf-8", "replace")))
                    at -= 1
                else:
                    own.append(token)
                    at -= len(self.text[token])
            own.reverse()
            ids += own
            sizes.append(len(own))
            start += len(segment) + len(self.gap)
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def _learn(self, keys: np.ndarray, segments: list[str]) -> None:
        ids, size = self.encode_segments(segments)
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate((self.flat, ids))
        grown = np.concatenate((self.keys, keys))
        order = np.argsort(grown, kind="stable")
        self.keys, self.at, self.size = grown[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text with those of its begin and end."""
        parts = [self.prefix + _sound(t).replace(SPACE.encode(), b" ") if t else b"" for t in texts]
        data = np.frombuffer(b"".join([*parts, b" "]), np.uint8)
        ends = np.cumsum(np.fromiter((len(t) for t in parts), np.int64, len(parts)))
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return [np.array([self.begin, self.end], np.uint32) for _ in texts]
        code = np.minimum(data[:n], 0x80)
        cut = np.concatenate(([True], ~self.joins[code[:-1], code[1:]]))
        cut[ends[ends < n]] = True
        begins = np.flatnonzero(cut)
        stops = np.append(begins[1:], n)
        keys = Words.mapped(data, ends).range_hashes(begins, stops)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, unique)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == unique[known]
        if len(self.keys) + np.count_nonzero(~known) > CACHE_SEGMENTS:
            self.clear()
            known[:] = False
        if not known.all():
            raw = data.tobytes()
            new = first[~known]
            self._learn(unique[~known], [raw[a:b].decode().replace(" ", SPACE) for a, b in zip(begins[new].tolist(), stops[new].tolist(), strict=True)])
            place = np.searchsorted(self.keys, unique)
        size, at = self.size[place][inverse], self.at[place][inverse]
        to = np.cumsum(size)
        ids = self.flat[np.repeat(at - (to - size), size) + np.arange(to[-1])]
        token_end = np.concatenate(([0], to))[np.searchsorted(begins, ends)]
        out = []
        for own in np.split(ids, token_end[:-1]):
            out.append(np.concatenate((np.array([self.begin], np.uint32), own, np.array([self.end], np.uint32))))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 text of each list of ids: control ids show nothing, one space at the start was put there by ``encode``, byte ids form characters."""
        every = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        size = self.shown_size[every]
        to = np.cumsum(size)
        flat = self.shown[np.repeat(self.shown_at[every] - (to - size), size) + np.arange(to[-1] if len(to) else 0)].tobytes()
        token_end = np.cumsum([len(x) for x in ids])
        ends = np.concatenate(([0], to))[token_end].tolist() if ids else []
        out, start = [], 0
        for own, end in zip(ids, ends, strict=True):
            visible = np.flatnonzero(~self.is_control[own])
            stripped = bool(self.prefix and len(visible) and self.spaced[own[visible[0]]])
            raw = flat[start + stripped : end]
            start = end
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self._with_broken_runs(own, stripped)
            out.append(raw)
        return out

    def _with_broken_runs(self, ids: np.ndarray, stripped: bool) -> bytes:
        """Byte ids that form no character each show the replacement character."""
        out, run = bytearray(), bytearray()
        for k in [*ids.tolist(), None]:
            if k is not None and self.is_byte[k]:
                run.append(int(self.shown[self.shown_at[k]]))
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out += bytes(run[:n]).decode().encode()
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out, n = out + "�".encode(), 1
                del run[:n]
            if k is not None:
                out += self.shown[self.shown_at[k] : self.shown_at[k] + self.shown_size[k]].tobytes()
        return bytes(out[stripped:])


def _sound(text: bytes) -> bytes:
    """Bytes that are no UTF-8 become the replacement character."""
    try:
        text.decode()
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def model(path: str) -> Model:
    """This process's tables for a model file; Python workers keep them between tasks."""
    models = per_process("piece_models", dict)
    if path not in models:
        models[path] = Model(path)
    return models[path]


def _encoded(path: str, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            for at, to, texts in slices(b.column(1)):
                ids = own.encode(texts)
                flat = np.concatenate(ids)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                columns = [b.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))]
                if decoded:
                    columns.append(pa.array([x.decode() for x in own.decode(ids)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return run


def _digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            for at, to, texts in slices(b.column(1)):
                ids = own.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, to - at), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids)]),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model_path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text; more columns are ignored), with begin and end ids, and ``decoded``: the text of these ids, if asked for.

    model_path: path of a model file, on every machine.  A null or empty text
    has its begin and end alone; bytes that are no UTF-8 count as the
    replacement character.  Rows with null or repeated ids are encoded like any
    other; an empty table gives an empty one.  Rows are worked on where they are
    read: nothing is shuffled, and texts of any length are held one at a time.
    """
    return _texts(docs).mapInArrow(_encoded(model_path or default_model(), decoded), "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the text of each list of ids; a null list gives a null text, null elements are left out."""
    path = model_path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            lists = b.column(1).to_pylist()
            texts = own.decode([np.array([k for k in x or [] if k is not None], np.uint32) for x in lists])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode() for x, t in zip(lists, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row of docs: digests of what ``encode`` gives, made in the same pass."""
    return _texts(docs).mapInArrow(_digests(model_path or default_model()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
