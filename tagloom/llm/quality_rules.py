"""Quality rules: fixed limits, then boosted trees over document statistics.

Statistics of many texts are taken at once on arrays.  The trees are fitted on
a bounded sample of labelled documents (``max_labelled``, by hash of the id),
with second-order boosting over quantile bins; on chosen statistics the score
may only rise or only fall.  Fitted trees are flat arrays of nodes, and a batch
of documents walks all trees at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.samples import labelled
from tagloom.llm.words import Words, grams, mix, slices

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: A document goes if its probability of low quality is above this.
REJECT_ABOVE = 0.7
MAX_LABELLED = 12_000

#: Statistic of a document -> sign of its effect on the probability of low quality (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": 1, "dup_line_share": 1, "repeat_share": 1, "upper_share": 1,
    "bang_share": 1, "digit_share": 0, "stop_share": 0, "distinct_share": 0, "words_per_line": 0, "long_word_share": 0,
}


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts and shares of each text, one array each."""
    n = len(texts)
    w = Words(texts)
    total = w.count.astype(np.float64)
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))))

    def count(members: bytes) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(members)] = True
        return np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(table[w.data], dtype=np.int64)))[bounds])

    lengths = (w.end - w.start).astype(np.int64)
    by_doc = lambda x: np.bincount(w.doc, weights=x, minlength=n)
    points = np.concatenate((np.zeros(1, np.int64), np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)))
    word_chars = by_doc((points[w.end] - points[w.start]).astype(np.float64)).astype(np.int64)
    hashes = w.hashes()

    lines = np.zeros(n, np.int64)
    dup_lines = np.zeros(n, np.int64)
    for k, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[k] = len(own)
        dup_lines[k] = len(own) - len(set(own))

    repeated = np.zeros(n, np.int64)
    gram = grams(hashes, REPEAT_WINDOW, 0xD1342543DE82EF95)
    if len(gram):
        inside = np.flatnonzero(w.doc[: len(gram)] == w.doc[REPEAT_WINDOW - 1 :])
        with np.errstate(over="ignore"):
            key = mix(gram[inside] + w.doc[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(cover, inside[twice], 1)
        np.add.at(cover, inside[twice] + REPEAT_WINDOW, -1)
        repeated = by_doc((np.cumsum(cover)[:-1] > 0).astype(np.float64)).astype(np.int64)

    with np.errstate(over="ignore"):
        own_words = mix(hashes + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(own_words, return_index=True)
    distinct = np.bincount(w.doc[first], minlength=n)
    symbols = count(SYMBOLS)
    size = np.maximum(np.diff(bounds) - 1, 1)
    each = np.maximum(total, 1)
    return {
        "n_words": w.count, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "log_words": np.log1p(total), "word_length": word_chars / each, "symbol_share": symbols / size, "dup_line_share": dup_lines / np.maximum(lines, 1),
        "repeat_share": repeated / each, "upper_share": count(bytes(range(65, 91))) / size, "bang_share": count(b"!") / size, "digit_share": count(b"0123456789") / size,
        "stop_share": count(b".,;:?") / size, "distinct_share": distinct / each, "words_per_line": total / np.maximum(lines, 1), "long_word_share": by_doc((lengths > 24).astype(np.float64)) / each,
    }


@dataclass(frozen=True)
class Trees:
    """Boosted trees as flat node arrays; row t of each is tree t, node 0 its root.  Leaves point at themselves."""

    bias: float
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            less = x[rows, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(less, self.below[tree, node], self.above[tree, node])
        return 1.0 / (1.0 + np.exp(-(self.bias + self.value[tree, node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Second-order boosting of the logistic loss.

    A split on a signed feature is taken only if its sides' values are in that
    order, and their mean bounds all values below it, so the sum is monotone.
    """
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)
    rate0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = float(np.log(rate0 / (1 - rate0)))
    score, nodes = np.full(n, bias), 2 ** (depth + 1) - 1
    feature, threshold = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf)
    below = np.tile(np.arange(nodes), (trees, 1))
    above, value = below.copy(), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        level = [(0, np.arange(n), -np.inf, np.inf)]
        for d in range(depth + 1):
            following = []
            for at, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[t, at] = np.clip(-gs / (hs + l2), low, high)
                best = (1e-6, -1, -1, 0.0, 0.0)
                for j in range(m) if d < depth and hs >= 2 * least else ():
                    k = len(edges[j])
                    if not k:
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], weights=g[rows], minlength=k + 1))[:k]
                    hl = np.cumsum(np.bincount(binned[rows, j], weights=h[rows], minlength=k + 1))[:k]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
                    gain[(hl < least) | (hr < least) | (signs[j] * (vr - vl) < 0)] = -np.inf
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, b, float(vl[b]), float(vr[b]))
                if best[1] >= 0:
                    _, j, b, vl1, vr1 = best
                    feature[t, at], threshold[t, at] = j, edges[j][b]
                    below[t, at], above[t, at] = 2 * at + 1, 2 * at + 2
                    left = binned[rows, j] <= b
                    mid, sign = (vl1 + vr1) / 2, signs[j]
                    following.append((2 * at + 1, rows[left], max(low, mid) if sign < 0 else low, min(high, mid) if sign > 0 else high))
                    following.append((2 * at + 2, rows[~left], max(low, mid) if sign > 0 else low, min(high, mid) if sign < 0 else high))
                else:
                    score[rows] += rate * value[t, at]
            level = following
    return Trees(bias, feature, threshold, below, above, value * rate, depth + 1)


def _measured(docs: DataFrame) -> DataFrame:
    """(doc_id, th, quality, statistics) of (doc_id, th, quality, text)."""
    schema = "doc_id long, th long, quality int, " + ", ".join(f"{k} double" for k in FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, texts in slices(b.column(3)):
                s = statistics(texts)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns[:3]), *(pa.array(s[k].astype(np.float64)) for k in FEATURES)], ["doc_id", "th", "quality", *FEATURES])

    return docs.select("doc_id", "th", "quality", "text").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees | None:
    """Trees for the probability that labels.quality is 0; None without labelled documents of both kinds.

    At most ``max_labelled`` labelled documents are used, those of least hash of
    id and text.  Null ids, texts and labels teach nothing; an id labelled twice
    has its least label; repeated rows count once; empty tables give None.
    """
    # at most max_labelled rows of numbers
    rows = _measured(labelled(docs, labels, "quality", max_labelled)).toPandas().sort_values(["doc_id", "th"])
    y = (rows["quality"].to_numpy() == 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit(rows[list(FEATURES)].to_numpy(np.float64), y, list(FEATURES.values()))


def _judge(trees: Trees | None, reject_above: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, texts in slices(b.column(b.schema.get_field_index("text"))):
                s = statistics(texts)
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                low = np.zeros(to - at) if trees is None else trees.probability(np.stack([s[k] for k in FEATURES], 1).astype(np.float64))
                kept = ~failed & (low <= reject_above)
                rest = [c.slice(at, to - at) for name, c in zip(b.schema.names, b.columns, strict=True) if name != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *(pa.array(s[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(kept), pa.array(low)],
                    [*(x for x in b.schema.names if x != "text"), *names, "base_failed", "kept", "low_quality"],
                )

    return run


def judge(docs: DataFrame, trees: Trees | None, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, low_quality)
    for each row of docs (doc_id, text; more columns are ignored).

    A null text has no words and fails the base.  Without trees the base alone
    decides.  Null and repeated doc_ids are judged like any other, texts whole
    however long.  An empty table gives an empty result.
    """
    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, low_quality double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judge(trees, reject_above), out)


def keep_good(docs: DataFrame, trees: Trees | None, reject_above: float = REJECT_ABOVE) -> DataFrame:
    """The rows of docs that are kept, all columns as they were; each row is judged for itself, as by ``judge``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _judge(trees, reject_above)
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column("text").cast(pa.string())], ["text"])
            verdict = pa.concat_arrays([v.column(v.schema.get_field_index("kept")) for v in inner(iter([texts]))]) if b.num_rows else pa.array([], pa.bool_())
            yield b.filter(verdict)

    return docs.mapInArrow(run, docs.schema)
