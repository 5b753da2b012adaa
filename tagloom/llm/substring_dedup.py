"""Repeated passages across documents, by seed and extend.

Seeds.  Every window of ``WINDOW`` words is given one anchor: the 5-word gram
of least hash within it (leftmost on ties).  The choice looks at the window's
own words only, so equal windows have equal anchors, wherever they stand.

Join.  Anchors are joined by hash over all documents; those of one document
alone go.  Each anchor left is extended both ways to its *bundle*: all windows
that chose it.  A bundle whose whole text also stands in a smaller document is
repeated outright.  Only first occurrences of differing bundles around one
anchor are compared window by window.  Both comparisons are a minimum per hash
(pre-aggregated before the shuffle) and an equi-join that may be split on skew;
no two documents of a group are ever paired.

Maximal repeats.  Repeated windows of a document that overlap or touch are
merged into spans; these are the maximal repeats of at least WINDOW words.

Keys are 128 bits: the anchor's hash and the bundle's or window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch
from tagloom.llm.words import Words, grams, slices

WINDOW = 13
GRAM = 5
_SPREAD = WINDOW - GRAM + 1
_GRAM_BASE, _WINDOW_BASE, _BUNDLE_BASE = 0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its first word, its anchor's first word, the anchor's hash; and the words' hashes."""
    hashes = w.hashes()
    gram = grams(hashes, GRAM, _GRAM_BASE)
    m = len(hashes) - WINDOW + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), hashes)
    best, where = gram[:m].copy(), np.zeros(m, np.int8)
    for k in range(1, _SPREAD):
        other = gram[k : k + m]
        less = other < best
        np.copyto(best, other, where=less)
        where[less] = k
    own = np.flatnonzero(w.doc[:m] == w.doc[WINDOW - 1 :])
    return own, own + where[own], best[own], hashes


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, key, doc_id): each anchor hash of a text once."""
    for b in batches:
        ids, keys = b.column(0), b.column(1)
        for at, _, texts in slices(b.column(2)):
            w = Words(texts)
            _, q, h, _ = _windows(w)
            if not len(q):
                continue
            first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            doc, h = w.doc[q[first]], h[first]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            once = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
            take = pa.array(doc[once] + at)
            yield pa.RecordBatch.from_arrays([pa.array(h[once].view(np.int64)), keys.take(take), ids.take(take)], ["h", "key", "doc_id"])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text, shared hashes) to one row per bundle of a shared anchor."""
    for b in batches:
        ids, keys, shared = b.column(0), b.column(1), b.column(3)
        for at, to, texts in slices(b.column(2)):
            w = Words(texts)
            p, q, h, hashes = _windows(w)
            if not len(p):
                continue
            part = shared.slice(at, to - at)
            theirs = part.flatten().to_numpy().view(np.uint64)
            many = np.asarray([len(x) for x in part], np.int64)
            # a window is of interest if (its text, its anchor) is among the shared ones
            mark = _pair_key(w.doc[p], h)
            hit = np.isin(mark, _pair_key(np.repeat(np.arange(to - at), many), theirs))
            p, q, h = p[hit], q[hit], h[hit]
            if not len(p):
                continue
            windows = grams(hashes, WINDOW, _WINDOW_BASE)[p]
            head = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1))))
            size = np.diff(np.concatenate((head, [len(p)])))
            # a bundle's text: its windows in order, and where its anchor stands in them
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_weighed(windows, head, size))))
            with np.errstate(over="ignore"):
                bundle = (total[head + size] - total[head]) ^ ((q[head] - p[head]).astype(np.uint64) << np.uint64(8)) ^ size.astype(np.uint64)
            doc = w.doc[p[head]]
            take = pa.array(doc + at)
            start = p[head] - w.first[doc]
            yield pa.RecordBatch.from_arrays([
                ids.take(take), keys.take(take), pa.array(h[head].view(np.int64)), pa.array(bundle.view(np.int64)), pa.array(start.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.concatenate((head, [len(p)])).astype(np.int32)), pa.array(windows.view(np.int64))),
            ], ["doc_id", "key", "h", "bundle", "start", "windows"])


def _pair_key(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _weighed(windows: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each window's hash times a power of an odd base that tells its place in the bundle."""
    place = np.arange(len(windows)) - np.repeat(head, size)
    power = np.full(int(place.max()) + 1, _BUNDLE_BASE, np.uint64)
    power[0] = 1
    with np.errstate(over="ignore"):
        return windows * np.multiply.accumulate(power)[place]


def spans(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged [start, end) word spans, ascending: the maximal repeats."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate((start + length)[order])
    head = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return s[head], e[np.concatenate((head[1:], [len(s)])) - 1]


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        for at, to, texts in slices(b.column(1)):
            n_words, n_removed, kept, found = [], [], [], []
            for text, own in zip(texts, b.column(2).slice(at, to - at).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                merged: list[tuple[int, int]] = []
                if own:
                    ranges = np.array([(r["start"], r["length"]) for r in own], np.int64)
                    merged = list(zip(*(x.tolist() for x in spans(ranges[:, 0], ranges[:, 1])), strict=True))
                    for s, e in reversed(merged):
                        del words[s:e]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
                found.append([{"start": s, "end": e} for s, e in merged])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, to - at), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(found, span)],
                ["doc_id", "n_words", "n_removed", "kept", "removed"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    # equal (doc_id, text) rows are one case; rows that share only the id stay apart
    text: Column = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, key, start, length): word ranges whose every 13-word window also stands in a smaller document."""
    keyed = _keyed(docs).where("doc_id is not null")
    anchors = scratch.save(keyed.select("doc_id", "key", "text").mapInArrow(_anchors, "h long, key long, doc_id long"), "anchors")
    # a table of its own: the shuffle of the minima is gone before the next begins, and the join with it may be split on skew
    common = scratch.save(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "common")
    mine = scratch.save(anchors.join(common, "h").groupBy("doc_id", "key").agg(F.collect_set("h").alias("shared")), "shared")
    scratch.drop("anchors", "common")
    bundles = scratch.save(
        keyed.join(mine, ["doc_id", "key"]).select("doc_id", "key", "text", "shared").mapInArrow(_bundles, "doc_id long, key long, h long, bundle long, start int, windows array<long>"), "bundles"
    )
    scratch.drop("shared")
    first = bundles.groupBy("h", "bundle").agg(F.min("doc_id").alias("owner"))
    first = scratch.save(first, "first")
    several = first.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("several"))
    # lengths go into the join, not the windows themselves
    rows = bundles.select("doc_id", "key", "h", "bundle", "start", (F.size("windows") + WINDOW - 1).alias("length")).join(first, ["h", "bundle"])
    whole = rows.where("owner < doc_id").select("doc_id", "key", "start", "length")
    heads = first.join(several, "h").select("h", "bundle", F.col("owner").alias("doc_id"))
    edge = bundles.join(heads, ["h", "bundle", "doc_id"]).select("doc_id", "key", "h", "start", F.posexplode("windows").alias("k", "w"))
    edge = scratch.save(edge, "edge")
    least = scratch.save(edge.groupBy("h", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "w", "lo"), "least")
    parts = edge.join(least, ["h", "w"]).where("lo < doc_id").select("doc_id", "key", (F.col("start") + F.col("k")).alias("start"), F.lit(WINDOW).alias("length"))
    # each of equal rows has found the same ranges; they leave their partition once
    ranges = scratch.save(whole.unionByName(parts).distinct(), "ranges")
    scratch.drop("bundles", "first", "edge", "least")
    return ranges


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) for each row of docs (doc_id, text; more columns are ignored).

    kept: the words left, joined by one space; removed: merged word spans
    [start, end).  A null text counts as empty.  A row with a null doc_id has no
    order among documents: it keeps all its words and removes none elsewhere.
    Rows with one doc_id never repeat each other; each is judged on its own text.
    Bytes that are no UTF-8 are words' bytes like others and are shown as the
    replacement character.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    # a row per text with at most its windows; a table of its own, so that the join may be split where one row has very many copies
    ranges = repeated_ranges(docs, scratch).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "length")).alias("ranges"))
    ranges = scratch.save(ranges, "of-texts")
    return (
        _keyed(docs).join(ranges, ["doc_id", "key"], "left").select("doc_id", "text", "ranges")
        .mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
    )

