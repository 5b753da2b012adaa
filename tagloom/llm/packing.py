"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents are cut only where longer than a sequence, so an instance is fully
described by how many pieces there are of each length: at most ``capacity``
numbers, whatever the corpus.  The driver reduces and packs that histogram
into patterns with multiplicities; documents take their places from their rank
among pieces of equal length.  Ranks are a running count in each input
partition plus the counts of the partitions before it, so no length's
documents ever meet in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.fast_tokens import store
from tagloom.functions.lineage import Scratch
from tagloom.llm.words import slices

CAPACITY = 2048
TAIL_ID = 0
Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, number of such sequences


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction: (fixed patterns, what is left).

    For an item j, longest first, with room r beside it and k the longest item
    that fits there, {j, k} dominates every set with j if k fills r exactly; if
    no two other items fit beside j; or if no three do, and every two that fit
    are together no longer than k.  {j} alone is fixed if nothing fits.  Items
    only leave, so a criterion that holds goes on holding for equal items.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[Pattern] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for x in lengths:
            left[x] -= times
            if not left[x]:
                del left[x]

    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                others = lambda x, j=j: left.get(x, 0) - (x == j)
                fitting = [x for x in left if x <= room and others(x) > 0]
                if not fitting:
                    fix((j,), left[j])
                    again = True
                    break
                k = max(fitting)
                small = []
                for x in sorted(fitting):
                    small += [x] * min(3 - len(small), others(x))
                    if len(small) == 3:
                        break
                if not (k == room or sum(small[:2]) > room or len(small) < 2 or (len(small) < 3 or sum(small) > room) and _longest_pair(fitting, others, room) <= k):
                    break
                fix((j, k), left[j] // 2 if j == k else min(left[j], left[k]))
                again = True
    return fixed, left


def _longest_pair(fitting: list[int], others: Callable[[int], int], room: int) -> int:
    """The longest two items that fit into the room together."""
    xs, best = sorted(fitting), 0
    lo, hi = 0, len(xs) - 1
    while lo <= hi:
        if xs[lo] + xs[hi] > room or lo == hi and others(xs[lo]) < 2:
            hi -= 1
        else:
            best = max(best, xs[lo] + xs[hi])
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: each length goes to the fullest sequences that take it."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        open_[room][lengths] = open_[room].get(lengths, 0) + times

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            room = min((r for r, b in open_.items() if r >= x and b), default=capacity)
            if not open_[room]:
                q = room // x
                if n >= q:
                    put(room - q * x, (x,) * q, n // q)
                if n % q:
                    put(room - n % q * x, (x,) * (n % q), 1)
                n = 0
                continue
            lengths, bins = next(iter(open_[room].items()))
            q = min(room // x, n)
            take = min(bins, n // q)
            del open_[room][lengths]
            if bins > take:
                put(room, lengths, bins - take)
            put(room - q * x, lengths + (x,) * q, take)
            n -= take * q
    return [(lengths, times) for bins in open_.values() for lengths, times in bins.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first rank), and each interval's sequence of that rank and offset."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            rows.append((x << 40 | taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def _pieces(tokenizer: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = store(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()  # type: ignore[union-attr]
        for b in batches:
            for at, _, texts in slices(b.column(1)):
                doc, piece, start, length, crc = [], [], [], [], []
                for d, ids in enumerate(encoder.encode([t.decode("utf-8", "replace") for t in texts])):
                    raw = np.append(ids, np.uint32(TAIL_ID)).astype("<u4").tobytes()
                    for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[s : s + 4 * capacity]
                        doc.append(at + d)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                size = np.array(length, np.int64)
                order = np.argsort(size, kind="stable")
                head = np.flatnonzero(np.concatenate(([True], np.diff(size[order]) != 0)))
                many = np.diff(np.concatenate((head, [len(size)])))
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(head, many) + seen[size[order]]
                seen[size[order[head]]] += many
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def _place(table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key, sequence, offset = table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (b.column(3).to_numpy() << 40) | b.column(5).to_numpy()
            at = np.searchsorted(key, own, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + (own - key[at])), pa.array(offset[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of docs (doc_id, text; more columns are ignored):
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer: path of a tokenizer file, on every machine.  A null or empty text
    is the tail id alone.  Rows with a null or repeated doc_id are packed like
    any other.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer or default_tokenizer(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    )
    pieces = scratch.save(pieces, "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    # at most `capacity` rows
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    # a row of `before` per part and length grows with the input, so it is never broadcast; a part has few pieces of a length
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
