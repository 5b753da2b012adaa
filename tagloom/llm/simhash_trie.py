"""SimHash near-duplicates by a binary-trie self-join.

1. One 64-bit fingerprint per document, from the XXH64 of its 4-word shingles.
2. Equal fingerprints collapse to one row, so exact copies cost one row each.
3. Fingerprints are dealt by two of six bit blocks: two that differ in at most
   four bits agree on at least two blocks, so every link lies within a bucket.
4. Within a bucket, sorted fingerprints are the leaves of a binary trie.  Pairs
   of trie nodes are walked together from the root, differing bits add up, and
   a pair goes once the budget is exceeded, or once both sides are known to be
   one component.  A bucket gives a spanning forest, never all its pairs.
5. Components over all buckets' forests; each document gets its component's
   smallest doc_id.

A bucket of over ``bucket_rows`` fingerprints is dealt again in blocks: each
pair of blocks is a task of its own, so no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.functions.lineage import Scratch
from tagloom.llm.words import slices

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Widths of the six blocks, from the top bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints that one trie walk holds in memory at most, from each of two blocks.
BUCKET_ROWS = 500_000
#: Node pairs walked at a time.
FRONTIER = 1 << 18
#: Node pairs of at most so many row pairs are compared row by row.
LEAF_PAIRS = 16
#: Which of the pairs (x[i], y[i]) of rows link.
Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_digests(text: bytes, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """The XXH64 digests, eight bytes each, of a text's shingles in order; a shorter text is one shingle, a wordless one none."""
    words = text.lower().split()
    if not words:
        return b""
    digest = xxhash.xxh64_digest
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    k = shingle_words - 1
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(starts) - k].tolist(), ends[k:].tolist(), strict=True)])


def fingerprint(text: bytes) -> int:
    """The SimHash of one text: bit set where over half the shingle hashes have it."""
    raw = shingle_digests(text)
    return majority(np.frombuffer(raw, np.uint8), len(raw) // 8)


def majority(digests: np.ndarray, n: int) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is counted in pieces
        part = digests[8 * at : 8 * min(at + (1 << 16), n)]
        ones += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text, with its fingerprint in its place."""
    for b in batches:
        found = np.fromiter((fingerprint(t) for _, _, texts in slices(b.columns[-1]) for t in texts), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found.view(np.int64))], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _bucket_keys() -> list[Column]:
    low, parts = 64, []
    for width in BLOCKS:
        low -= width
        parts.append((F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1), width))
    return [
        (F.lit(i << 24).cast("int") + F.shiftleft(a, wb).cast("int") + b.cast("int"))
        for i, ((a, _), (b, wb)) in enumerate(combinations(parts, len(BLOCKS) - MAX_BITS))
    ]


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the sets of a[i] and b[i]; parent stays flat (every row points at its least row)."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def trie_forest(fp: np.ndarray, starts: np.ndarray, budget: int = MAX_BITS, check: Check | None = None, parent: np.ndarray | None = None, frontier: int = FRONTIER) -> np.ndarray:
    """For each row of sorted groups, the least row of its group linked to it by steps within the budget.

    fp: unsigned, ascending within each group; groups begin at ``starts``.  The
    groups' tries are walked at once, level by level, depth first over chunks of
    the frontier, so memory stays at a few chunks.  Nodes of few rows are not
    walked further: their rows are compared pair by pair.  check: says which
    pairs within the budget do link; pairs known to be linked are not asked
    for.  parent: what is linked already, flat, changed in place.
    """
    n = len(fp)
    parent = np.arange(n) if parent is None else parent
    ends = np.concatenate((starts[1:], [n]))
    many = ends - starts > 1
    s, e = starts[many], ends[many]
    zero = np.zeros(len(s), np.int8)
    stack = [(0, c, c_e, c, c_e, z) for c, c_e, z in _pieces(s, e, zero, frontier)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if level % 8 == 0 and level:  # nodes that are one component already link nothing new
            change = np.concatenate(([0], np.cumsum(parent[1:] != parent[:-1])))
            known = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (parent[a0] == parent[b0])
            a0, a1, b0, b1, err = (x[~known] for x in (a0, a1, b0, b1, err))
        leaf = (a1 - a0) * (b1 - b0) <= LEAF_PAIRS
        if level == 64:
            leaf[:] = True
        if leaf.any():
            for x, y in _row_pairs(a0[leaf], a1[leaf], b0[leaf], b1[leaf], frontier):
                close = (np.bitwise_count(fp[x] ^ fp[y]) <= budget) & (parent[x] != parent[y])
                x, y = x[close], y[close]
                if check is not None and len(x):
                    good = check(x, y)
                    x, y = x[good], y[good]
                join(parent, x, y)
            a0, a1, b0, b1, err = (v[~leaf] for v in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if level not in ones:
            ones[level] = np.concatenate(([0], np.cumsum((fp >> np.uint64(63 - level)) & np.uint64(1)))).astype(np.int64)
        count = ones[level]
        am, bm = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        own = a0 == b0
        cross = ~own
        step = (err + 1).astype(np.int8)
        out = [np.concatenate(x) for x in zip(
            (a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, step),
            (am[cross], a1[cross], b0[cross], bm[cross], step[cross]), strict=True)]
        keep = (out[1] > out[0]) & (out[3] > out[2]) & (out[4] <= budget) & ~((out[0] == out[2]) & (out[1] - out[0] == 1))
        out = [x[keep] for x in out]
        for at in range(0, len(out[0]), frontier):
            stack.append((level + 1, *(x[at : at + frontier] for x in out)))
    return parent


def _pieces(s: np.ndarray, e: np.ndarray, z: np.ndarray, frontier: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for at in range(0, len(s), frontier):
        yield s[at : at + frontier], e[at : at + frontier], z[at : at + frontier]


def _row_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) of node pairs, about ``most`` at a time; within one node each pair once."""
    wide = b1 - b0
    ends = np.cumsum((a1 - a0) * wide)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, before + most, "right")), at + 1)
        many = np.diff(ends[at:to], prepend=before)
        node = np.repeat(np.arange(at, to), many)
        place = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many)
        x, y = a0[node] + place // wide[node], b0[node] + place % wide[node]
        once = (a0[node] != b0[node]) | (x < y)
        yield x[once], y[once]
        at = to


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, block, fp) rows to spanning forests; a bucket may span batches."""

    def solve(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
        parent = trie_forest(fp, starts)
        child = np.flatnonzero(parent != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child].view(np.int64)), pa.array(fp[parent[child]].view(np.int64))], ["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
        fp = (b.column(2).to_numpy().view(np.uint64)) ^ np.uint64(1 << 63)  # Spark sorted them as signed; turned, they ascend as unsigned
        cut = np.flatnonzero((keys != keys[-1]).any(1))
        cut = cut[-1] + 1 if len(cut) else 0
        if cut:
            held.append((keys[:cut], fp[:cut]))
            yield _turned(solve(*(np.concatenate(x) for x in zip(*held, strict=True))))
            held = []
        held.append((keys[cut:], fp[cut:]))
    if held:
        yield _turned(solve(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _turned(b: pa.RecordBatch) -> pa.RecordBatch:
    turn = np.int64(-(1 << 63))
    return pa.RecordBatch.from_arrays([pa.array(c.to_numpy() ^ turn) for c in b.columns], b.schema.names)


def links(distinct: DataFrame, scratch: Scratch, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) between fingerprints whose components are those of "at most MAX_BITS bits apart".

    distinct: fp (long), each once.
    """
    dealt = distinct.select("fp", F.posexplode(F.array(*_bucket_keys())).alias("combo", "bucket")).drop("combo")
    large = scratch.save(dealt.groupBy("bucket").count().where(F.col("count") > bucket_rows), "large")
    if large.head(1):
        # Blocks by hash; block pair (i, j), i <= j, gets a row of block i or j once.
        m = F.ceil(F.col("count") / F.lit(bucket_rows)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
        dealt = dealt.join(large.select("bucket", m.alias("m")), "bucket", "left").select(
            "bucket", "fp", F.coalesce("m", F.lit(1)).alias("m")
        ).select("bucket", "fp", "m", mine.alias("i")).select(
            "bucket", "fp", "m", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j")
        ).select("bucket", (F.least("i", "j") * F.col("m") + F.greatest("i", "j")).cast("int").alias("block"), "fp")
    else:
        dealt = dealt.select("bucket", F.lit(0).alias("block"), "fp")
    return dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "fp").mapInArrow(_edges, "u long, v long")


def text_key() -> Column:
    """A 64-bit hash of the column text."""
    return F.xxhash64(F.col("text").cast("string"))


def first_row() -> Column:
    """Of some (doc_id, key) the first: least id, null last, then least text hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("least")


def _placed(distinct: DataFrame, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """(fp, least, root) of distinct (fp, least): root is the component's least fingerprint."""
    edges = scratch.save(links(distinct.select("fp"), scratch, bucket_rows), "edges")
    roots = components(edges, scratch)
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = scratch.save(placed, "placed")
    scratch.drop("distinct", "edges", "large")
    return placed


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text; more columns are ignored).

    Null or wordless texts have fingerprint zero and link like any other.  Rows
    with a null doc_id are returned; they take part in links, and a component of
    such rows alone has a null id.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    prints = scratch.save(fingerprints(docs), "prints")
    placed = _placed(scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), scratch, bucket_rows)
    # a written table, so that the join has plain shuffles on both sides and a component of very many fingerprints is split
    least = scratch.save(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    mapped = placed.join(least, "root").select("fp", "component_id")
    return prints.join(mapped, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def head_rows(docs: DataFrame, prints: DataFrame, least: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of docs for each group: of its smallest doc_id, null last, and of that the least text hash; of repeated rows one.

    prints: (doc_id, key) of each row, key as from ``text_key``; least:
    ``first_row`` of each group, whichever groups share an id.
    """
    heads = scratch.save(least.select("least.doc_id", "least.key").distinct(), "heads")
    # a text lies in one group, so id and text hash name the group; sort-merge at every size, open to the skew split
    # the row itself is one column, so names cannot clash
    mine = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_key().alias("key")).alias("m")
    found = mine.join(heads.alias("h").hint("merge"), (F.col("m.key") == F.col("h.key")) & F.col("m.id").eqNullSafe(F.col("h.doc_id")), "left_semi")
    if prints.groupBy("doc_id", "key").count().where("count > 1").head(1):
        found = found.dropDuplicates(["id", "key"])
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group of docs, all columns as they were; which one, see ``head_rows``."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    prints = scratch.save(keyed.mapInArrow(_fingerprints, "doc_id long, key long, fp long"), "prints")
    placed = _placed(scratch.save(prints.groupBy("fp").agg(first_row()), "distinct"), scratch, BUCKET_ROWS)
    return head_rows(docs, prints, placed.groupBy("root").agg(F.min("least").alias("least")), scratch)
