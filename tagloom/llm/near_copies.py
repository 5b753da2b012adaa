"""Near copies by similarity: the trie self-join with a wide error budget, then an exact check.

Texts link if their sets of 5-word shingles have a Jaccard similarity of 0.8 or
more.  At that similarity two SimHash fingerprints differ in about ten of 64
bits, in more than ``BUDGET`` with probability 0.0001; so wide a budget leaves
no bit block that both must share, so buckets are dealt otherwise than for
``simhash_trie.near_duplicates``:

1. Each text is a node by its hash, so exact copies collapse to one.  A node
   has a fingerprint and ``BANDS`` MinHash bands of ``ROWS`` values; texts that
   agree on a band share a bucket.  Two texts of similarity s share none with
   probability (1 - s^ROWS)^BANDS, 0.0004 at 0.8.
   Buckets of the same members count as one.
2. In each bucket the fingerprints' trie is joined with itself, pruned by the
   error budget and by what is linked already; the similarity of each pair that
   is left is computed exactly from the two sets.  A bucket gives a spanning
   forest, never its pairs.
3. Components over all buckets' forests; one row of each is kept.

A bucket of over ``BLOCK_ROWS`` members is dealt in blocks.  First each block
meets itself and a few members that all blocks share, which unites most of a
group of copies; then members outside the bucket's largest group meet all the
others, block by block.  So every pair of a bucket is compared or known to be
in one group, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch
from tagloom.llm.components import components
from tagloom.llm.simhash_trie import first_row, head_rows, majority, shingle_digests, text_key, trie_forest
from tagloom.llm.words import slices, tidy

SHINGLE_WORDS = 5
#: Least similarity of near copies, as a fraction of whole numbers.
LEAST_SHARE = (4, 5)
#: Bits of 64 that the fingerprints of near copies may differ in.
BUDGET = 20
BANDS, ROWS = 20, 5
COLUMNS = [f"b{k}" for k in range(BANDS)]
#: Members of a bucket that one block holds; one of over a thousand shingles counts once for each thousand.
BLOCK_ROWS = 1024
#: Members that all blocks of a bucket share at first.
HUBS = 8
#: Shingles whose values are computed at a time, and set members that are looked up at a time.
CHUNK, PROBES = 2048, 1 << 18
#: Node pairs walked at a time: few, so that links found early spare later comparisons.
FRONTIER = 1 << 14
_rng = np.random.Generator(np.random.PCG64(20240602))
_TIMES = _rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, ascending; a shorter text is one shingle, a wordless one a shingle of its own."""
    raw = np.frombuffer(shingle_digests(text, SHINGLE_WORDS), np.uint64)
    return np.unique(raw) if len(raw) else np.zeros(1, np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes."""
    return majority(found.view(np.uint8), len(found))


def bands(found: np.ndarray) -> list[int]:
    """The MinHash bands of a set of shingle hashes, as signed longs; the band's number is part of each."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    folded = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), CHUNK):
        part = folded[at : at + CHUNK, None] * _TIMES + _PLUS
        part ^= part >> np.uint32(15)  # else the order of values would follow from few bits
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(0), out=least)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - 2**63 for b in range(BANDS)]


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to, texts in slices(b.column(2)):
            rows = np.array([bands(shingles(t)) for t in texts], np.int64).reshape(-1, BANDS)
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns[:2]), *(pa.array(rows[:, k]) for k in range(BANDS))], ["doc_id", "key", *COLUMNS])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each key of a partition; eight bytes are held for each."""
    seen = np.zeros(0, np.int64)
    for b in batches:
        key, first = np.unique(b.column(0).to_numpy(), return_index=True)
        fresh = ~np.isin(key, seen)
        seen = np.concatenate((seen, key[fresh]))
        yield b.take(pa.array(np.sort(first[fresh])))
        tidy()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, fp, units, shingles); fp is turned so that it sorts as an unsigned number."""
    for b in batches:
        for at, to, texts in slices(b.column(1)):
            found = [shingles(t) for t in texts]
            fp = np.array([fingerprint(f) for f in found], np.uint64) ^ np.uint64(1 << 63)
            units = np.array([-(-len(f) // 1024) for f in found], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(fp.view(np.int64)), pa.array(units), pa.array([f.tobytes() for f in found], pa.binary())], ["key", "fp", "units", "shingles"])


class Sets:
    """Sets of shingle hashes, and which pairs of them reach the least similarity."""

    def __init__(self, size: np.ndarray, flat: np.ndarray) -> None:
        """size: of each set; flat: their members one set after the other, ascending within each."""
        self.size, self.first = size, np.cumsum(size) - size
        known, self.member = np.unique(flat, return_inverse=True)
        self.span = np.int64(len(known))
        self.place = np.repeat(np.arange(len(size)), size) * self.span + self.member

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether sets x[i] and y[i] reach the least similarity."""
        num, den = LEAST_SHARE
        x, y = np.where(self.size[x] <= self.size[y], x, y), np.where(self.size[x] <= self.size[y], y, x)
        good = den * self.size[x] >= num * self.size[y]
        at = np.flatnonzero(good)
        ends, done = np.cumsum(self.size[x[at]]), 0
        while done < len(at):
            before = ends[done - 1] if done else 0
            to = max(int(np.searchsorted(ends, before + PROBES, "right")), done + 1)
            a, b = x[at[done:to]], y[at[done:to]]
            pair = np.repeat(np.arange(to - done), self.size[a])
            inside = np.arange(len(pair)) - np.repeat(np.cumsum(self.size[a]) - self.size[a], self.size[a])
            wanted = b[pair] * self.span + self.member[self.first[a][pair] + inside]
            found = np.minimum(np.searchsorted(self.place, wanted), len(self.place) - 1)
            both = np.bincount(pair, weights=self.place[found] == wanted, minlength=to - done).astype(np.int64)
            good[at[done:to]] = den * both >= num * (self.size[a] + self.size[b] - both)
            done = to
        return good


def _forest(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """Links (u, v) between roots of groups of rows (.., key, root, fp, shingles) that begin at ``starts``."""
    key, root = b.column(2).to_numpy(), b.column(3).to_numpy()
    fp = b.column(4).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    raw = b.column(5).cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    flat = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
    sets = Sets(np.diff(ends) // 8, flat)
    group = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(fp)]))))
    # rows of one group and root are one already: each points at the first of them
    order = np.lexsort((np.arange(len(root)), root, group))
    head = np.concatenate(([True], (group[order][1:] != group[order][:-1]) | (root[order][1:] != root[order][:-1])))
    before = np.empty(len(root), np.int64)
    before[order] = order[head][np.cumsum(head) - 1]
    parent = trie_forest(fp, starts, BUDGET, sets.alike, before.copy(), FRONTIER)
    moved = np.flatnonzero((before == np.arange(len(before))) & (parent != before))
    return pa.RecordBatch.from_arrays([pa.array(root[moved]), pa.array(root[parent[moved]])], ["u", "v"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, block, key, root, fp, shingles) rows to links; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def solved(part: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.stack([part.column(i).to_numpy() for i in (0, 1)], 1)
        return _forest(part, np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))))

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in (0, 1)], 1)
        cut = np.flatnonzero((keys != keys[-1]).any(1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if held and (cut or tuple(keys[0]) != (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py())):
            whole = pa.concat_batches([*held, b.slice(0, cut)])
            held = []
            yield solved(whole)
        elif cut:
            yield solved(b.slice(0, cut))
        held.append(b.slice(cut))
        tidy()
    if held:
        yield solved(pa.concat_batches(held))
    tidy()


def _met(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links found among (bucket, block, key, root) rows of one bucket and block."""
    rows = dealt.join(sets.select("key", "fp", "shingles"), "key").select("bucket", "block", "key", "root", "fp", "shingles")
    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "fp").mapInArrow(_edges, "u long, v long")


def _block(blocks: Column | str) -> Column:
    """A member's block of so many."""
    return F.pmod(F.xxhash64("key", F.lit(7)), F.col(blocks) if isinstance(blocks, str) else blocks).cast("long")


def groups(docs: DataFrame, prints: DataFrame, scratch: Scratch, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, root) for each text hash that has near copies; prints: (key, and a column for each band)."""
    once = prints.groupBy("key").agg(*(F.min(c).alias(c) for c in COLUMNS))  # copies are alike
    dealt = scratch.save(once.select("key", F.explode(F.array(*COLUMNS)).alias("bucket")), "dealt")
    # buckets of the same members would find the same: of those one is looked at; members are told apart by their number and 128 bits
    members = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    shared = dealt.groupBy("bucket").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    live = scratch.save(dealt.join(shared, "bucket", "left_semi"), "live")
    scratch.drop("dealt")
    wanted = live.select(F.col("key").alias("__key")).distinct()
    # a text for each hash; of its copies one leaves each partition, so a text that fills a third of the rows is no hot key
    texts = docs.select(text_key().alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(_once, "key long, text string")
    texts = texts.join(wanted, F.col("key") == F.col("__key"), "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    sets = scratch.save(texts.mapInArrow(_sets, "key long, fp long, units long, shingles binary"), "sets")
    weighed = live.join(sets.select("key", "units"), "key")
    large, seen = scratch.save_counted(weighed.groupBy("bucket").agg(F.sum("units").alias("units")).where(F.col("units") > block_rows), "large")
    if not seen["n"]:
        edges = scratch.save(_met(live.select("bucket", F.lit(0).cast("long").alias("block"), "key", F.col("key").alias("root")), sets), "edges")
    else:
        blocked = live.join(large.withColumn("blocks", F.ceil(F.col("units") / block_rows)).drop("units"), "bucket", "left")
        own = blocked.select("bucket", F.coalesce(_block("blocks"), F.lit(0)).alias("block"), "key")
        place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("key"), "key"))
        hubs = blocked.where("blocks is not null").withColumn("place", place).where(F.col("place") <= HUBS)
        hubs = hubs.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "key")
        first = scratch.save(_met(own.unionByName(hubs).distinct().withColumn("root", F.col("key")), sets), "edges-1")
        roots = scratch.save(components(first, scratch, "c1"), "roots-1")
        edges = first.unionByName(scratch.save(_met(_outsiders(live.join(large.select("bucket"), "bucket", "left_semi"), roots, block_rows), sets), "edges-2"))
    roots = components(edges, scratch)
    scratch.drop("live", "sets", "large", "edges", "edges-1", "edges-2", "roots-1")
    return roots


def _outsiders(live: DataFrame, roots: DataFrame, block_rows: int) -> DataFrame:
    """(bucket, block, key, root): members outside their bucket's largest group dealt to meet all others, blocks in pairs."""
    rooted = live.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    per_root = rooted.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = per_root.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("inner"), (F.sum("n") - F.max("n")).alias("outer")).where(F.col("outer") > 0)
    most = most.select("bucket", "most", F.ceil(F.col("inner") / block_rows).alias("inner"), F.ceil(F.col("outer") / block_rows).alias("outer"))
    rows = rooted.join(most, "bucket")
    out, every = F.col("root") != F.col("most"), F.col("outer") + F.col("inner")
    # blocks 0 .. outer - 1 hold outsiders, the rest the largest group; a cell is a pair (i, j), i an outsiders' block, i <= j
    i = F.when(out, _block("outer")).otherwise(F.col("outer") + _block("inner"))
    cells = F.when(out, F.transform(F.sequence(F.lit(0).cast("long"), every - 1), lambda j: F.least(F.col("i"), j) * F.col("every") + F.greatest(F.col("i"), j)))
    cells = cells.otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1), lambda j: j * F.col("every") + F.col("i")))
    return rows.withColumn("i", i).withColumn("every", every).select("bucket", F.explode(cells).alias("block"), "key", "root")


def keep_near(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of each group of near copies of docs (doc_id, text; all columns stay), chosen as by ``head_rows``.

    Null or wordless texts are alike.  Rows without an id take part like others;
    different texts under one id are different documents.  Of repeated rows one
    stays.  Whole texts count, however long.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    prints = scratch.save(keyed.mapInArrow(_banded, "doc_id long, key long, " + ", ".join(f"{c} long" for c in COLUMNS)), "prints")
    roots = groups(docs, prints.select("key", *COLUMNS), scratch, block_rows)
    # least row of each text first, so that a text with many copies is one row of the join
    rows = prints.groupBy("key").agg(first_row()).join(roots, F.col("key") == F.col("node"), "left")
    least = rows.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("least").alias("least"))
    return head_rows(docs, prints, least, scratch)
