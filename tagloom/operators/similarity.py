"""Similarity of items by tags, signatures and vectors (OP-150 to OP-175, OP-257 to OP-262)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.columns import category_weight, cosine, hamming, hash_score, hybrid_score
from tagloom.functions.lineage import Scratch, small
from tagloom.operators.graphs import connected
from tagloom.sources.proxies import Catalog

ALPHA = 0.6
METHODS = ("jaccard", "weighted", "weighted_tfidf", "asymmetric", "asymmetric_tfidf")
#: Rows of a block when every pair has to be compared.
BLOCK = 2048
#: Values that a task holds of its sources' vectors, and of their best so far.
HELD_VALUES = 1 << 22
#: Sources and others whose products are held at a time, and candidates that wait to be ranked.
PRODUCT_ROWS, PRODUCT_COLUMNS, WAITING = 128, 4096, 1 << 20


def tag_weights(item_tags: DataFrame, n_items: DataFrame) -> DataFrame:
    """(tag, category, n, weight, weight2): category weight over ln(n + 1), and times ln(N / (n + 1)) + 1 (OP-151 to OP-153).

    n_items: one row, column ``total``.
    """
    counts = item_tags.groupBy("tag", "category").agg(F.count("*").cast("double").alias("n"))
    w = category_weight(F.col("category"))
    return counts.join(F.broadcast(n_items), F.lit(True)).select("tag", "category", "n", (w / F.log(F.col("n") + 1)).alias("weight"), (w * (F.log(F.col("total") / (F.col("n") + 1)) + 1)).alias("weight2"))


def catalog_weights(c: Catalog) -> DataFrame:
    return tag_weights(c.item_tags, c.items.agg(F.count("*").cast("double").alias("total")))


def score(method: str, inter: Column, own: Column, other: Column, alpha: float = ALPHA) -> Column:
    """Similarity from weight sums of the intersection, the query and the other side (OP-154 to OP-158)."""
    if method not in METHODS:
        raise ValueError(method)
    union = own + other - inter
    share = F.coalesce(F.try_divide(inter, union), F.lit(0.0))
    if method.startswith("asymmetric"):
        return alpha * F.coalesce(F.try_divide(inter, own), F.lit(0.0)) + (1 - alpha) * share
    return share


def method_of(name: str | None) -> str:
    """A configured method; weighted where none is named, jaccard where the name is unknown (OP-158)."""
    return "weighted" if not name else name if name in METHODS else "jaccard"


def similar_by_tags(c: Catalog, item_id: int, method: str = "weighted", general_only: bool = False) -> DataFrame:
    """(item_id, score) of all items that share a tag with the query item (OP-080, OP-150 to OP-157).

    One pass over the tag table: each item's weight and the part of it that the
    query shares; the query's own tags are a few rows.
    """
    method = method_of(method)
    weight = {"jaccard": F.lit(1.0)}.get(method, F.col("weight2") if method.endswith("tfidf") else F.col("weight"))
    weighed = c.item_tags.join(catalog_weights(c), ["tag", "category"]).select("item_id", "tag", "category", weight.alias("w"))
    query = c.item_tags.where(F.col("item_id") == item_id)
    if general_only:  # fall back on all tags where there is no general one
        some = F.max(F.when(F.col("category") == "general", 1).otherwise(0)).over(Window.partitionBy("item_id"))
        query = query.withColumn("g", some).where((F.col("category") == "general") | (F.col("g") == 0))
    query = query.select("tag", "category", F.lit(1).alias("hit"))
    own = weighed.join(query, ["tag", "category"]).where(F.col("item_id") == item_id).agg(F.sum("w").alias("own"))
    sums = weighed.where(F.col("item_id") != item_id).join(query, ["tag", "category"], "left").groupBy("item_id").agg(F.sum("w").alias("other"), F.sum(F.when(F.col("hit") == 1, F.col("w"))).alias("inter"))
    return sums.where("inter is not null").join(F.broadcast(own), F.lit(True)).select("item_id", score(method, F.col("inter"), F.col("own"), F.col("other")).alias("score"))


def top(scored: DataFrame, k: int, least: float | None = None, digits: int = 6) -> DataFrame:
    """The k best of (item_id, score), ties to the smaller id, with their rank."""
    kept = scored if least is None else scored.where(F.col("score") > least)
    best = kept.select("item_id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "item_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "item_id")).cast("int"))  # over k rows


def related_by_tags(c: Catalog, item_id: int, k: int = 20) -> DataFrame:
    """Related items: the query's general tags against all tags, over 0.1 (OP-160)."""
    return top(similar_by_tags(c, item_id, "weighted", general_only=True), k, 0.1)


def in_cells(rows: DataFrame, group: Column, blocks: int, solve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows (id, v) dealt to cells of a grid of block pairs, so that each pair of rows of a group meets in one cell.

    solve reads rows (g, i, j, side, id, v) sorted by cell: block i's rows have
    side 0 and come first, block j's side 1; in a cell (i, i) there is one side.
    A row goes to ``blocks`` cells.
    """
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    cells = F.transform(every, lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), F.when(k < own, 1).otherwise(0).alias("side")))
    dealt = rows.select(group.alias("g"), F.explode(cells).alias("c"), "id", "v").select("g", "c.i", "c.j", "c.side", "id", "v")
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "id").mapInArrow(solve, schema)


def in_rectangle(own: DataFrame, others: DataFrame, group: Column, sizes: tuple[int, int], solve: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """As ``in_cells``, for two tables (id, v): each row of the one meets each row of its group in the other in one cell, the first table's rows on side 0, each side in order of id.

    sizes: how many blocks each table is cut into.  A row goes to as many cells
    as the other table has blocks, so a short table makes few copies of a long
    one.  Each cell of a group is a partition of its own.
    """

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(sizes[side])).cast("int")
        far = F.explode(F.sequence(F.lit(0), F.lit(sizes[1 - side] - 1)))
        cut = rows.select(group.alias("g"), block.alias("block"), far.alias("far"), "id", "v")
        i, j = ("block", "far") if side == 0 else ("far", "block")
        return cut.select("g", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "id", "v")

    cell = F.pmod(F.col("i") * sizes[1] + F.col("j") + F.hash("g"), F.lit(sizes[0] * sizes[1]))
    met = dealt(own, 0).unionByName(dealt(others, 1)).repartitionById(sizes[0] * sizes[1], cell)
    return met.sortWithinPartitions("g", "i", "j", "side", "id").mapInArrow(solve, schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], bool]]:
    """Each cell's (ids, vectors) of both sides, and whether they are one block; a cell may span batches."""
    held: list[pa.RecordBatch] = []

    def cut(part: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], bool]:
        side, ids = part.column(3).to_numpy(), part.column(4).to_numpy()
        v = part.column(5).flatten().to_numpy().reshape(len(part), -1)
        x = ids[side == 0], v[side == 0]
        same = part.column(1)[0] == part.column(2)[0]
        return x, (x if same else (ids[side == 1], v[side == 1])), same

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in range(3)], 1)
        edges = np.flatnonzero(np.concatenate(([False], (keys[1:] != keys[:-1]).any(1))))
        if held and tuple(keys[0]) != tuple(held[-1].column(c)[-1].as_py() for c in range(3)):
            yield cut(pa.concat_batches(held))
            held = []
        at = 0
        for to in edges.tolist():
            yield cut(pa.concat_batches([*held, b.slice(at, to - at)]))
            held, at = [], to
        held.append(b.slice(at))
    if held:
        yield cut(pa.concat_batches(held))


def _near_signatures(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x_ids, x), (y_ids, y), same in _cells(batches):
            for k in range(len(x_ids)):  # a row against a block at a time, on arrays
                first = k + 1 if same else 0
                d = np.bitwise_count(x[k, 0] ^ y[first:, 0]).astype(np.int32) + np.bitwise_count(x[k, 1] ^ y[first:, 1])
                near = np.flatnonzero(d <= threshold)
                if len(near):
                    other, own = y_ids[first + near], np.full(len(near), x_ids[k])
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(d[near])], ["a", "b", "distance"])

    return run


def _members(signatures: DataFrame) -> DataFrame:
    """(item_id, w0, w1, head), written: head is the least id with the same signature."""
    own = signatures.select(F.col("item_id").cast("long").alias("item_id"), "w0", "w1")
    heads = own.groupBy("w0", "w1").agg(F.min("item_id").alias("head"))
    return Scratch(signatures.sparkSession, "signatures").save(own.join(heads, ["w0", "w1"]).select("item_id", "w0", "w1", "head"), "members")


def _links(members: DataFrame, threshold: int, rows: int | None = None) -> DataFrame:
    """(a, b, distance), a < b, between different signatures at most so far apart, each under its least id (OP-078).

    Signatures within t bits agree on one of t + 1 bands; with few bands that is
    an equi-join.  With many, bands are too narrow to narrow anything, and pairs
    meet on a grid of blocks, compared on arrays.
    """
    distinct = members.where("item_id = head").drop("head")
    if threshold < 8:
        d = hamming([F.col("a.w0"), F.col("a.w1")], [F.col("b.w0"), F.col("b.w1")])
        n = threshold + 1
        edge = [round(k * 64 / n) for k in range(n + 1)]
        bits = F.lpad(F.bin("w0"), 32, "0"), F.lpad(F.bin("w1"), 32, "0")
        banded = distinct.select("*", F.concat(*bits).alias("s")).select("item_id", "w0", "w1", F.posexplode(F.array(*(F.substring("s", edge[k] + 1, edge[k + 1] - edge[k]) for k in range(n)))).alias("k", "band"))
        a, b = banded.alias("a"), banded.alias("b")
        met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.item_id") < F.col("b.item_id")) & (d <= threshold))
        return met.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), d.cast("int").alias("distance")).distinct()
    blocks = max(1, -(-(rows if rows is not None else distinct.count()) // BLOCK))
    own = distinct.select(F.col("item_id").alias("id"), F.array("w0", "w1").alias("v"))
    return in_cells(own, F.lit(0), blocks, _near_signatures(threshold), "a long, b long, distance int")


def hamming_pairs(signatures: DataFrame, threshold: int, rows: int | None = None) -> DataFrame:
    """(a, b, distance), a < b, of all 64-bit signatures (item_id, w0, w1) at most so far apart (OP-078, OP-176).

    Different signatures are compared once; what has equal ones is laid out
    after that, so only the result grows with the square of a group of copies.
    """
    members = _members(signatures)
    own = members.select("head", "item_id")
    links = _links(members, threshold, rows)
    x, y = own.select(F.col("head").alias("a"), F.col("item_id").alias("x")), own.select(F.col("head").alias("b"), F.col("item_id").alias("y"))
    apart = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    left, right = own.alias("l"), own.alias("r")
    equal = left.join(right, (F.col("l.head") == F.col("r.head")) & (F.col("l.item_id") < F.col("r.item_id"))).select(F.col("l.item_id").alias("a"), F.col("r.item_id").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(equal)


def signature_groups(signatures: DataFrame, threshold: int) -> DataFrame:
    """(group_id, item_id) of items in groups of near signatures, over all chains; equal ones are never paired (OP-166)."""
    members = _members(signatures)
    linked = connected(_links(members, threshold)).select(F.col("item_id").alias("head"), "group_id")
    sizes = members.groupBy("head").agg(F.count("*").alias("n"))
    rows = members.join(sizes, "head").join(linked, "head", "left").where("n > 1 or group_id is not null")
    return rows.select(F.coalesce("group_id", "head").alias("group_id"), "item_id")


def visual_range(signatures: DataFrame, item_id: int, threshold: float, k: int, exclude: DataFrame | None = None, colour: float = 0.0) -> DataFrame:
    """The k items of least effective distance to one item, within a threshold (OP-165).

    colour: the share of the colour signature (c0, 32 bits) in the score; an
    item without one, or compared with one without, has a colour score of 0.
    """
    own = ["w0", "w1", *["c0"] * (colour > 0)]
    one = signatures.where(F.col("item_id") == item_id).select(*(F.col(c).alias(f"q_{c}") for c in own))  # one row
    structure = hash_score(hamming([F.col("w0"), F.col("w1")], [F.col("q_w0"), F.col("q_w1")]))
    shade = hash_score(hamming([F.col("c0")], [F.col("q_c0")]), 32) if colour > 0 else F.lit(0.0)
    distance = hybrid_score(structure, shade, colour)[1]
    found = signatures.where(F.col("item_id") != item_id).join(F.broadcast(one), F.lit(True)).select("item_id", distance.alias("distance")).where(F.col("distance") <= threshold)
    if exclude is not None:
        found = found.join(exclude, "item_id", "left_anti")
    best = found.orderBy("distance", "item_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("distance", "item_id")).cast("int"))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(group_id, item_id) of items linked by pairs, over all chains of pairs (OP-166)."""
    return connected(pairs).select("group_id", "item_id")


def nearest(vectors: DataFrame, item_id: int, k: int, id_column: str = "vec_id", exclude: DataFrame | None = None) -> DataFrame:
    """The k vectors of greatest cosine to one item's (OP-079, OP-169, OP-170)."""
    one = vectors.where(F.col(id_column) == item_id).select(F.col("embedding").alias("q"))  # one row
    scored = vectors.where(F.col(id_column) != item_id).join(F.broadcast(one), F.lit(True)).select(F.col(id_column).alias("item_id"), cosine(F.col("embedding"), F.col("q")).alias("score"))
    if exclude is not None:
        scored = scored.join(exclude, "item_id", "left_anti")
    return top(scored, k, digits=5)


class _Nearest:
    """The k others of greatest cosine to each of a block of sources, while the others come by in order of id.

    Products are taken in single precision first.  What may stand before a
    source's k-th best so far, by the bound of their error, is taken anew in
    double precision; an equal score comes too late, since its id is larger.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, digits: int) -> None:
        self.ids, self.v, self.k, self.scale = ids, v, k, 10.0**digits
        self.length, self.unit = self._unit(v)
        self.error = (v.shape[1] + 10) * 2.0**-24
        self.best, self.of = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.least = np.full(len(ids), np.finfo(np.float32).min)  # a product below it counts no more
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.step, self.most = 0, max(4 * k, 256), min(WAITING, len(ids) * max(k, 8) // 2)

    @staticmethod
    def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, unit = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64)), np.empty(v.shape, np.float32)
        return length, np.divide(v, length[:, None], out=unit, casting="unsafe")

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        at = 0
        while at < len(ids):  # few at first, so that later ones find a k-th best
            to = at + self.step
            self._meet(ids[at:to], v[at:to])
            at, self.step = to, min(2 * self.step, max(4 * self.k, PRODUCT_COLUMNS))

    def _meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        length, unit = self._unit(v)
        columns = np.zeros((v.shape[1], -(-len(ids) // 8) * 8), np.float32)  # eight comparisons are looked at as one word
        columns[:, : len(ids)] = unit.T
        order = np.argsort(ids, kind="stable")
        first, last = (np.searchsorted(ids[order], self.ids, side) for side in ("left", "right"))
        self_r = np.repeat(np.arange(len(self.ids)), last - first)
        self_c = order[np.arange(len(self_r)) - np.repeat(np.cumsum(last - first) - last, last - first)]
        for at in range(0, len(self.ids), PRODUCT_ROWS):
            s, least = self.unit[at : at + PRODUCT_ROWS] @ columns, self.least[at : at + PRODUCT_ROWS]
            a, b = np.searchsorted(self_r, (at, at + PRODUCT_ROWS))
            s[self_r[a:b] - at, self_c[a:b]] = -np.inf
            s[:, len(ids) :] = -np.inf
            rows = np.flatnonzero(s.max(axis=1) >= least)
            if not len(rows):
                continue
            if len(rows) < len(s):
                s, least = s[rows], least[rows]
            enough = s >= least[:, None]
            if np.count_nonzero(enough) > 2 * self.k * len(rows):  # of these others alone, what may be one of the k best
                kth = np.partition(s, -self.k, axis=1)[:, -self.k]
                enough = s >= np.maximum(least, kth - np.float32(2 * self.error + 1 / self.scale + 1e-6))[:, None]
            words = np.flatnonzero(enough.view(np.uint64))
            word, place = np.nonzero(enough.reshape(-1, 8)[words])
            r, c = np.divmod(words[word] * 8 + place, enough.shape[1])
            r = rows[r] + at
            raw = np.concatenate([np.empty(0), *(self._exact(r[x : x + 65536], v, length, c[x : x + 65536]) for x in range(0, len(r), 65536))])
            self.found.append((r, np.sign(raw) * np.floor(np.abs(raw) * self.scale + 0.5) / self.scale, ids[c]))
            self.waiting += len(r)
            if self.waiting > WAITING:
                self.settle()
        if self.waiting > self.most or np.isneginf(self.best[:, -1]).any():
            self.settle()

    def _exact(self, r: np.ndarray, v: np.ndarray, length: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((self.v[r] / self.length[r, None]) * (v[c] / length[c, None])).sum(axis=1)

    def settle(self) -> None:
        """Rank what was found; the sort is stable, so of equal scores the smaller ids come first."""
        if not self.found:
            return
        r, s, i = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found, self.waiting = [], 0
        order = np.argsort(r, kind="stable")
        r, s, i = r[order], s[order], i[order]
        touched, start, n = np.unique(r, return_index=True, return_counts=True)
        for at in range(0, len(touched), 8192):
            rows, counts = touched[at : at + 8192], n[at : at + 8192]
            part = slice(start[at], start[at] + counts.sum())
            row = np.concatenate([np.repeat(np.arange(len(rows)), self.k), np.repeat(np.arange(len(rows)), counts)])
            score, of = (np.concatenate([old[rows].ravel(), new[part]]) for old, new in ((self.best, s), (self.of, i)))
            order = np.lexsort((-score, row))
            kept = order[(np.cumsum(counts + self.k) - counts - self.k)[:, None] + np.arange(self.k)]
            self.best[rows], self.of[rows] = score[kept], of[kept]
        worth = self.best[:, -1] + 0.5 / self.scale - self.error - 1e-7
        self.least = np.maximum(np.nextafter(worth.astype(np.float32), np.float32(-np.inf)), np.finfo(np.float32).min)

    def lists(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for at in range(0, len(self.ids), 4096):
            best, of = self.best[at : at + 4096], self.of[at : at + 4096]
            r, c = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[at + r], of[r, c], best[r, c])], ["source_id", "similar_id", "score"])


def _best_products(k: int, digits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows as ``in_rectangle`` deals them, the k best others of each source; a cell's sources are held, its others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple[int, ...] | None = None
        sources: list[tuple[np.ndarray, np.ndarray]] = []
        nearest: _Nearest | None = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], 1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for at, to in zip(edges, edges[1:]):
                if cell != (now := tuple(keys[at, :3].tolist())):
                    if nearest:
                        yield from nearest.lists()
                    cell, sources, nearest = now, [], None
                part = b.slice(at, to - at)
                rows = part.column(4).to_numpy(), part.column(5).flatten().to_numpy().reshape(to - at, -1)
                if keys[at, 3] == 0:
                    sources.append(rows)
                elif sources or nearest:
                    nearest = nearest or _Nearest(*(np.concatenate(x) for x in zip(*sources, strict=True)), k, digits)
                    sources = []
                    nearest.meet(*rows)
        if nearest:
            yield from nearest.lists()

    return run


NEIGHBOURS = "source_id long, similar_id long, score double"


def _directed(vectors: DataFrame) -> DataFrame:
    """(id, v) of vectors that have an id and a finite length over zero, as they are."""
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.where("vec_id is not null").where((length > 0) & (length < float("inf"))).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))


def _grid(own: int, others: int, wide: int, k: int, cores: int) -> tuple[int, int]:
    """Blocks of sources and of others: each core gets two cells where the tables are that large, a cell's sources fit their task, and few copies are made.

    A source goes to as many cells as there are blocks of others and comes back
    from each with k rows, of some 18 bytes in the exchange.
    """
    least = -(-own // max(1, HELD_VALUES // max(wide, k, 1)))
    cells = max(1, min(2 * cores, -(-own // BLOCK) * -(-others // BLOCK)))
    across = max(1, min(-(-others // BLOCK), int((cells * others * 4 * wide / (max(own, 1) * (4 * wide + 18 * k) or 1)) ** 0.5)))
    down = max(1, least, min(-(-own // BLOCK), -(-cells // across)))
    return down, max(1, min(-(-others // BLOCK), round(cells / down)))


def _near(own: DataFrame, others: DataFrame, k: int, digits: int, sizes: tuple[int, int, int]) -> DataFrame:
    """(source_id, similar_id, score): the k best others of each source in each cell; sizes: rows of both, and the most values of a vector."""
    grid = _grid(*sizes, k, own.sparkSession.sparkContext.defaultParallelism)
    return in_rectangle(own, others, F.size("v"), grid, _best_products(k, digits), NEIGHBOURS)


def _measured(vectors: DataFrame) -> tuple[int, int]:
    """Rows, and the most values of a vector."""
    n, wide = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()  # one row
    return n, max(wide or 0, 1)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "similar_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def neighbour_cache(vectors: DataFrame, k: int = 50, rows: int | None = None, sources: DataFrame | None = None, digits: int = 5) -> DataFrame:
    """(source_id, similar_id, score, rank) of each vector's k nearest by cosine, ties to the smaller id (OP-022, OP-106, OP-175).

    A task holds a block of sources and their k best so far, and all others
    pass by, so that a vector is sent once for each block of sources (of 65,536
    with 64 values), and a list comes back once.  Vectors that are null, of
    length zero or not finite have no neighbours; different dimensions do not
    meet.
    sources: (item_id) whose neighbours alone are wanted; only their rows are
    then compared with all.
    """
    every = _directed(vectors)
    n, wide = _measured(vectors)
    own = every if sources is None else every.join(sources.select(F.col("item_id").alias("id")), "id", "left_semi")
    n = n if rows is None else rows
    return _ranked(_near(own, every, k, digits, (n if sources is None else own.count(), n, wide)), k)


def neighbours_maintained(cache: DataFrame, vectors: DataFrame, changed: DataFrame, k: int = 50, digits: int = 5) -> DataFrame:
    """The neighbour cache after the vectors of some items (item_id) came, changed or went, equal to one made anew (OP-022, OP-175, OP-268).

    cache: of the same k and digits, before; vectors: all, as they are now.
    Other sources are compared with the changed vectors alone.  What
    a list did not hold lies behind its old k-th place, so a list is whole as
    long as k rows are at that place or before it; lists that are not, and
    those of changed vectors, are made anew against all.
    """
    scratch, columns = Scratch(vectors.sparkSession, "neighbours"), ["source_id", "similar_id", "score"]
    mine = scratch.save(changed.select(F.col("item_id").cast("long").alias("item_id")).where("item_id is not null").distinct(), "changed")
    ids = lambda name: mine.select(F.col("item_id").alias(name))
    every = _directed(vectors)
    fresh, still = every.join(ids("id"), "id", "left_semi"), every.join(ids("id"), "id", "left_anti")
    n, wide = _measured(vectors)
    met = _near(still, fresh, k, digits, (n, mine.count(), wide))
    others = cache.join(ids("source_id"), "source_id", "left_anti")
    last = others.where(F.col("rank") == k).select("source_id", F.col("score").alias("last_score"), F.col("similar_id").alias("last_id"))
    merged = scratch.save(others.join(ids("similar_id"), "similar_id", "left_anti").select(*columns).unionByName(met), "merged")
    before = (F.col("score") > F.col("last_score")) | (F.col("score") == F.col("last_score")) & (F.col("similar_id") <= F.col("last_id"))
    whole = merged.join(last, "source_id").where(before).groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = last.join(whole, "source_id", "left_anti").select(F.col("source_id").alias("item_id"))
    redo = scratch.save(mine.unionByName(short), "redo")
    anew = neighbour_cache(vectors, k, sources=redo, digits=digits)
    others = _ranked(merged.join(redo.select(F.col("item_id").alias("source_id")), "source_id", "left_anti"), k)
    made = scratch.save(others.unionByName(anew), "cache")  # written, so that edits upon edits do not pile up plans
    scratch.drop("changed", "merged", "redo")
    return made


def cached_neighbours(cache: DataFrame, items: DataFrame, item_id: int, k: int, kind: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """(similar_id, filepath, score, rank) of one item from a written cache; what is excluded goes before the cut (OP-021)."""
    rows = cache.where(F.col("source_id") == item_id)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    if exclude is not None:
        rows = rows.join(exclude.select(F.col("item_id").alias("similar_id")), "similar_id", "left_anti")
    shown = rows.join(items.select(F.col("item_id").alias("similar_id"), "filepath"), "similar_id").orderBy("rank").limit(k)
    return shown.select("similar_id", "filepath", "score", F.row_number().over(Window.orderBy("rank")).cast("int").alias("rank"))  # over k rows


def cache_replaced(cache: DataFrame, fresh: DataFrame, sources: DataFrame, k: int = 50) -> DataFrame:
    """The cache in which the rows of some sources (item_id) are those of fresh (source_id, similar_id, score), ranked and cut (OP-022, OP-175)."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "similar_id"))
    ranked = fresh.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)
    return cache.join(sources.select(F.col("item_id").alias("source_id")), "source_id", "left_anti").unionByName(ranked.select(*cache.columns))


def cache_without(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache without some items on either side (OP-175)."""
    return cache.join(gone.select(F.col("item_id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("item_id").alias("similar_id")), "similar_id", "left_anti")


def cache_stats(cache: DataFrame, items: DataFrame) -> DataFrame:
    """(rows, sources, items, coverage, best, worst) of a neighbour cache (OP-098, OP-175)."""
    own = cache.agg(F.count("*").alias("rows"), F.countDistinct("source_id").alias("sources"), F.max("score").alias("best"), F.min("score").alias("worst"))
    return own.join(F.broadcast(items.agg(F.count("*").alias("items"))), F.lit(True)).select("rows", "sources", "items", F.round(F.try_divide(100.0 * F.col("sources"), F.col("items")), 1).alias("coverage"), "best", "worst")  # one row each


def sound_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of the right dimension and without null or infinite parts (OP-010)."""
    return vectors.where((F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def vector_coverage(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """(items, embedded, missing) (OP-011)."""
    held = items.join(vectors.select(F.col("vec_id").alias("item_id")), "item_id", "left_semi").agg(F.count("*").alias("embedded"))
    return items.agg(F.count("*").alias("items")).join(F.broadcast(held), F.lit(True)).select("items", "embedded", F.greatest(F.lit(0).cast("long"), F.col("items") - F.col("embedded")).alias("missing"))  # one row each


def embedded(files: DataFrame, backend: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """(item_id, embedding) of files (item_id, content) by any function from contents to rows of a matrix; rows come out with length one (OP-171).

    The function is sent to the workers and called once per Arrow batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.asarray(backend([bytes(c) for c in b["content"]]), np.float64)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.DataFrame({"item_id": b["item_id"], "embedding": list((v / np.where(size == 0, 1, size)).astype(np.float32))})

    return files.select("item_id", "content").where("content is not null").mapInPandas(run, "item_id long, embedding array<float>")


def hash_queue(items: DataFrame, hashes: DataFrame, failed: DataFrame, unhashable: Sequence[str] = ()) -> DataFrame:
    """(item_id, filepath) of items still to be hashed: without a hash, not failed before, of a kind that can be (OP-167)."""
    todo = items.join(hashes.where("phash is not null and phash <> ''"), "item_id", "left_anti").join(failed, "item_id", "left_anti")
    for extension in unhashable:
        todo = todo.where(~F.endswith(F.lower("filepath"), F.lit("." + extension)))
    return todo.select("item_id", "filepath")


def hashed_again(hashes: DataFrame, fresh: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hashes, pairs) after some items (item_id, phash) were hashed anew: their pairs are no longer known and go (OP-167, OP-168)."""
    kept = hashes.join(fresh, "item_id", "left_anti").unionByName(fresh.select(*hashes.columns))
    ids = fresh.select("item_id")
    return kept, pairs.join(ids.withColumnRenamed("item_id", "a"), "a", "left_anti").join(ids.withColumnRenamed("item_id", "b"), "b", "left_anti").select(*pairs.columns)


def blend(parts: dict[str, DataFrame], weights: dict[str, float], k: int, exclude: DataFrame | None = None) -> DataFrame:
    """Weighted sum of several (item_id, score) tables, a missing score counting 0 (OP-082, OP-174)."""
    total = sum(weights[name] for name in parts)
    rows = reduce(DataFrame.unionByName, (df.select("item_id", (F.col("score") * (weights[name] / total)).alias("score")) for name, df in parts.items()))
    summed = rows.groupBy("item_id").agg(F.sum("score").alias("score"))
    return top(summed if exclude is None else summed.join(exclude, "item_id", "left_anti"), k)


def idf_stats(weights: DataFrame) -> DataFrame:
    """Spread of tag weights (OP-257)."""
    r = lambda c: F.round(c, 5)
    return weights.agg(F.count("*").alias("n"), r(F.min("weight2")).alias("least"), r(F.max("weight2")).alias("most"), r(F.avg("weight2")).alias("mean"), r(F.median("weight2")).alias("median"), r(F.stddev_samp("weight2")).alias("sd"))


def category_impact(weights: DataFrame) -> DataFrame:
    """Tags per category with their mean weights and the most over the least (OP-258)."""
    return weights.groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.round(F.avg("weight2"), 6).alias("mean_weight2"), F.round(F.max("weight2") / F.min("weight2"), 6).alias("ratio"))


def score_buckets(scored: DataFrame, n: int = 10) -> DataFrame:
    """Scores per bucket of equal width in [0, 1], and their share in percent (OP-259)."""
    bucket = F.least(F.floor(F.round(F.col("score"), 6) * n), F.lit(n - 1)).cast("int")
    counts = scored.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))  # over n rows


def sparse_and_dense(item_tags: DataFrame, k: int = 10) -> DataFrame:
    """The items of fewest and of most tags (OP-260)."""
    n = item_tags.groupBy("item_id").agg(F.count("*").alias("n"))
    return n.orderBy("n", "item_id").limit(k).withColumn("end", F.lit("sparse")).unionByName(n.orderBy(F.desc("n"), "item_id").limit(k).withColumn("end", F.lit("dense")))


def pair_sums(c: Catalog, pairs: DataFrame, by_category: bool = False) -> DataFrame:
    """Sums of what the tags of pairs (a, b) share, and of each side, per weight: (a, b, kind, inter, own, other).

    kind names the weight: one, weight, weight2; or, by category, that category
    under the plain weight, so that category weights can be varied afterwards.
    Each side's sums are taken once per item; only shared tags are joined, as
    numbers, and weighed once they are known to be shared.
    """
    scratch, kinds_of = Scratch(c.spark, "pair-sums"), ("one", "weight", "weight2")
    w, seen = scratch.save_counted(catalog_weights(c).select("tag", "category", F.lit(1.0).alias("one"), "weight", "weight2").withColumn("code", F.monotonically_increasing_id()), "weights")
    ids = pairs.select(F.col("a").alias("item_id")).unionByName(pairs.select(F.col("b").alias("item_id"))).distinct()
    coded = c.item_tags.join(small(w.select("tag", "category", "code"), seen["n"]), ["tag", "category"]).select("item_id", "code")
    rows = scratch.save(coded.join(ids, "item_id", "left_semi"), "rows")

    def weighed(shared: DataFrame, key: list[str]) -> DataFrame:
        found = shared.join(small(w.drop("tag"), seen["n"]), "code")
        if by_category:
            return found.groupBy(*key, F.col("category").alias("kind")).agg(F.sum("weight").alias("w"))
        sums = found.groupBy(*key).agg(*(F.sum(k).alias(k) for k in kinds_of))
        return sums.select(*key, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("w")) for k in kinds_of))).alias("x")).select(*key, "x.kind", "x.w")

    side = scratch.save(weighed(rows, ["item_id"]), "sides")
    left = pairs.select("a", "b").join(rows.withColumnRenamed("item_id", "a"), "a")
    both = weighed(left.join(rows.withColumnRenamed("item_id", "b"), ["b", "code"]), ["a", "b"]).withColumnRenamed("w", "inter")
    kinds = side.select("kind").distinct()
    grid = pairs.select("a", "b").join(F.broadcast(kinds), F.lit(True))  # a kind is one of a few names
    out = grid.join(side.select(F.col("item_id").alias("a"), "kind", F.col("w").alias("own")), ["a", "kind"], "left").join(side.select(F.col("item_id").alias("b"), "kind", F.col("w").alias("other")), ["b", "kind"], "left").join(both, ["a", "b", "kind"], "left")
    return out.select("a", "b", "kind", *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("inter", "own", "other")))


def method_scores(c: Catalog, pairs: DataFrame) -> DataFrame:
    """(a, b, method, score) of pairs by each of the five methods (OP-150 to OP-158, OP-259)."""
    sums = pair_sums(c, pairs)
    kind = {"jaccard": "one", "weighted": "weight", "weighted_tfidf": "weight2", "asymmetric": "weight", "asymmetric_tfidf": "weight2"}
    each = F.array(*(F.struct(F.lit(m).alias("method"), score(m, F.col("inter"), F.col("own"), F.col("other")).alias("score"), F.lit(kind[m]).alias("needs")) for m in METHODS))
    return sums.select("a", "b", "kind", F.explode(each).alias("m")).where("kind = m.needs").select("a", "b", "m.method", "m.score")


def method_distribution(scored: DataFrame, n: int = 10) -> DataFrame:
    """(method, bucket, n, percent): scores per bucket of equal width for each method (OP-259)."""
    bucket = F.least(F.floor(F.round("score", 6) * n), F.lit(n - 1)).cast("int")
    counts = scored.groupBy("method", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("method")), 2))


def method_spread(scored: DataFrame) -> DataFrame:
    """(method, least, most, mean, sd) of scores (OP-259)."""
    r = lambda c: F.round(c, 5)
    return scored.groupBy("method").agg(r(F.min("score")).alias("least"), r(F.max("score")).alias("most"), r(F.avg("score")).alias("mean"), r(F.stddev_samp("score")).alias("sd"))


def tuning_pairs(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, cosine): each vector's k nearest of positive cosine, what tag weights are tuned to (OP-261, OP-286)."""
    pairs = neighbour_cache(vectors, k).where("score > 0").select(F.col("source_id").alias("a"), F.col("similar_id").alias("b"), F.col("score").alias("cosine"))
    return Scratch(vectors.sparkSession, "tuning-pairs").save(pairs, "pairs")  # written, since pairs are read several times


def tuning_grid(c: Catalog, pairs: DataFrame, alphas: Sequence[float], multipliers: dict[str, Sequence[float]]) -> DataFrame:
    """(category, multiplier, alpha, r, n): correlation of the asymmetric tag score with the cosine of pairs, for each alpha and each category's weight times each multiplier (OP-261).

    A pair's sums per category are taken once; all settings are sums of those.
    """
    sums = pair_sums(c, pairs, by_category=True).join(pairs, ["a", "b"])
    settings = [(k, float(m), float(a)) for k, ms in multipliers.items() for m in ms for a in alphas]
    grid = F.explode(F.array(*(F.struct(F.lit(k).alias("category"), F.lit(m).alias("multiplier"), F.lit(a).alias("alpha")) for k, m, a in settings)))
    times = F.when(F.col("kind") == F.col("g.category"), F.col("g.multiplier")).otherwise(F.lit(1.0))
    per = sums.withColumn("g", grid).groupBy("a", "b", "cosine", "g").agg(*(F.sum(F.col(x) * times).alias(x) for x in ("inter", "own", "other"))).where("own > 0 and other > 0")
    cover, plain = F.col("inter") / F.col("own"), F.col("inter") / (F.col("own") + F.col("other") - F.col("inter"))
    scored = per.select("g", "cosine", (F.col("g.alpha") * cover + (1 - F.col("g.alpha")) * plain).alias("s"))
    return scored.groupBy("g").agg(F.round(F.corr("cosine", "s"), 5).alias("r"), F.count("*").alias("n")).select("g.category", "g.multiplier", "g.alpha", "r", "n")


def weight_tuning(c: Catalog, item_id: int, alphas: list[float]) -> DataFrame:
    """Correlation of the asymmetric score with the plain weighted one, for each alpha (OP-261)."""
    base = similar_by_tags(c, item_id, "weighted").withColumnRenamed("score", "plain")
    other = similar_by_tags(c, item_id, "asymmetric").withColumnRenamed("score", "asym")
    both = base.join(other, "item_id").withColumn("cover", (F.col("asym") - (1 - ALPHA) * F.col("plain")) / ALPHA)
    grid = both.select("plain", "cover", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    mixed = F.col("alpha") * F.col("cover") + (1 - F.col("alpha")) * F.col("plain")
    return grid.groupBy("alpha").agg(F.round(F.corr("plain", mixed), 5).alias("r"), F.count("*").alias("n"))
