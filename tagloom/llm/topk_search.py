"""Exact top-k inner-product search by term-at-a-time accumulation.

Components become integers, floor(256 * x); a dimension is a term.  Queries and
candidates are hashed into blocks of bounded size, and each pair of blocks is a
cell.  Within a cell each non-zero query component scatters its weighted
postings - that dimension's column of the candidate block - into a dense score
array; the best k of each row are selected by partition, and the cells' partial
lists are merged by a second selection.

The work is the exhaustive product itself; what moves is a copy of each row
per block of the other side, and k rows per query and cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

SCALE = 256
K = 5
#: Queries scored at a time, and of a block about.
QUERY_BLOCK = 1024
#: Candidates scored at a time; bounds the dense array to QUERY_BLOCK x this many scores.
CANDIDATE_BLOCK = 2048
#: Query rows whose scores are accumulated at a time.
ROWS = 32


def quantised(rows: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null id, a null vector, or any null, NaN or infinite component go."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    ok = F.col(vector).isNotNull() & F.col(id_column).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(ok).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores (query, candidate), term by term over the queries' non-zero components."""
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(queries.shape[1], 1)
    kind = np.int32 if top < 2**31 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(candidates.T.astype(kind))  # a term's postings lie together
    scores = np.zeros((len(queries), len(candidates)), kind)
    dense_terms = 4 * np.count_nonzero(postings, axis=1) > postings.shape[1]
    for at in range(0, len(queries), ROWS):  # few enough rows that their scores stay in cache over all terms
        rows, out = queries[at : at + ROWS], scores[at : at + ROWS]
        weighed = np.empty_like(out)
        for term in range(queries.shape[1]):
            holders = np.flatnonzero(rows[:, term])
            if not len(holders):
                continue
            if dense_terms[term] and 4 * len(holders) > len(rows):  # nearly all meet: zeros add nothing
                np.multiply(rows[:, term, None], postings[term], out=weighed)
                out += weighed
            else:
                docs = np.flatnonzero(postings[term])
                out[np.ix_(holders, docs)] += rows[holders, term, None] * postings[term, docs]
    return scores


def best_of_each(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One column per id, with the id's best score in each row."""
    unique, inverse = np.unique(ids, return_inverse=True)
    if len(unique) == len(ids):
        return scores, ids
    order = np.argsort(inverse, kind="stable")
    return np.maximum.reduceat(scores[:, order], np.flatnonzero(np.diff(inverse[order], prepend=-1)), axis=1), unique


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best k of each row, ties to the smaller id; a row's own id takes no part.  Ids are unique."""
    order = np.argsort(ids, kind="stable")
    # columns in id order: then the first k of "greater than the k-th, else equal and early" are exact
    scores, sorted_ids = scores[:, order], ids[order]
    mine = own[:, None] == sorted_ids[None, :]
    scores = np.where(mine, np.iinfo(scores.dtype).min, scores)
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        above = scores > kth[:, None]
        equal = scores == kth[:, None]
        equal &= np.cumsum(equal, axis=1) <= (k - above.sum(1))[:, None]
        chosen = (above | equal) & ~mine
    else:
        chosen = ~mine
    rows, columns = np.nonzero(chosen)
    return rows, order[columns]


def _score(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows (dim, qb, cb, kind, id, v): a cell's queries come first and stay, its candidates stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, q_ids, q_rows = None, np.zeros(0, np.int64), np.zeros((0, 0), np.int64)
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], 1)
            heads = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1)))) if len(keys) else []
            for at, to in zip(heads, [*heads[1:], len(keys)], strict=True):
                dim, here = int(keys[at, 0]), tuple(keys[at, :3])
                part = b.slice(at, to - at)
                ids, rows = part.column(4).to_numpy(), part.column(5).flatten().to_numpy().reshape(len(part), dim)
                if keys[at, 3] == 0:
                    if here == cell:
                        q_ids, q_rows = np.concatenate((q_ids, ids)), np.concatenate((q_rows, rows))
                    else:
                        cell, q_ids, q_rows = here, ids, rows
                elif here == cell:
                    for c in range(0, len(ids), CANDIDATE_BLOCK):
                        c_ids = ids[c : c + CANDIDATE_BLOCK]
                        for q in range(0, len(q_ids), QUERY_BLOCK):
                            own = q_ids[q : q + QUERY_BLOCK]
                            # copies of one id take one place, else they would fill all k
                            scores, one_ids = best_of_each(accumulate(q_rows[q : q + QUERY_BLOCK], rows[c : c + CANDIDATE_BLOCK]), c_ids)
                            r, j = select(scores, one_ids, own, k)
                            yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(one_ids[j]), pa.array(scores[r, j].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = 4 * CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product, ties to the smaller id.

    A candidate with the query's own id takes no part.  Unusable vectors (null,
    or with null or non-finite components) and rows with a null id go.  Vectors
    are compared with those of their own length; those of length zero score 0
    with each other.  An empty table gives an empty result.  Rows of one id with different
    vectors each count, a pair by its best score; more columns are ignored.
    """
    scratch = Scratch(queries.sparkSession, "topk")
    q = scratch.save(quantised(queries, id_column, vector, scale), "queries")
    c = scratch.save(quantised(candidates, id_column, vector, scale), "candidates")
    blocks_q, blocks_c = (max(1, -(-rows.count() // size)) for rows, size in ((q, query_block), (c, candidate_block)))

    def dealt(rows: DataFrame, kind: int) -> DataFrame:
        own, n, m = ("qb", blocks_q, blocks_c) if kind == 0 else ("cb", blocks_c, blocks_q)
        other = "cb" if kind == 0 else "qb"
        return rows.select(
            F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.lit(kind).alias("kind"), "id", "v", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)
        ).select("dim", "qb", "cb", "kind", "id", "v")

    cells = dealt(q, 0).unionByName(dealt(c, 1)).repartition("dim", "qb", "cb").sortWithinPartitions("dim", "qb", "cb", "kind")
    found = cells.mapInArrow(_score(k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
