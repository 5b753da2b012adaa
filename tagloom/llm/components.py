"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a partial aggregate and an equi-join, so a node with very many
neighbours is pre-aggregated before the shuffle and its join is open to the
adaptive skew split; no neighbour list is ever gathered.  After each round the
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch


def checksum() -> dict[str, Column]:
    """With the number of rows, what tells two edge lists apart; exclusive or cannot overflow, however many edges there are."""
    return {"x": F.bit_xor(F.xxhash64("u", "v")), "y": F.bit_xor(F.xxhash64("v", F.lit(1), "u"))}


def _to_least(edges: DataFrame, larger_only: bool, scratch: Scratch, name: str) -> DataFrame:
    """Each node's least neighbour (or itself), and each chosen neighbour linked to it.

    The least ones are a written table: a join with an aggregate beneath it would
    not be split where one node has very many neighbours.
    """
    least = scratch.save(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    both = edges.join(least, "u")
    if larger_only:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v; longs); root is the least node reachable.

    Nodes without an edge are absent.  An empty edge list gives an empty result.
    """
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both, True, scratch, f"{name}-least").where("u <> v").distinct()
        large = scratch.save(large, f"{name}-large")
        small = _to_least(large, False, scratch, f"{name}-least-2").where("u <> v").distinct()
        k += 1
        now, seen = scratch.save_counted(small, f"{name}-{k}", **checksum())  # taken while the table is written
        scratch.drop(f"{name}-{k - 1}", f"{name}-least", f"{name}-large", f"{name}-least-2")
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
