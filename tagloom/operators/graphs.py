"""Closures, cycles and components of edge lists (a, b), as loops of joins whose rounds are written tables.

No loop has a limit of rounds: each ends when nothing new is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

def reach(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(a, b, depth) for all b that a leads to, depth the least number of steps; cycles end, and no pair is (a, a) (OP-083, OP-115).

    Rounds double the known length: a path of h + 1 to 2 h steps is one of
    exactly h steps and a known one after it, so a chain of n takes log n rounds.
    max_depth: longer paths are not wanted.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    step = edges.where("a <> b").select("a", "b").distinct().withColumn("depth", F.lit(1))
    reached, seen = scratch.save_counted(step, "depth-1")
    longest, half = reached, 1
    while seen["n"] and (max_depth is None or half < max_depth):
        ahead = longest.select("a", F.col("b").alias("via"))
        known = reached.select(F.col("a").alias("via"), "b", (F.col("depth") + half).alias("depth"))
        found = ahead.join(known, "via").where("a <> b").groupBy("a", "b").agg(F.min("depth").alias("depth"))
        fresh = scratch.save(found.join(reached, ["a", "b"], "left_anti"), f"depth-{2 * half}")
        half *= 2
        longest, seen = scratch.save_counted(fresh.where(F.col("depth") == half), f"longest-{half}")
        reached = reached.unionByName(fresh)
    return reached if max_depth is None else reached.where(F.col("depth") <= max_depth)


def reached_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) for all nodes that the seeds (seed) lead to, each seed's own rows only; a seed is not among its nodes but by a cycle.

    A round is one step; what is known is one scan, whatever the number of rounds.
    """
    scratch = Scratch(edges.sparkSession, "seeded")
    step = scratch.save(edges.select("a", "b").distinct(), "edges")
    frontier = scratch.save(seeds.select("seed", F.col("seed").alias("node")).distinct(), "seeds")
    names: list[str] = []
    while True:
        found = frontier.join(step, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        fresh = found.join(scratch.together(*names), ["seed", "node"], "left_anti") if names else found
        names.append(f"step-{len(names)}")
        frontier, seen = scratch.save_counted(fresh, names[-1])
        if not seen["n"]:
            return scratch.together(*names)


def _followed(pointers: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, to, odd) with each pointer followed to its end, by doubling; odd: whether the way has an odd number of steps.

    Pointers that run in a circle have no end: they keep a ``to`` that is a node.
    """
    out, seen = scratch.save_counted(pointers.select("node", "to", F.lit(True).alias("odd")), f"{name}-0")
    steps, many = 1, seen["n"]
    while many and steps < 2 * many:
        ahead = out.select(F.col("node").alias("via"), F.col("to").alias("far"), F.col("odd").alias("more"))
        after = out.join(ahead, F.col("to") == F.col("via"), "left").select("node", F.coalesce("far", "to").alias("to"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd"), F.col("far").isNotNull().alias("moved"))
        after, seen = scratch.save_counted(after, f"{name}-{2 * steps}", moved=F.count_if(F.col("moved")))
        scratch.drop(f"{name}-{steps}")
        out, steps = after.drop("moved"), 2 * steps
        if not seen["moved"]:
            break
    return out


def contracted(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(a, b): a smaller graph in which the nodes of ``ends`` (node) lead to each other just as they do in ``edges``.

    Rake and compress: other nodes with one way on, or one way in, are passed
    over, whole chains at a time by doubling; others without a way on or in go.
    Both are repeated while the graph shrinks, so chains and trees of any length
    take a number of rounds that grows with the logarithm of their size.
    """
    scratch = Scratch(edges.sparkSession, "contracted")
    held = scratch.save(ends.select("node").distinct(), "ends")
    graph, seen = scratch.save_counted(edges.where("a <> b").select("a", "b").distinct(), "graph-0")
    k, before = 0, None
    while seen["n"] and seen["n"] != before:
        before = seen["n"]
        for way in ("on", "in"):
            a, b = ("a", "b") if way == "on" else ("b", "a")
            only = graph.groupBy(F.col(a).alias("node")).agg(F.count("*").alias("n"), F.min(b).alias("to")).where("n = 1").join(held, "node", "left_anti")
            jumps = scratch.save(_followed(only, scratch, f"{way}-{k}"), f"{way}-{k}-ends")
            # a node that its way leads to in a circle has no end that was asked for
            lost = jumps.join(jumps.select(F.col("node").alias("to")), "to", "left_semi").select(F.col("node").alias("gone"))
            rest = graph.join(jumps.select(F.col("node").alias(a)), a, "left_anti").join(lost, F.col(b) == F.col("gone"), "left_anti")
            moved = rest.join(jumps.select("node", "to"), F.col(b) == F.col("node"), "left").select(F.col(a), F.coalesce("to", b).alias(b)).where("a <> b").distinct()
            k += 1
            graph = scratch.save(moved.select("a", "b"), f"graph-{k}")
        onward = graph.join(held.select(F.col("node").alias("b")).union(graph.select(F.col("a").alias("b"))), "b", "left_semi")
        raked = onward.join(held.select(F.col("node").alias("a")).union(graph.select(F.col("b").alias("a"))), "a", "left_semi")
        k += 1
        graph, seen = scratch.save_counted(raked.select("a", "b"), f"graph-{k}")
        scratch.drop(*(f"graph-{j}" for j in range(k - 3, k)))
    return graph


def would_close(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """(a, b, cycle) of proposed edges: whether b already leads to a, or is a (OP-208, OP-218).

    The graph is first made small around the proposals' ends; then what these
    lead to is followed step by step.
    """
    asked = proposals.select("a", "b").distinct()
    small = contracted(edges, asked.select(F.col("a").alias("node")).union(asked.select("b")))
    ahead = reached_from(small, asked.select(F.col("b").alias("seed"))).select(F.col("seed").alias("b"), F.col("node").alias("a"), F.lit(True).alias("back"))
    return asked.join(ahead, ["a", "b"], "left").select("a", "b", ((F.col("a") == F.col("b")) | F.coalesce("back", F.lit(False))).alias("cycle"))


def connected(edges: DataFrame) -> DataFrame:
    """(item_id, group_id) of linked items; group_id is the least id reachable (OP-166).

    Least labels spread along edges and then jump to their label's label, so the
    number of rounds grows with the logarithm of a chain's length.
    """
    scratch = Scratch(edges.sparkSession, "connected")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.save(both, "both")
    labels = scratch.save(both.groupBy(F.col("a").alias("item_id")).agg(F.least(F.min("b"), F.min("a")).alias("g")), "labels-0")
    k = 0
    while True:
        near = both.join(labels, F.col("b") == F.col("item_id")).groupBy("a").agg(F.min("g").alias("m"))
        spread = labels.join(near, F.col("item_id") == F.col("a")).select("item_id", F.least("g", "m").alias("g2"), "g")
        up = spread.select(F.col("item_id").alias("k"), F.col("g2").alias("up"))
        after = spread.join(up, F.col("g2") == F.col("k")).select("item_id", F.least("g2", "up").alias("g"), F.col("g").alias("was"))
        k += 1
        after, seen = scratch.save_counted(after, f"labels-{k}", moved=F.count_if(F.col("g") != F.col("was")))
        scratch.drop(f"labels-{k - 1}")
        labels = after.select("item_id", "g")
        if not seen["n"] or not seen["moved"]:
            return labels.select("item_id", F.col("g").alias("group_id"))


def star_groups(pairs: DataFrame) -> DataFrame:
    """Greedy groups in id order: each free item takes its free partners (OP-166, other form).

    An item is a head if no smaller partner is one; others join their least such
    partner.  An item whose smaller partners but one are known to be no heads is
    the opposite of that one, so it points there, and such pointers are followed
    to their end by doubling: a chain is settled in one round.
    """
    scratch = Scratch(pairs.sparkSession, "stars")
    ordered = pairs.where("a <> b").select(F.least("a", "b").alias("small"), F.greatest("a", "b").alias("large")).distinct()
    links = scratch.save(ordered, "links")
    nodes = links.select(F.col("small").alias("item_id")).union(links.select("large")).distinct()
    state, seen = scratch.save_counted(nodes.withColumn("head", F.lit(None).cast("boolean")), "state-0")
    k, open_ = 0, seen["n"]
    while open_:
        mine = links.join(state, F.col("small") == F.col("item_id")).groupBy("large").agg(
            F.bool_or("head").alias("taken"), F.count_if(F.col("head").isNull()).alias("unknown"), F.min(F.when(F.col("head").isNull(), F.col("small"))).alias("to")
        )
        seen_of = state.join(mine, F.col("item_id") == F.col("large"), "left")
        taken, unknown = F.coalesce("taken", F.lit(False)), F.coalesce("unknown", F.lit(0))
        settled = F.coalesce("head", F.when(taken, F.lit(False)).when(unknown == 0, F.lit(True)))
        now = scratch.save(seen_of.select("item_id", settled.alias("head"), F.when(settled.isNull() & (unknown == 1), F.col("to")).alias("to")), f"seen-{k}")
        ends = _followed(now.where("to is not null").select(F.col("item_id").alias("node"), "to"), scratch, f"pointers-{k}")
        known = ends.join(now.where("head is not null").select(F.col("item_id").alias("to"), F.col("head").alias("theirs")), "to").select("node", (F.col("theirs") != F.col("odd")).alias("found"))
        k += 1
        after = now.join(known, F.col("item_id") == F.col("node"), "left").select("item_id", F.coalesce("head", "found").alias("head"))
        state, seen = scratch.save_counted(after, f"state-{k}", unknown=F.count_if(F.col("head").isNull()))
        scratch.drop(f"state-{k - 1}", f"seen-{k - 1}")
        open_ = seen["unknown"]
    heads = state.where("head").select("item_id")
    taken = links.join(heads, F.col("small") == F.col("item_id")).groupBy("large").agg(F.min("small").alias("taker"))
    members = state.where("not head").join(taken, F.col("item_id") == F.col("large")).select(F.col("taker").alias("group_id"), "item_id")
    return heads.select(F.col("item_id").alias("group_id"), "item_id").unionByName(members)
