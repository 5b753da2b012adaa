"""The item graph: families, siblings, descendants and checks (OP-173, OP-214 to OP-222)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.graphs import reach, would_close


def normalised(edges: DataFrame) -> DataFrame:
    """Edges (a, b, kind, source) with a < b, but for parent_child, which keeps its direction (OP-214)."""
    directed = F.col("kind") == "parent_child"
    return edges.select(F.when(directed, F.col("a")).otherwise(F.least("a", "b")).alias("a"), F.when(directed, F.col("b")).otherwise(F.greatest("a", "b")).alias("b"), "kind", "source")


def add_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing edges and those new ones that are not among them, self-links left out (OP-215)."""
    fresh = normalised(new).where("a <> b").dropDuplicates(["a", "b", "kind"]).join(existing, ["a", "b", "kind"], "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def backfill(items: DataFrame) -> DataFrame:
    """parent_child edges from parent_id to post_id, self-links and unknown parents left out (OP-220, OP-221)."""
    parents = items.select(F.col("post_id").alias("parent_id"), F.col("item_id").alias("a"))
    return items.where("parent_id is not null").select("parent_id", F.col("item_id").alias("b")).join(parents, "parent_id").where("a <> b").select("a", "b", F.lit("parent_child").alias("kind"), F.lit("backfill").alias("source"))


def siblings(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, with one parent (OP-221).

    The result is all pairs of a parent's children, so it grows with the square
    of their number; a parent of very many is kept as parent_child edges, from
    which ``family`` reads siblings without this table.
    """
    child = edges.where("kind = 'parent_child'").select(F.col("a").alias("parent"), F.col("b").alias("item"))
    x, y = child.alias("x"), child.alias("y")
    return x.join(y, (F.col("x.parent") == F.col("y.parent")) & (F.col("x.item") < F.col("y.item"))).select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).distinct()


def family(items: DataFrame, edges: DataFrame, item_id: int) -> DataFrame:
    """An item's relatives: linked ones, children, parent and siblings (OP-173)."""
    linked = edges.where(F.col("a") == item_id).select(F.col("b").alias("item_id")).union(edges.where(F.col("b") == item_id).select("a"))
    own = items.where(F.col("item_id") == item_id).select(F.col("post_id").alias("own_post"), F.col("parent_id").alias("own_parent"))  # one row
    # three equi-joins with one row rather than one with alternatives
    by_post = [items.join(F.broadcast(own), on, "left_semi").select("item_id") for on in (F.col("parent_id") == F.col("own_post"), F.col("post_id") == F.col("own_parent"), F.col("parent_id") == F.col("own_parent"))]
    return linked.union(by_post[0]).union(by_post[1]).union(by_post[2]).where(F.col("item_id") != item_id).distinct()


def descendants(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ancestor, descendant, depth) over parent_child edges, least depth, over chains of any length (OP-083, OP-218)."""
    return reach(edges.where("kind = 'parent_child'"), max_depth).select(F.col("a").alias("ancestor"), F.col("b").alias("descendant"), "depth")


def cycle_checks(edges: DataFrame, proposals: DataFrame) -> DataFrame:
    """(a, b, cycle): whether making a the parent of b closes a cycle, however long (OP-218)."""
    return would_close(edges.where("kind = 'parent_child'"), proposals)


def would_cycle(edges: DataFrame, parent: int, child: int) -> bool:
    """Whether making one item the parent of another closes a cycle (OP-218)."""
    asked = edges.sparkSession.createDataFrame([(parent, child)], "a long, b long")
    return cycle_checks(edges, asked).first()["cycle"]


def add_counted(existing: DataFrame, new: DataFrame) -> DataFrame:
    """(success, skipped) of adding edges in bulk (OP-215)."""
    asked = normalised(new).select("a", "b", "kind")
    fresh = asked.where("a <> b").distinct().join(existing, ["a", "b", "kind"], "left_anti")
    return asked.agg(F.count("*").alias("asked")).join(F.broadcast(fresh.agg(F.count("*").alias("success"))), F.lit(True)).select("success", (F.col("asked") - F.col("success")).alias("skipped"))  # one row each


def manual_checks(edges: DataFrame, items: DataFrame, proposals: DataFrame) -> DataFrame:
    """(a, b, problem): why a hand-made parent a of b is refused, null where it is not (OP-218, OP-219)."""
    known = items.select("item_id")
    own = edges.where("kind = 'parent_child'").select("a", "b")
    asked = cycle_checks(edges, proposals)
    there = lambda c: asked.select(c).distinct().join(known, F.col(c) == F.col("item_id"), "left_semi").withColumn(f"has_{c}", F.lit(True))
    same, mutual = own.withColumn("same", F.lit(True)).distinct(), own.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("mutual")).distinct()
    rows = asked.join(there("a"), "a", "left").join(there("b"), "b", "left").join(same, ["a", "b"], "left").join(mutual, ["a", "b"], "left")
    problem = F.when(F.col("a") == F.col("b"), "self").when(F.col("has_a").isNull() | F.col("has_b").isNull(), "unknown item").when(F.col("same"), "exists").when(F.col("mutual"), "mutual").when(F.col("cycle"), "cycle")
    return rows.select("a", "b", problem.alias("problem"))


def _from_view(view: DataFrame) -> DataFrame:
    """Edges from (item_id, other, role): what the other is to the item."""
    other, own = F.col("other"), F.col("item_id")
    a = F.when(F.col("role") == "parent", other).when(F.col("role") == "child", own).otherwise(F.least(other, own))
    b = F.when(F.col("role") == "parent", own).when(F.col("role") == "child", other).otherwise(F.greatest(other, own))
    return view.where(F.col("role").isin("parent", "child", "sibling")).select(a.alias("a"), b.alias("b"), F.when(F.col("role") == "sibling", "sibling").otherwise("parent_child").alias("kind"), F.lit("manual").alias("source"))


def create_manual(edges: DataFrame, items: DataFrame, view: DataFrame) -> DataFrame:
    """The edges with hand-made ones added that pass all checks; view: (item_id, other, role) (OP-219).

    Each is checked against the edges as they are, not against the others of
    one call: two that close a cycle only together are the caller's to part.
    """
    new = _from_view(view).where("a <> b")
    known = items.select("item_id")
    new = new.join(known, new.a == known.item_id, "left_semi").join(known, F.col("b") == known.item_id, "left_semi")
    bad = manual_checks(edges, items, new.where("kind = 'parent_child'").select("a", "b")).where("problem is not null").select("a", "b", F.lit("parent_child").alias("kind"))
    return add_edges(edges, new.join(bad, ["a", "b", "kind"], "left_anti"))


def delete_edges(edges: DataFrame, pairs: DataFrame, kind: str | None = None) -> DataFrame:
    """The edges without those between some pairs (a, b), in either order, of a kind or of any (OP-219)."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if kind is None:
        return edges.join(both, ["a", "b"], "left_anti")
    return edges.join(both.withColumn("kind", F.lit(kind)), ["a", "b", "kind"], "left_anti")


def update_manual(edges: DataFrame, items: DataFrame, old: DataFrame, view: DataFrame) -> DataFrame:
    """Old edges (a, b, kind) replaced by hand-made ones, checked against the rest; where the new one is refused the old stays out too (OP-219)."""
    return create_manual(edges.join(old, ["a", "b", "kind"], "left_anti"), items, view)


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between the two items of some pairs (a, b), in either order (OP-219, OP-282)."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return edges.join(both, ["a", "b"], "left_semi")


def latest_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The newest edge (made_at) between the two items of each pair (a, b), in either order; of equal times the first by kind, source and a (OP-219)."""
    asked = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    rows = edges.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(asked, ["lo", "hi"], "left_semi")
    # a least struct is a partial aggregate, so a pair of very many edges is no hot key
    order = F.struct((-F.unix_micros("made_at")).alias("age"), "kind", "source", "a", "b", "made_at")
    return rows.groupBy("lo", "hi").agg(F.min(order).alias("e")).select("e.a", "e.b", "e.kind", "e.source", "e.made_at")


def link_arrivals(edges: DataFrame, items: DataFrame, arrived: DataFrame) -> DataFrame:
    """Edges that new items (item_id) bring: to their parent, to their parent's other children, to their own children (OP-220)."""
    new = items.join(arrived, "item_id", "left_semi").select("item_id", "post_id", "parent_id")
    parents = items.select(F.col("post_id").alias("parent_id"), F.col("item_id").alias("a"))
    up = new.join(parents, "parent_id").where("a <> item_id").select("a", F.col("item_id").alias("b"))
    down = items.select(F.col("item_id").alias("b"), F.col("parent_id").alias("post_id")).join(new.select("post_id", F.col("item_id").alias("a")), "post_id").where("a <> b").select("a", "b")
    kin = up.alias("n").join(edges.where("kind = 'parent_child'").alias("o"), F.col("n.a") == F.col("o.a")).select(F.col("n.b").alias("a"), F.col("o.b").alias("b"))
    made = [df.select("a", "b", F.lit(kind).alias("kind"), F.lit("ingested").alias("source")) for df, kind in ((up, "parent_child"), (down, "parent_child"), (kin, "sibling"))]
    fresh = normalised(made[0].unionByName(made[1]).unionByName(made[2])).where("a <> b").dropDuplicates(["a", "b", "kind"])
    return fresh.join(edges, ["a", "b", "kind"], "left_anti")


def backfill_inputs(items: DataFrame) -> DataFrame:
    """(resolved, unresolved, self_links) of items that name a parent; a post id that two items have counts once (OP-285)."""
    posts = items.groupBy(F.col("post_id").alias("parent_id")).agg(F.max("item_id").alias("a"))
    rows = items.where("parent_id is not null").select("parent_id", "item_id").join(posts, "parent_id", "left")
    return rows.agg(F.count_if(F.expr("a <> item_id")).alias("resolved"), F.count_if(F.expr("a is null")).alias("unresolved"), F.count_if(F.expr("a = item_id")).alias("self_links"))


def without_automatic(edges: DataFrame) -> DataFrame:
    """Edges made by hand or in review (OP-285)."""
    return edges.where(~F.col("source").isin("backfill", "ingested"))


def perspective(edges: DataFrame, item_id: int) -> DataFrame:
    """(other, role): each related item and what it is to this one (OP-217)."""
    mine = edges.where((F.col("a") == item_id) | (F.col("b") == item_id))
    other = F.when(F.col("a") == item_id, F.col("b")).otherwise(F.col("a"))
    role = F.when(F.col("kind") != "parent_child", F.col("kind")).when(F.col("a") == item_id, "child").otherwise("parent")
    return mine.select(other.alias("other"), role.alias("role"))


def reviewed(edges: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, with any relation (OP-216)."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def summary(edges: DataFrame) -> DataFrame:
    """Edges per kind and source (OP-222)."""
    return edges.groupBy("kind", "source").agg(F.count("*").alias("n"))
