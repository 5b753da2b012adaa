"""What a page of one item shows, over any set of items (OP-003, OP-004, OP-007, OP-085, OP-213, OP-269, OP-282, OP-284)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.deltas import diff
from tagloom.operators.dml import replace_children

#: The tagger whose tags need no predictions merged into them.
LOCAL_TAGGER = "local_tagger"


def details(items: DataFrame, item_tags: DataFrame, raw: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(item_id, filepath, all_tags, active_source, sources) of items; an item without an active source shows its first by priority, else by name (OP-003).

    Tags and metadata may be absent; malformed metadata counts as none.
    """
    tags = item_tags.join(items.select("item_id"), "item_id", "left_semi").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("all_tags"))
    names = F.array_sort(F.map_keys(F.from_json(F.get_json_object("data", "$.sources"), "map<string,string>")))
    known = raw.select("item_id", names.alias("names"))
    first = F.coalesce(*(F.when(F.array_contains("names", s), F.lit(s)) for s in priority), F.get("names", F.lit(0)))
    rows = items.join(tags, "item_id", "left").join(known, "item_id", "left")
    return rows.select("item_id", "filepath", F.coalesce("all_tags", F.lit("")).alias("all_tags"), F.coalesce("active_source", first).alias("active_source"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("sources"))


def merged_general(items: DataFrame, item_tags: DataFrame, predictions: DataFrame, least: float = 0.7) -> DataFrame:
    """(item_id, tag) of confident general predictions that an item lacks, but for items of the local tagger (OP-004)."""
    asked = items.where(~F.col("active_source").eqNullSafe(LOCAL_TAGGER)).select("item_id")
    sure = predictions.where((F.col("category") == "general") & (F.col("confidence") >= least)).join(asked, "item_id", "left_semi").select("item_id", "tag").distinct()
    return sure.join(item_tags.where("category = 'general'"), ["item_id", "tag"], "left_anti")


def related(items: DataFrame, cross: DataFrame) -> DataFrame:
    """(item_id, other, role): parents by post id, else by the cross-source map (post_id, md5), and children likewise (OP-085).

    items: (item_id, md5, post_id, parent_id).
    """
    child = items.where("parent_id is not null").select(F.col("item_id").alias("child"), F.col("parent_id").alias("wanted"))
    direct = child.join(items.select(F.col("post_id").alias("wanted"), F.col("item_id").alias("parent")), "wanted")
    unresolved = child.join(direct.select("child").distinct(), "child", "left_anti")
    mapped = unresolved.join(cross.select(F.col("post_id").alias("wanted"), "md5"), "wanted").join(items.select("md5", F.col("item_id").alias("parent")), "md5")
    pairs = direct.select("child", "parent").unionByName(mapped.select("child", "parent")).where("child <> parent").distinct()
    return pairs.select(F.col("child").alias("item_id"), F.col("parent").alias("other"), F.lit("parent").alias("role")).unionByName(pairs.select(F.col("parent").alias("item_id"), F.col("child").alias("other"), F.lit("child").alias("role")))


def implied_tags(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """(item_id, tag, category, extended_category) of tags that rules have added (OP-213)."""
    return facts.where("source = 'implication'").select("item_id", "tag", "category").join(tags.select("tag", "category", "extended_category"), ["tag", "category"], "left").select("item_id", "tag", "category", "extended_category")


def favourite_paths(items: DataFrame, favourites: DataFrame) -> DataFrame:
    """(item_id, filepath) of favourites (OP-269)."""
    return items.join(favourites, "item_id", "left_semi").select("item_id", "filepath")


def refreshed(rows: DataFrame, fresh: DataFrame, changed: DataFrame, key: str = "item_id") -> DataFrame:
    """A cached table after some keys (key) changed: their old rows go, and those that still have rows in ``fresh`` get them; rows of other keys in ``fresh`` are not looked at (OP-007)."""
    mine = changed.select(key).distinct()
    return rows.join(mine, key, "left_anti").unionByName(fresh.select(*rows.columns).join(mine, key, "left_semi"))


def edit_tags(item_tags: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag table, changes): the items of ``new`` hold just its tags; changes is what that adds and removes (OP-284)."""
    mine = item_tags.join(new.select("item_id").distinct(), "item_id", "left_semi")
    return replace_children(item_tags.select("item_id", "tag", "category"), new, "item_id"), diff(mine, new)
