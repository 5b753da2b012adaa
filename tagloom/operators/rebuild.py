"""Tags derived anew from the sources' raw metadata: switching, merging, reverting and full rebuild (OP-228 to OP-231, OP-235, OP-283).

raw: (item_id, data), data the JSON of all sources of an item; malformed JSON
gives nothing, so such items keep what they have.  All are joins and partial
aggregates over whole tables; a single item is a filter on them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.merge import extract_rating, extract_tags, merge_categories, primary_source, rename_ratings

MERGED = "merged"


def source_records(raw: DataFrame) -> DataFrame:
    """(item_id, source, post_id, parent_id, has_children) of each source; a parent may stand among its relationships (OP-283)."""
    each = raw.select("item_id", F.explode(F.from_json(F.get_json_object("data", "$.sources"), "map<string,string>")).alias("source", "d"))
    number = lambda *paths: F.coalesce(*(F.get_json_object("d", p) for p in paths)).try_cast("long")
    flag = F.coalesce(F.coalesce(F.get_json_object("d", "$.has_children"), F.get_json_object("d", "$.relationships.has_children")).try_cast("boolean"), F.lit(False))
    return each.select("item_id", "source", number("$.id").alias("post_id"), number("$.relationships.parent_id", "$.parent_id").alias("parent_id"), flag.alias("has_children"))


def source_rows(raw: DataFrame) -> DataFrame:
    """(item_id, source, tag, category): each source's tags and its rating, which is a meta tag."""
    tags = extract_tags(raw).select("item_id", "source", "tag", "category")
    ratings = extract_rating(raw).select("item_id", "source", F.col("rating").alias("tag"), F.lit("meta").alias("category"))
    return tags.unionByName(ratings).distinct()


def summary_of_sources(raw: DataFrame) -> DataFrame:
    """source_records with each source's rating and its tags in order (OP-283)."""
    tags = extract_tags(raw).groupBy("item_id", "source").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return source_records(raw).join(tags, ["item_id", "source"], "left").join(extract_rating(raw), ["item_id", "source"], "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def _replaced(item_tags: DataFrame, new: DataFrame, items: DataFrame) -> DataFrame:
    """The tag table in which some items' rows are those of ``new``."""
    return item_tags.select("item_id", "tag", "category").join(items.select("item_id"), "item_id", "left_anti").unionByName(new.select("item_id", "tag", "category"))


def switch_source(item_tags: DataFrame, raw: DataFrame, chosen: DataFrame) -> DataFrame:
    """The tag table with the items of chosen (item_id, source) re-derived from that source alone (OP-228).

    Items that lack the source keep their tags.
    """
    known = chosen.join(source_records(raw).select("item_id", "source"), ["item_id", "source"], "left_semi")
    new = source_rows(raw).join(known, ["item_id", "source"], "left_semi")
    return _replaced(item_tags, new, known)


def merged_rows(raw: DataFrame) -> DataFrame:
    """(item_id, tag, category) over all sources of an item, each tag once in its category of highest priority; of several ratings the first by name stays (OP-226)."""
    tags = merge_categories(extract_tags(raw))
    rating = extract_rating(raw).groupBy("item_id").agg(F.min("rating").alias("tag")).select("item_id", "tag", F.lit("meta").alias("category"))
    return tags.where("tag not like 'rating:%'").unionByName(rating)


def several_sources(raw: DataFrame) -> DataFrame:
    """(item_id) of items with more than one source."""
    return source_records(raw).groupBy("item_id").agg(F.countDistinct("source").alias("n")).where("n > 1").select("item_id")


def apply_merged(item_tags: DataFrame, active: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag table, active (item_id, active_source)) after merging every item of several sources that is not merged yet (OP-229)."""
    todo = active.where(~F.col("active_source").eqNullSafe(MERGED)).join(several_sources(raw), "item_id", "left_semi").select("item_id")
    new = merged_rows(raw).join(todo, "item_id", "left_semi")
    return _replaced(item_tags, new, todo), _activated(active, todo.withColumn("source", F.lit(MERGED)))


def revert_merged(item_tags: DataFrame, active: DataFrame, raw: DataFrame, priority: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(tag table, active) after merged items went back to their first source by priority; those without a source of the list stay merged (OP-229)."""
    best = primary_source(source_records(raw).where(F.col("source").isin(*priority)), priority)
    todo = best.join(active.where(F.col("active_source") == MERGED), "item_id", "left_semi")
    return switch_source(item_tags, raw, todo), _activated(active, todo)


def _activated(active: DataFrame, chosen: DataFrame) -> DataFrame:
    return active.join(chosen, "item_id", "left").select("item_id", F.coalesce("source", "active_source").alias("active_source"))


def rebuild(raw: DataFrame, priority: Sequence[str], log: DataFrame | None = None, merged: bool = False) -> DataFrame:
    """(item_id, tag, category) made anew from the metadata alone (OP-230).

    Each item follows its first source by priority, else the first by name, or,
    if ``merged``, all its sources where it has several.  Legacy rating names
    are renamed; log (item_id, tag, category, op), the last operations of hand-
    made changes, is put on top.
    """
    first = primary_source(source_records(raw), priority)
    if merged:
        several = several_sources(raw)
        own = source_rows(raw).join(first.join(several, "item_id", "left_anti"), ["item_id", "source"], "left_semi").select("item_id", "tag", "category")
        rows = own.unionByName(merged_rows(raw).join(several, "item_id", "left_semi"))
    else:
        rows = source_rows(raw).join(first, ["item_id", "source"], "left_semi").select("item_id", "tag", "category")
    rows = rename_ratings(rows)
    if log is None:
        return rows
    kept = rows.join(log.where("op = 'remove'"), ["item_id", "tag"], "left_anti")
    added = log.where("op = 'add'").select("item_id", "tag", "category").join(kept, ["item_id", "tag"], "left_anti")
    return kept.unionByName(added)


def rebuilt_items(raw: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(item_id, active_source, post_id, parent_id, has_children) that a rebuild sets (OP-230)."""
    records = source_records(raw)
    return records.join(primary_source(records, priority), ["item_id", "source"], "left_semi").select("item_id", F.col("source").alias("active_source"), "post_id", "parent_id", "has_children")


def priority_hash(priority: Sequence[str], version: int = 1) -> str:
    """SHA-256 of the priority list and its version as canonical JSON (OP-125, OP-235)."""
    return hashlib.sha256(json.dumps({"priority": list(priority), "version": version}, sort_keys=True).encode()).hexdigest()


def apply_priority(item_tags: DataFrame, raw: DataFrame, priority: Sequence[str], stored: str | None, version: int = 1, log: DataFrame | None = None) -> tuple[DataFrame, str, bool]:
    """(tag table, hash to store, changed): rebuilt only if the list differs from the stored hash; a first run just stores it (OP-235)."""
    now = priority_hash(priority, version)
    changed = stored is not None and stored != now
    return (rebuild(raw, priority, log) if changed else item_tags.select("item_id", "tag", "category")), now, changed


def reactivated(raw: DataFrame, before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """(item_id, before, after) of items whose first source another priority list changes (OP-235)."""
    records = source_records(raw)
    a, b = primary_source(records, before).withColumnRenamed("source", "before"), primary_source(records, after).withColumnRenamed("source", "after")
    return a.join(b, "item_id").where("before <> after")
