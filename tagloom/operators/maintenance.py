"""Derived tables kept up with edits, in three scopes: some items, some tags, all (OP-007, OP-009, OP-268).

What is derived from the tag table, its counts, each item's text, the word
index and the bits, is not built anew after an edit.  The edit names the items that it
touches; their old share of each table goes and their new one comes.  Work and
shuffles grow with the touched items, but for one pass over each table's keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.coded import bits_updated, run_of, tag_bits
from tagloom.operators.detail import refreshed
from tagloom.operators.search import index_updated, text_index


class Derived(NamedTuple):
    """counts: (tag, category, n); texts: (item_id, tags); index: (word, item_id, field); bits: (word, run, bits)."""

    counts: DataFrame
    texts: DataFrame
    index: DataFrame
    bits: DataFrame


def _counts(item_tags: DataFrame) -> DataFrame:
    return item_tags.groupBy("tag", "category").agg(F.count("*").alias("n"))


def _texts(items: DataFrame, item_tags: DataFrame) -> DataFrame:
    own = item_tags.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))
    return items.select("item_id").join(own, "item_id", "left").select("item_id", F.coalesce("tags", F.lit("")).alias("tags"))


def _postings(item_tags: DataFrame) -> DataFrame:
    return item_tags.select(F.lower("tag").alias("word"), "item_id")


def built(items: DataFrame, item_tags: DataFrame) -> Derived:
    """The derived tables of items (item_id, filepath) and their tags (item_id, tag, category), from nothing: scope all."""
    return Derived(_counts(item_tags), _texts(items, item_tags), text_index(items, item_tags), tag_bits(_postings(item_tags)))


def edited(item_tags: DataFrame, changes: DataFrame) -> DataFrame:
    """The tag table after changes (item_id, tag, category, op): what is added is there once, what is removed is gone; of both for one row the removal counts."""
    key = ["item_id", "tag", "category"]
    added, removed = changes.where("op = 'add'").select(*key), changes.where("op = 'remove'").select(*key)
    return item_tags.select(*key).unionByName(added).join(removed, key, "left_anti").distinct()


def items_of_tags(before: DataFrame, after: DataFrame, tags: DataFrame) -> DataFrame:
    """(item_id) of all items that have or had one of some tags (tag): what an edit of tags touches."""
    return before.select("item_id", "tag").unionByName(after.select("item_id", "tag")).join(tags.select("tag").distinct(), "tag", "left_semi").select("item_id").distinct()


def maintained(derived: Derived, items: DataFrame, before: DataFrame, after: DataFrame, touched: DataFrame) -> Derived:
    """The derived tables after an edit that touched some items (item_id), equal to those built anew.

    items: (item_id, filepath) as they are now, so a touched item that is no
    longer among them leaves all tables; before and after: the tag table, in
    which nothing but touched items differs.
    """
    mine = touched.select("item_id").distinct()
    own = lambda rows: rows.join(mine, "item_id", "left_semi")
    there = lambda rows: rows.join(items.select("item_id"), "item_id", "left_semi")
    now = there(own(after))
    less, more = _counts(own(before)).withColumn("n", -F.col("n")), _counts(now)
    counts = derived.counts.unionByName(less).unionByName(more).groupBy("tag", "category").agg(F.sum("n").alias("n")).where("n <> 0")
    texts = refreshed(derived.texts, _texts(own(items), now), mine)
    runs = mine.select(run_of(F.col("item_id")).alias("run")).distinct()  # of 64 items; the others of a run are read again
    around = there(_postings(after).withColumn("run", run_of(F.col("item_id"))).join(runs, "run", "left_semi").select("word", "item_id"))
    return Derived(counts, texts, index_updated(derived.index, items, now, mine), bits_updated(derived.bits, around, mine))
