"""Counts, breakdowns and coverage over the domain tables (OP-086 to OP-100, OP-105)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import hashed
from tagloom.sources.proxies import Catalog


def percent(part: Column, whole: Column) -> Column:
    """Share in percent to one decimal; null of nothing."""
    return F.round(F.try_divide(100.0 * part, whole), 1)


def avg_tags_per_item(item_tags: DataFrame) -> DataFrame:
    """Mean number of tags of items that have any (OP-087)."""
    return item_tags.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 1).alias("avg_tags"))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per key, null keys left out (OP-088, OP-089)."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def tag_counts(item_tags: DataFrame) -> DataFrame:
    """Items per tag (OP-090)."""
    return item_tags.groupBy("tag").agg(F.countDistinct("item_id").alias("n"))


def all_tags(tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    """Every tag with its number of items, zero kept (OP-091, OP-267)."""
    return tags.select("tag", "category").join(tag_counts(item_tags), "tag", "left").select("tag", "category", F.coalesce("n", F.lit(0)).alias("n"))


def dashboard(c: Catalog) -> DataFrame:
    """(facet, key, value): totals and breakdowns as one table (OP-092)."""
    total = lambda name, df: df.agg(F.count("*").cast("double").alias("value")).select(F.lit("total").alias("facet"), F.lit(name).alias("key"), "value")
    facet = lambda name, df, key: count_by(df, key).select(F.lit(name).alias("facet"), F.col(key).alias("key"), F.col("n").cast("double").alias("value"))
    top = tag_counts(c.item_tags).orderBy(F.desc("n"), "tag").limit(20).select(F.lit("top_tag").alias("facet"), F.col("tag").alias("key"), F.col("n").cast("double").alias("value"))
    average = avg_tags_per_item(c.item_tags).select(F.lit("total").alias("facet"), F.lit("avg_tags").alias("key"), F.col("avg_tags").alias("value"))
    out = total("items", c.items).unionByName(total("favourites", c.favourites)).unionByName(average)
    return out.unionByName(facet("source", c.item_sources, "source")).unionByName(facet("category", c.tags, "category")).unionByName(top)


def categorization_stats(tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    """How many tags, and how many uses, have an extended category (OP-093)."""
    used = tags.join(tag_counts(item_tags), "tag", "left")
    has = F.col("extended_category").isNotNull()
    n = F.coalesce("n", F.lit(0))
    return used.agg(
        F.count("*").alias("tags"), F.count_if(has).alias("categorized"), F.coalesce(F.sum(F.when(has, n).otherwise(0)), F.lit(0)).alias("uses_categorized"), F.coalesce(F.sum(n), F.lit(0)).alias("uses")
    ).withColumn("percent", percent(F.col("categorized"), F.col("tags")))


def rating_distribution(c: Catalog) -> DataFrame:
    """Items per rating, by active source and in total (OP-094)."""
    rated = c.item_tags.where(F.startswith("tag", F.lit("rating:"))).join(c.items.select("item_id", "active_source"), "item_id")
    cell = lambda s: F.count_if(F.col("active_source") == s).alias(f"source_{s.lower()}")
    return rated.groupBy(F.col("tag").alias("rating")).agg(cell("A"), cell("N"), cell("R"), F.count("*").alias("total"))


def prediction_crossref(predictions: DataFrame, item_tags: DataFrame, tag: str, min_confidence: float, min_count: int) -> DataFrame:
    """Predicted tags of items that hold a tag: mean confidence and items, both at least so much (OP-097)."""
    held = item_tags.where(F.col("tag") == tag).select("item_id").distinct()
    found = predictions.join(hashed(held), "item_id", "left_semi").groupBy("tag").agg(F.avg("confidence").alias("a"), F.countDistinct("item_id").alias("n"))
    return found.where((F.col("a") >= min_confidence) & (F.col("n") >= min_count)).select("tag", F.round("a", 6).alias("avg_confidence"), "n")


def tag_samples(item_tags: DataFrame, k: int = 3) -> DataFrame:
    """Each tag's first items by id (OP-105)."""
    place = F.row_number().over(Window.partitionBy("tag").orderBy("item_id"))
    first = item_tags.select("tag", "item_id").distinct().withColumn("place", place).where(F.col("place") <= k)
    return first.groupBy("tag").agg(F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("samples"))


def coverage(c: Catalog) -> DataFrame:
    """Shares of items with upscaled versions, a score, and a source (OP-098, OP-099)."""
    return c.items.agg(
        F.count("*").alias("items"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), percent(F.count("upscaled_width"), F.count("*")).alias("upscaled_percent"),
        percent(F.count("score"), F.count("*")).alias("score_percent"), percent(F.count("active_source"), F.count("*")).alias("source_percent"),
    )


def collection_status(c: Catalog) -> DataFrame:
    """Tagged, rated and all items (OP-100, OP-086)."""
    tagged = c.item_tags.agg(F.countDistinct("item_id").alias("tagged"), F.countDistinct(F.when(F.startswith("tag", F.lit("rating:")), F.col("item_id"))).alias("rated"))
    return c.items.agg(F.count("*").alias("items")).join(F.broadcast(tagged), F.lit(True))  # one row each
