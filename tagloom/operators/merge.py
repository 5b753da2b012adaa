"""Metadata of several sources into one tag table (OP-223 to OP-239)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.columns import base_of_extended, choose, normal_rating, rating_of_code
from tagloom.functions.constants import BASE_CATEGORIES, MERGE_PRIORITY

_TAG_FIELDS = tuple(c for c in BASE_CATEGORIES)


def _split(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def extract_tags(raw: DataFrame) -> DataFrame:
    """(item_id, source, category, tag) from (item_id, data): JSON of the form {"sources": {name: {...}}} (OP-223).

    A source gives tags as tag_string_<category> texts, as a tags object of
    arrays by category, or as one tags text or list of texts, which are general.
    JSON that does not parse gives nothing.
    """
    sources = raw.select("item_id", F.explode(F.from_json(F.get_json_object("data", "$.sources"), "map<string,string>")).alias("source", "d"))
    as_text = F.get_json_object("d", "$.tags")
    listed = F.when(as_text.startswith("["), F.array_join(F.from_json(as_text, "array<string>"), " ")).otherwise(as_text)
    lists = F.from_json(as_text, "struct<" + ",".join(f"{c}:array<string>" for c in _TAG_FIELDS) + ">")
    by_category = [
        F.struct(F.lit(c).alias("category"), F.when(as_text.startswith("{"), F.coalesce(lists[c], F.array().cast("array<string>"))).otherwise(_split(F.get_json_object("d", f"$.tag_string_{c}"))).alias("tags"))
        for c in _TAG_FIELDS if c != "general"
    ]
    general = F.when(as_text.startswith("{"), F.coalesce(lists["general"], F.array().cast("array<string>"))).when(F.get_json_object("d", "$.tag_string_general").isNotNull(), _split(F.get_json_object("d", "$.tag_string_general"))).otherwise(_split(listed))
    rows = sources.select("item_id", "source", F.explode(F.array(*by_category, F.struct(F.lit("general").alias("category"), general.alias("tags")))).alias("c"))
    return rows.select("item_id", "source", "c.category", F.explode("c.tags").alias("tag")).withColumn("tag", normal_rating(F.col("tag"))).distinct()


def extract_rating(raw: DataFrame) -> DataFrame:
    """(item_id, source, rating) by each source's letter code (OP-224)."""
    sources = raw.select("item_id", F.explode(F.from_json(F.get_json_object("data", "$.sources"), "map<string,string>")).alias("source", "d"))
    return sources.select("item_id", "source", rating_of_code(F.substring(F.get_json_object("d", "$.rating"), 1, 1)).alias("rating")).where("rating is not null")


def score_of(data: Column, sources: Sequence[str]) -> Column:
    """The score of the first source that has one: a number, or a total within an object (OP-236)."""
    each = [F.coalesce(F.get_json_object(data, f"$.sources.{s}.score.total"), F.get_json_object(data, f"$.sources.{s}.score")).try_cast("long") for s in sources]
    return F.coalesce(*each)


def primary_source(item_sources: DataFrame, priority: Sequence[str]) -> DataFrame:
    """(item_id, source): the first by priority, else the first by name (OP-231)."""
    place = choose(F.col("source"), {s: k for k, s in enumerate(priority)}, len(priority))
    return item_sources.groupBy("item_id").agg(F.min(F.struct(place.alias("p"), F.col("source").alias("s"))).alias("m")).select("item_id", F.col("m.s").alias("source"))


def merge_categories(rows: DataFrame) -> DataFrame:
    """(item_id, tag, category): each tag once, in its category of highest priority (OP-226)."""
    place = choose(F.col("category"), MERGE_PRIORITY, 0)
    best = rows.groupBy("item_id", "tag").agg(F.max(F.struct(place.alias("p"), F.col("category").alias("c"))).alias("m"))
    return best.select("item_id", "tag", F.col("m.c").alias("category"))


def merge_two(primary: DataFrame, secondary: DataFrame, skip: tuple[str, ...] = ("artist",)) -> DataFrame:
    """(item_id, category, tags): union per category; a skipped category comes from the primary alone (OP-225)."""
    rows = primary.select("item_id", "category", "tag").unionByName(secondary.where(~F.col("category").isin(*skip)).select("item_id", "category", "tag"))
    return rows.groupBy("item_id", "category").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))


def dedupe_general(item_tags: DataFrame) -> DataFrame:
    """General tags that also stand in another category of the item go (OP-227)."""
    other = item_tags.where("category <> 'general'").select("item_id", "tag").withColumn("category", F.lit("general"))
    return item_tags.join(other, ["item_id", "tag", "category"], "left_anti").select("item_id", "tag", "category")


def category_columns(item_tags: DataFrame) -> DataFrame:
    """One row per item with a text of sorted tags per category (OP-232)."""
    cell = lambda c: F.coalesce(F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") == c, F.col("tag")))), " "), F.lit("")).alias(f"tags_{c}")
    return item_tags.groupBy("item_id").agg(*(cell(c) for c in BASE_CATEGORIES))


def from_category_columns(wide: DataFrame) -> DataFrame:
    """The inverse of ``category_columns`` (OP-233)."""
    each = F.array(*(F.struct(F.lit(c).alias("category"), _split(F.col(f"tags_{c}")).alias("tags")) for c in BASE_CATEGORIES))
    return wide.select("item_id", F.explode(each).alias("c")).select("item_id", F.explode("c.tags").alias("tag"), "c.category").distinct()


def repair_missing(wide: DataFrame, item_tags: DataFrame) -> DataFrame:
    """Tags that the columns name and the table lacks (OP-233)."""
    return from_category_columns(wide).join(item_tags, ["item_id", "tag"], "left_anti").select("item_id", "tag", "category")


def rename_ratings(item_tags: DataFrame) -> DataFrame:
    """Legacy rating names replaced and put into meta; rows that become equal merge (OP-234)."""
    name = normal_rating(F.col("tag"))
    return item_tags.select("item_id", name.alias("tag"), F.when(F.startswith(name, F.lit("rating:")), "meta").otherwise(F.col("category")).alias("category")).distinct()


def multi_source_items(item_sources: DataFrame) -> DataFrame:
    """Items with several sources (OP-229)."""
    return item_sources.groupBy("item_id").agg(F.countDistinct("source").alias("n")).where("n > 1")


def cooccurring(item_tags: DataFrame, tag: str, k: int = 10) -> DataFrame:
    """(tag, n): what most often stands beside a tag (OP-237)."""
    held = item_tags.where(F.col("tag") == tag).select("item_id").distinct()
    return item_tags.where(F.col("tag") != tag).join(held, "item_id", "left_semi").groupBy("tag").agg(F.countDistinct("item_id").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def suggest_category(tags: DataFrame, item_tags: DataFrame) -> DataFrame:
    """(tag, suggestion): by form of the name, else the commonest category beside it (OP-237).

    Beside: other tags of the same items.  Per item the categories are counted
    once and joined to its tags, so no pair of tags is ever laid out.
    """
    low = F.lower("tag")
    any_of = lambda *parts: low.rlike("|".join(parts))
    by_name = F.when(low.rlike("^rating(-source)?:"), "meta").when(any_of(r"_\(copyright\)", r"_\(series\)", r"_\(game\)", r"_\(anime\)"), "copyright").when(any_of(r"_\(character\)", r"_\(cosplay\)"), "character")
    by_name = by_name.when(any_of("artist:", "by_"), "artist").when(any_of("anthro", "feral", "humanoid", "taur"), "species")
    per_item = item_tags.groupBy("item_id", F.col("category").alias("beside")).agg(F.count("*").alias("n"))
    seen = item_tags.join(per_item, "item_id").groupBy("tag", "beside").agg(F.sum(F.col("n") - F.when(F.col("category") == F.col("beside"), 1).otherwise(0)).alias("n")).where("n > 0")
    first = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "beside"))
    common = seen.withColumn("r", first).where("r = 1").select("tag", "beside")
    return tags.select("tag").distinct().join(common, "tag", "left").select("tag", F.coalesce(by_name, F.col("beside"), F.lit("general")).alias("suggestion"))


def import_categories(tags: DataFrame, incoming: DataFrame, mode: str, create_missing: bool = False) -> DataFrame:
    """Extended categories brought in: merge fills empty ones, update and overwrite replace, overwrite also clears the rest (OP-016, OP-237)."""
    both = tags.alias("t").join(incoming.alias("i"), "tag", "full" if create_missing else "left")
    old, new = F.col("t.extended_category"), F.col("i.extended_category")
    value = {"merge": F.coalesce(old, new), "update": F.coalesce(new, old), "overwrite": new}[mode]
    return both.select("tag", F.coalesce("t.category", base_of_extended(new), F.lit("general")).alias("category"), value.alias("extended_category"))


def sync_base(tags: DataFrame) -> DataFrame:
    """Base category from the extended one for tags that are general or meta (OP-237)."""
    base = F.when(F.col("category").isin("general", "meta"), F.coalesce(base_of_extended(F.col("extended_category")), F.col("category"))).otherwise(F.col("category"))
    return tags.select("tag", base.alias("category"), "extended_category")


def display_groups(item_tags: DataFrame, counts: DataFrame, item_id: int) -> DataFrame:
    """(category, tags): an item's tags with their counts, by category (OP-238, OP-239)."""
    own = item_tags.where(F.col("item_id") == item_id).join(counts, "tag", "left")
    shown = F.concat(F.col("tag"), F.lit("="), F.coalesce("n", F.lit(0)).cast("string"))
    return own.groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(shown)), " ").alias("tags"))


def tags_in_order(names: DataFrame, tags: DataFrame, counts: DataFrame) -> DataFrame:
    """(place, tag, extended_category, n) of named tags (place, tag) in the order asked for; unknown ones stay with a count of 0 (OP-239, OP-267)."""
    known = tags.groupBy("tag").agg(F.min("extended_category").alias("extended_category"))
    rows = names.join(known, "tag", "left").join(counts.select("tag", "n"), "tag", "left")
    return rows.select("place", "tag", "extended_category", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")


def set_categories(tags: DataFrame, chosen: DataFrame) -> DataFrame:
    """The tags with the extended category of chosen ones (tag, extended_category) set; those not named keep theirs (OP-237)."""
    new = chosen.groupBy("tag").agg(F.min("extended_category").alias("chosen"), F.lit(True).alias("named"))
    value = F.when(F.col("named"), F.col("chosen")).otherwise(F.col("extended_category"))
    return tags.join(new, "tag", "left").select("tag", "category", value.alias("extended_category"))
