"""Implication rules: mining, closure and application (OP-202 to OP-213)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.graphs import reach, would_close

#: Steps that the tree view of a tag shows.
TREE_DEPTH = 10
_SUFFIX = r"\(([^)]+)\)$"
_VARIANT = r"^(.+?)_\([^)]+\)_\((.+?)\)$"


def naming_rules(tags: DataFrame, item_tags: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(source_tag, implied_tag, confidence, affected) from the form of character names (OP-202)."""
    characters = tags.where("category = 'character'").select(F.col("tag").alias("source_tag")).distinct()
    copyrights = tags.where("category = 'copyright'").select(F.col("tag").alias("implied_tag")).distinct()
    works = characters.withColumn("implied_tag", F.regexp_extract("source_tag", _SUFFIX, 1)).join(copyrights, "implied_tag").select("source_tag", "implied_tag", F.lit(0.92).alias("confidence"))
    base = F.concat(F.regexp_extract("source_tag", _VARIANT, 1), F.lit("_("), F.regexp_extract("source_tag", _VARIANT, 2), F.lit(")"))
    variants = characters.where(F.col("source_tag").rlike(_VARIANT)).withColumn("implied_tag", base)
    variants = variants.join(characters.select(F.col("source_tag").alias("implied_tag")), "implied_tag").select("source_tag", "implied_tag", F.lit(0.95).alias("confidence"))
    found = works.unionByName(variants)
    if existing is not None:
        found = found.join(existing.select("source_tag", "implied_tag"), ["source_tag", "implied_tag"], "left_anti")
    used = item_tags.groupBy(F.col("tag").alias("source_tag")).agg(F.countDistinct("item_id").alias("affected"))
    return found.join(used, "source_tag", "left").select("source_tag", "implied_tag", "confidence", F.coalesce("affected", F.lit(0)).alias("affected"))


def correlated_rules(tags: DataFrame, item_tags: DataFrame, min_confidence: float = 0.85, min_items: int = 3, allowed: tuple[str, ...] = (), existing: DataFrame | None = None) -> DataFrame:
    """(source_tag, implied_tag, confidence, sample, affected): what nearly always stands beside a character (OP-203, OP-076)."""
    targets = tags.where(F.col("category").isin("copyright", "general"))
    if allowed:
        targets = targets.where(F.col("extended_category").isin(*allowed))
    own = item_tags.where("category = 'character'").select("item_id", F.col("tag").alias("source_tag"))
    others = item_tags.join(targets.select("tag", "category"), ["tag", "category"], "left_semi").select("item_id", F.col("tag").alias("implied_tag")).distinct()  # a tag may stand in two categories
    counts = own.groupBy("source_tag").agg(F.count("*").alias("n"))
    both = own.join(others, "item_id").groupBy("source_tag", "implied_tag").agg(F.count("*").alias("sample")).where(F.col("sample") >= min_items)
    confidence = F.col("sample") / F.col("n")
    found = both.join(counts, "source_tag").where(confidence >= min_confidence)
    if existing is not None:
        found = found.join(existing.select("source_tag", "implied_tag"), ["source_tag", "implied_tag"], "left_anti")
    return found.select("source_tag", "implied_tag", F.round(confidence, 6).alias("confidence"), "sample", (F.col("n") - F.col("sample")).alias("affected"))


def _as_edges(rules: DataFrame) -> DataFrame:
    return rules.select(F.col("source_tag").alias("a"), F.col("implied_tag").alias("b"))


def closure(rules: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source_tag, implied_tag, depth): all that a tag implies through chains of any length, at its least depth (OP-083, OP-209).

    rules: (source_tag, implied_tag); cycles end, since a pair enters once.
    """
    return reach(_as_edges(rules), max_depth).select(F.col("a").alias("source_tag"), F.col("b").alias("implied_tag"), "depth")


def chain(rules: DataFrame, tags: DataFrame, max_depth: int = TREE_DEPTH) -> DataFrame:
    """(source_tag, implied_tag, depth, category): the tree view, cut at a depth; an unknown tag is general (OP-206)."""
    known = tags.groupBy(F.col("tag").alias("implied_tag")).agg(F.min("category").alias("category"))
    return closure(rules, max_depth).join(known, "implied_tag", "left").select("source_tag", "implied_tag", "depth", F.coalesce("category", F.lit("general")).alias("category"))


def missing_tags(item_tags: DataFrame, closed: DataFrame) -> DataFrame:
    """(item_id, tag) that active rules add (OP-209 to OP-211)."""
    implied = item_tags.select("item_id", F.col("tag").alias("source_tag")).join(closed.select("source_tag", "implied_tag"), "source_tag").select("item_id", F.col("implied_tag").alias("tag")).distinct()
    return implied.join(item_tags.select("item_id", "tag"), ["item_id", "tag"], "left_anti")


def apply_rules(item_tags: DataFrame, rules: DataFrame, tags: DataFrame) -> DataFrame:
    """The tag table with all implied tags (OP-211)."""
    added = missing_tags(item_tags, closure(rules)).join(tags.select("tag", "category"), "tag", "left").select("item_id", "tag", F.coalesce("category", F.lit("general")).alias("category"))
    return item_tags.select("item_id", "tag", "category").unionByName(added)


def preview(item_tags: DataFrame, source: str, implied: str) -> DataFrame:
    """How many items hold the source tag, hold both, and would gain the implied one (OP-208)."""
    flags = item_tags.where(F.col("tag").isin(source, implied)).groupBy("item_id").agg(F.max(F.when(F.col("tag") == source, 1).otherwise(0)).alias("s"), F.max(F.when(F.col("tag") == implied, 1).otherwise(0)).alias("t"))
    return flags.agg(F.count_if(F.expr("s = 1")).alias("total"), F.count_if(F.expr("s = 1 and t = 1")).alias("already"), F.count_if(F.expr("s = 1 and t = 0")).alias("will_gain"))


def cycle_checks(rules: DataFrame, proposals: DataFrame) -> DataFrame:
    """(source_tag, implied_tag, cycle): whether the implied tag already leads to the source, over any chain (OP-208)."""
    return would_close(_as_edges(rules), _as_edges(proposals)).select(F.col("a").alias("source_tag"), F.col("b").alias("implied_tag"), "cycle")


def makes_cycle(rules: DataFrame, source: str, implied: str) -> bool:
    """Whether the implied tag already leads to the source (OP-208)."""
    return cycle_checks(rules, rules.sparkSession.createDataFrame([(source, implied)], "source_tag string, implied_tag string")).first()["cycle"]


def implying(rules: DataFrame) -> DataFrame:
    """(implied_tag, n, sources): what implies each tag (OP-207)."""
    return rules.groupBy("implied_tag").agg(F.countDistinct("source_tag").alias("n"), F.array_join(F.array_sort(F.collect_set("source_tag")), ",").alias("sources"))


def auto_approved(naming: DataFrame, correlated: DataFrame, min_confidence: float = 0.95, min_sample: int = 10) -> DataFrame:
    """All naming rules and the surest correlated ones (OP-212)."""
    sure = correlated.where((F.col("confidence") >= min_confidence) & (F.col("sample") >= min_sample))
    return naming.select("source_tag", "implied_tag", F.lit("naming_pattern").alias("kind")).unionByName(sure.select("source_tag", "implied_tag", F.lit("correlation").alias("kind")))
