"""The life of implication rules: suggestions, approval, listing, application and removal (OP-060, OP-204, OP-205, OP-211, OP-276, OP-281).

rules: (source_tag, implied_tag, inference_type, confidence, status).
facts: (item_id, tag, category, source); what rules add has source 'implication'.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.implications import closure

#: How long found suggestions are shown before they are looked for again.
LIFE_SECONDS = 300
PAIR = ["source_tag", "implied_tag"]


def _categories(tags: DataFrame) -> DataFrame:
    """(tag, category), one row per tag, the first category by name."""
    return tags.groupBy("tag").agg(F.min("category").alias("category"))


def suggestions(naming: DataFrame, correlated: DataFrame, tags: DataFrame) -> DataFrame:
    """(source_tag, implied_tag, pattern_type, confidence, source_category, implied_category): both kinds in one table; write it to keep it (OP-204)."""
    both = naming.select(*PAIR, F.lit("naming_pattern").alias("pattern_type"), "confidence").unionByName(correlated.select(*PAIR, F.lit("correlation").alias("pattern_type"), "confidence"))
    known = _categories(tags)
    source = known.select(F.col("tag").alias("source_tag"), F.col("category").alias("source_category"))
    implied = known.select(F.col("tag").alias("implied_tag"), F.col("category").alias("implied_category"))
    return both.join(source, "source_tag", "left").join(implied, "implied_tag", "left").select(*PAIR, "pattern_type", "confidence", *(F.coalesce(c, F.lit("general")).alias(c) for c in ("source_category", "implied_category")))


def unexpired(found: DataFrame, now: Column, seconds: int = LIFE_SECONDS) -> DataFrame:
    """Kept suggestions (made_at) that are younger than their life; the rest are to be found anew (OP-204)."""
    return found.where(F.unix_micros("made_at") > F.unix_micros(now) - seconds * 1_000_000)


def _allowed(column: str, wanted: Sequence[str]) -> Column:
    """Among the named categories and not among those named with an exclamation mark; "all" allows any."""
    if "all" in wanted:
        return F.lit(True)
    within, without = [c for c in wanted if not c.startswith("!")], [c[1:] for c in wanted if c.startswith("!")]
    return (F.col(column).isin(*within) if within else F.lit(True)) & (~F.col(column).isin(*without) if without else F.lit(True))


def filtered(found: DataFrame, text: str = "", pattern: str = "all", source_categories: Sequence[str] = (), implied_categories: Sequence[str] = ()) -> DataFrame:
    """Suggestions that hold the text in either tag, of a pattern and of some categories (OP-060)."""
    kept = found.where(_allowed("source_category", source_categories) & _allowed("implied_category", implied_categories))
    if text:
        kept = kept.where(F.contains(F.lower("source_tag"), F.lit(text.lower())) | F.contains(F.lower("implied_tag"), F.lit(text.lower())))
    return kept if pattern == "all" else kept.where(F.col("pattern_type") == pattern)


def page(found: DataFrame, number: int, size: int) -> DataFrame:
    """One page, counted from 1, by type and names (OP-060)."""
    return found.orderBy("pattern_type", *PAIR).offset((number - 1) * size).limit(size)


def summary(found: DataFrame, size: int) -> DataFrame:
    """(total, naming, correlation, pages) of suggestions (OP-060, OP-204)."""
    kind = lambda k: F.count_if(F.col("pattern_type") == k)
    return found.agg(F.count("*").alias("total"), kind("naming_pattern").alias("naming"), kind("correlation").alias("correlation")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def approved(rules: DataFrame, new: DataFrame, tags: DataFrame) -> DataFrame:
    """The rules with those of new (source_tag, implied_tag, inference_type, confidence) that are not there yet and whose tags exist (OP-205, OP-212, OP-281)."""
    known = tags.select("tag").distinct()
    fresh = new.where("source_tag <> implied_tag").dropDuplicates(PAIR).join(rules, PAIR, "left_anti")
    fresh = fresh.join(known, fresh.source_tag == known.tag, "left_semi").join(known, F.col("implied_tag") == known.tag, "left_semi")
    return rules.unionByName(fresh.select(*PAIR, "inference_type", "confidence", F.lit("active").alias("status")))


def manual(rules: DataFrame, pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """The rules with hand-made ones added (OP-205)."""
    return approved(rules, pairs.select(*PAIR, F.lit("manual").alias("inference_type"), F.lit(1.0).alias("confidence")), tags)


def deleted(rules: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The rules without some, or without any active one (OP-205)."""
    return rules.where("status <> 'active'") if pairs is None else rules.join(pairs, PAIR, "left_anti")


def listed(rules: DataFrame, tags: DataFrame) -> DataFrame:
    """Active rules with both categories, by source category and name (OP-205)."""
    known = _categories(tags)
    source = known.select(F.col("tag").alias("source_tag"), F.col("category").alias("source_category"))
    implied = known.select(F.col("tag").alias("implied_tag"), F.col("category").alias("implied_category"))
    rows = rules.where("status = 'active'").join(source, "source_tag").join(implied, "implied_tag")
    return rows.select("source_tag", "source_category", "implied_tag", "implied_category", "inference_type", "confidence").orderBy("source_category", "source_tag", "implied_tag")


def used(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_tag, implied_tag, items): on how many items the source of each rule stands (OP-276)."""
    n = facts.groupBy(F.col("tag").alias("source_tag")).agg(F.countDistinct("item_id").alias("items"))
    return rules.join(n, "source_tag", "left").select(*PAIR, F.coalesce("items", F.lit(0)).alias("items"))


def without_existing(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Suggestions that are no rule yet (OP-276)."""
    return found.join(rules, PAIR, "left_anti")


def applied(facts: DataFrame, rules: DataFrame, tags: DataFrame) -> DataFrame:
    """The facts with all that active rules imply, over chains of any length, marked as implied (OP-211)."""
    closed = closure(rules.where("status = 'active'").select(*PAIR)).select(*PAIR)
    added = facts.select("item_id", F.col("tag").alias("source_tag")).join(closed, "source_tag").select("item_id", F.col("implied_tag").alias("tag")).distinct().join(facts, ["item_id", "tag"], "left_anti")
    return facts.select("item_id", "tag", "category", "source").unionByName(added.join(_categories(tags), "tag", "left").select("item_id", "tag", F.coalesce("category", F.lit("general")).alias("category"), F.lit("implication").alias("source")))


def applied_one(facts: DataFrame, source: str, implied: str, category: str = "general") -> DataFrame:
    """(item_id, tag, category, source) rows that one rule adds, without what follows from them (OP-210)."""
    return facts.where(F.col("tag") == source).select("item_id").distinct().join(facts.where(F.col("tag") == implied), "item_id", "left_anti").select("item_id", F.lit(implied).alias("tag"), F.lit(category).alias("category"), F.lit("implication").alias("source"))


def cleared(facts: DataFrame) -> DataFrame:
    """The facts without what rules have added (OP-211)."""
    return facts.where("source <> 'implication'")


def reapplied(facts: DataFrame, rules: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, counts): cleared and applied anew; counts is one row (cleared, rules, tags_added, items_updated) (OP-211)."""
    clean = cleared(facts)
    now = applied(clean, rules, tags)
    gone = facts.agg(F.count_if(F.col("source") == "implication").alias("cleared"))
    active = rules.agg(F.count_if(F.col("status") == "active").alias("rules"))
    added = now.where("source = 'implication'").agg(F.count("*").alias("tags_added"), F.countDistinct("item_id").alias("items_updated"))
    return now, gone.join(F.broadcast(active), F.lit(True)).join(F.broadcast(added), F.lit(True))  # one row each
