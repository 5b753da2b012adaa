"""What arriving items pass: source policy, payload shapes, votes and label corrections (OP-262 to OP-265, OP-272 to OP-274)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.columns import choose
from tagloom.functions.constants import BASE_CATEGORIES
from tagloom.operators.selection import QUARTILES, ranked_values

#: How the sites of reverse-search hits write a post's number.
POST_URL = r"/(?:posts?|post/show|artworks|index\.php\?page=post&s=view&id=)/?([0-9]+)"


def tagger_outputs(raw: DataFrame, tags: DataFrame, stored: float = 0.5, shown: float = 0.5, shown_by_category: Mapping[str, float] | None = None) -> DataFrame:
    """(item_id, tag, category, confidence, shown) of a model's raw outputs (item_id, idx, logit) and its tags (idx, tag, category) (OP-264).

    Confidence is the sigmoid of an output; rows below ``stored``, outputs
    without a tag and ratings go; categories that are not known are general; a
    tag is shown from its category's threshold on, else from ``shown``.
    """
    sure = 1.0 / (1.0 + F.exp(-F.col("logit")))
    named = tags.where(~F.col("tag").rlike("^rating[:_]")).select("idx", "tag", F.when(F.col("category").isin(*BASE_CATEGORIES), F.col("category")).otherwise("general").alias("category"))
    # the sigmoid rises, so the limit is one on the outputs themselves and reaches the scan
    rows = raw.where(F.col("logit") >= math.log(stored / (1.0 - stored))).join(named, "idx").withColumn("p", sure)
    limit = F.coalesce(choose(F.col("category"), dict(shown_by_category or {})), F.lit(shown)) if shown_by_category else F.lit(shown)
    return rows.select("item_id", "tag", "category", F.round("p", 6).alias("confidence"), (F.col("p") >= limit).alias("shown"))


def frame_votes(predictions: DataFrame, least: float = 0.5, sure: float = 0.8) -> DataFrame:
    """(item_id, tag, category) of tags that two frames or one sure frame give (OP-264)."""
    kept = predictions.where((F.col("confidence") >= least) & ~F.col("tag").rlike("^rating[:_]"))
    category = F.when(F.col("category").isin(*BASE_CATEGORIES), F.col("category")).otherwise("general")
    votes = kept.groupBy("item_id", "tag", category.alias("category")).agg(F.count("*").alias("n"), F.max("confidence").alias("top"))
    return votes.where((F.col("n") >= 2) | (F.col("top") >= sure)).select("item_id", "tag", "category")


def corrected_labels(labels: DataFrame, corrections: Mapping[str, str], allowed: Sequence[str]) -> DataFrame:
    """(tag, label): labels trimmed and corrected; those that are then unknown go (OP-265)."""
    plain = F.trim("label")
    return labels.select("tag", F.coalesce(choose(plain, dict(corrections)), plain).alias("label")).where(F.col("label").isin(*allowed))


def source_policy(item_sources: DataFrame, trusted: Sequence[str], tagger: str, complementary: Sequence[str]) -> DataFrame:
    """(item_id, has_trusted, has_tagger, stands_alone): a complementary source must not stand alone (OP-272)."""
    any_of = lambda names: F.max(F.col("source").isin(*names))
    flags = item_sources.groupBy("item_id").agg(any_of(trusted).alias("has_trusted"), any_of([tagger]).alias("has_tagger"), F.min(F.col("source").isin(*complementary)).alias("stands_alone"))
    return flags.select("item_id", "has_trusted", "has_tagger", "stands_alone")


def flatten_payload(payloads: DataFrame) -> DataFrame:
    """(item_id, source, url, width, height, size) from differently shaped payloads (item_id, source, data) (OP-273)."""
    first = lambda *paths: F.coalesce(*(F.get_json_object("data", p) for p in paths))
    number = lambda *paths: first(*paths).try_cast("long")
    return payloads.select(
        "item_id", "source", first("$.file.url", "$.file_url", "$.large_file_url", "$.image_urls.large").alias("url"), number("$.file.width", "$.image_width", "$.width").alias("width"),
        number("$.file.height", "$.image_height", "$.height").alias("height"), number("$.file.size", "$.file_size").alias("size"),
    )


def search_hits(hits: DataFrame, least: float) -> DataFrame:
    """(item_id, host, post_id): reverse-search hits of enough similarity, their post read from the address (OP-274)."""
    return hits.where(F.col("similarity") >= least).select("item_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_extract("url", POST_URL, 1).try_cast("long").alias("post_id")).where("post_id is not null")


def quantiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Least, quartiles by nearest rank, most and mean of a value per group, groups of any size (OP-132, OP-263)."""
    return ranked_values(rows, group, value, QUARTILES).select(group, "n", *QUARTILES, F.round("mean", 6).alias("mean"))


def score_spread(scored: DataFrame) -> DataFrame:
    """Number, range, best and worst of a set of scores (OP-262)."""
    return scored.agg(F.count("*").alias("n"), F.round(F.max("score") - F.min("score"), 5).alias("spread"), F.round(F.max("score"), 5).alias("best"), F.round(F.min("score"), 5).alias("worst"))

