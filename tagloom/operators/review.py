"""Review of near-duplicates: scoring, queues and calibration (OP-177 to OP-186, OP-263)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.constants import BLOB_GUARD, SUGGESTION_BOUNDS, VISUAL_GUARD

QUEUES = ("distance", "duplicate_first", "likely_duplicates", "duplicate_hunt")


def bounds(lower: float | None = None, upper: float | None = None) -> tuple[float, float]:
    """Bounds within [0, 1], apart by 0.05 where they cross (OP-182)."""
    low = min(max(SUGGESTION_BOUNDS[0] if lower is None else lower, 0.0), 1.0)
    high = min(max(SUGGESTION_BOUNDS[1] if upper is None else upper, 0.0), 1.0)
    return round(low, 4), round(high if high > low else min(1.0, low + 0.05), 4)


def ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger, both at least 1."""
    x, y = F.greatest(F.coalesce(a, F.lit(0)), F.lit(1)), F.greatest(F.coalesce(b, F.lit(0)), F.lit(1))
    return F.least(x, y) / F.greatest(x, y)


def gap(a: Column, b: Column) -> Column:
    """The difference of two counts over the larger."""
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def adjustment(pixel: Column, filesize: Column, tag_gap: Column) -> Column:
    """What metadata says of a pair (OP-177)."""
    return (1 - pixel) * 0.020 + (1 - filesize) * 0.012 + tag_gap * 0.006


def guarded(raw: Column, visual: Column, blob: Column) -> Column:
    """Metadata counts in part where a pair looks nearly identical (OP-178)."""
    scale = F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.greatest(visual, F.lit(0.0)) / VISUAL_GUARD), F.least(F.lit(1.0), F.greatest(blob, F.lit(0.0)) / BLOB_GUARD))
    return F.when(raw <= 0, F.lit(0.0)).when((visual >= VISUAL_GUARD) | (blob >= BLOB_GUARD), raw).otherwise(raw * scale)


def suggestions(pairs: DataFrame) -> DataFrame:
    """Adds signal and metadata_adjustment to pairs with their ratios and visual metrics (OP-180, OP-270)."""
    adj = guarded(adjustment(F.col("pixel_ratio"), F.col("filesize_ratio"), F.col("tag_gap_ratio")), F.col("visual_signal"), F.col("largest_blob_ratio"))
    return pairs.withColumn("metadata_adjustment", adj).withColumn("signal", F.least(F.lit(1.0), F.col("visual_signal") + F.col("metadata_adjustment")))


def label(signal: Column, low: float, high: float) -> tuple[Column, Column]:
    """Class and confidence of a signal (OP-181)."""
    band, middle = max(high - low, 1e-6), (low + high) / 2
    name = F.when(signal <= low, "likely_duplicate").when(signal >= high, "likely_variation").otherwise("uncertain")
    sure = F.when(signal <= low, (low - signal) / max(low, 1e-6)).when(signal >= high, (signal - high) / max(1 - high, 1e-6)).otherwise(1 - F.least(F.lit(1.0), F.abs(signal - middle) / (band / 2)))
    return name, F.least(F.lit(1.0), sure)


def queue(scored: DataFrame, reviewed: DataFrame, mode: str, threshold: int, scan_threshold: int, limit: int, offset: int = 0) -> DataFrame:
    """(a, b, distance, signal, confidence, place) of pairs not yet reviewed, in a mode's order (OP-183, OP-073, OP-077, OP-111).

    Reviewed pairs are normalised to a < b, so leaving them out is one equi anti-join.
    """
    low, high = bounds()
    open_ = scored.where(F.col("distance") <= threshold).join(reviewed, ["a", "b"], "left_anti")
    if mode == "likely_duplicates":
        open_ = open_.where(F.col("signal") <= low)
    bucket = F.when(F.col("signal") <= low, 0).when(F.col("signal") < high, 1).otherwise(2)
    keys = {
        "distance": [F.col("distance")], "likely_duplicates": [F.col("signal"), F.col("distance")], "duplicate_first": [bucket, F.col("signal"), F.col("distance")],
        "duplicate_hunt": [bucket, F.col("signal"), F.col("largest_blob_ratio"), F.col("peak_blob_contrast"), F.col("changed_ratio"), F.col("distance"), F.col("mean_abs_diff")],
    }[mode] + [F.col("a"), F.col("b")]
    page = open_.orderBy(*keys).offset(offset).limit(limit)
    confidence = F.greatest(F.lit(0.0), F.round((1 - F.col("distance") / scan_threshold) * 100, 1))
    place = F.row_number().over(Window.orderBy(*keys)).cast("int")  # over one page
    return page.select("a", "b", "distance", F.round("signal", 6).alias("signal"), confidence.alias("confidence"), place.alias("place"))


def calibration(actions: DataFrame) -> DataFrame:
    """(suggested, manual, outcome, n) of review actions (suggested, action) (OP-185, OP-263)."""
    manual = F.when(F.col("action").isin("delete_a", "delete_b"), "duplicate").when(F.col("action").isin("non_duplicate", "related"), "variation").otherwise("other")
    right = ((F.col("suggested") == "likely_duplicate") & (F.col("manual") == "duplicate")) | ((F.col("suggested") == "likely_variation") & (F.col("manual") == "variation"))
    outcome = F.when(F.col("suggested").isin("uncertain", "unavailable") | (F.col("manual") == "other"), "uncertain").when(right, "matches").otherwise("mismatches")
    return actions.withColumn("manual", manual).withColumn("outcome", outcome).groupBy("suggested", "manual", "outcome").agg(F.count("*").alias("n"))


def precision_at(judged: DataFrame, order: list[Column], depths: Sequence[int]) -> DataFrame:
    """(k, n, right, precision): of the first k suggestions in an order, how many the reviewer called duplicates (OP-263).

    judged: (is_duplicate, ..).  Only the deepest page is sorted and kept.
    """
    first = judged.orderBy(*order).limit(max(depths))
    place = F.row_number().over(Window.orderBy(*order))  # over one page
    ranked = first.withColumn("place", place)
    each = ranked.select("place", "is_duplicate", F.explode(F.array(*(F.lit(k) for k in depths))).alias("k")).where(F.col("place") <= F.col("k"))
    return each.groupBy("k").agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("right")).withColumn("precision", F.round(F.col("right") / F.col("n"), 4))


def commit(pairs: DataFrame, relations: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining pairs, relations and deleted items after review actions (a, b, action, detail) (OP-184)."""
    rest = pairs.join(actions.select("a", "b"), ["a", "b"], "left_anti")
    swapped = F.col("detail") == "parent_child_ba"
    kind = F.when(F.col("action") == "non_duplicate", "non_duplicate").when(F.startswith("detail", F.lit("parent_child")), "parent_child").otherwise("sibling")
    made = actions.where(F.col("action").isin("non_duplicate", "related")).select(F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b"), kind.alias("kind"), F.lit("review").alias("source"))
    gone = actions.where(F.col("action").isin("delete_a", "delete_b")).select(F.when(F.col("action") == "delete_a", F.col("a")).otherwise(F.col("b")).alias("item_id"))
    left = relations.join(gone, relations.a == F.col("item_id"), "left_anti").join(gone, F.col("b") == F.col("item_id"), "left_anti")
    fresh = made.join(left, ["a", "b", "kind"], "left_anti").select(*relations.columns)
    return rest, left.unionByName(fresh), gone.distinct()


def replaced(stored: DataFrame, pairs: DataFrame, fresh: DataFrame) -> DataFrame:
    """The stored suggestion rows after a batch was built anew: rows of pairs (a, b) that are no longer there go, those that ``fresh`` has take its place, others stay (OP-270)."""
    key, live = ["a", "b"], pairs.select("a", "b").distinct()
    new = fresh.select(*stored.columns).join(live, key, "left_semi")
    return stored.join(live, key, "left_semi").join(new.select(*key), key, "left_anti").unionByName(new)


def exact_duplicates(rows: DataFrame, content: Column, id_column: str) -> DataFrame:
    """(id, keeper) of rows whose content another row of smaller id holds (OP-186).

    Keepers are a partial aggregate by hash, so a content of very many copies
    never meets in one task.
    """
    hashed = rows.select(F.col(id_column).alias("id"), F.md5(content).alias("h"))
    first = hashed.groupBy("h").agg(F.min("id").alias("keeper"))
    return hashed.join(first, "h").where("id <> keeper").select("id", "keeper")
