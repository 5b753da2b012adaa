"""Bounded samples of documents for fitting; the same on every run, whatever ids repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th) of docs (doc_id, text); th is a hash of the text, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def order() -> list:
    """Sampling order of (doc_id, th) rows."""
    return [F.xxhash64("doc_id", "th"), F.col("doc_id"), F.col("th")]


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct (doc_id, th) of rows, in an order by hash; copies fall before the shuffle."""
    return rows.groupBy("doc_id", "th").agg(F.count("*").alias("copies")).orderBy(*order()).limit(most).select("doc_id", "th")


def texts_of_rows(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """(doc_id, th, text) of chosen (doc_id, th), each once."""
    d, p = keyed(docs).alias("d"), picks.alias("p")
    found = d.join(p, (F.col("d.th") == F.col("p.th")) & F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), "left_semi")
    return found.groupBy("doc_id", "th").agg(F.first("text").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, th, text, label) of at most ``most`` different documents that have a label, an id's least label counting.

    Ids are taken in an order by hash, then documents of those ids likewise.
    Both lists are written tables of at most ``most`` rows, so that a plan sees
    how small they are and texts are joined to them where they lie.
    """
    scratch = Scratch(docs.sparkSession, "labelled")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias(label))
    some = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "ids")
    picks = first_rows(keyed(docs).select("doc_id", "th").join(some.select("doc_id"), "doc_id", "left_semi"), most)
    picks = scratch.save(picks, "picks")
    return texts_of_rows(docs, picks).join(some, "doc_id")
