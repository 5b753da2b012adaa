"""A corpus from raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each
stage's rows as Parquet in the shared folder and reads them for the next.  All
stages but the last keep the columns of ``documents``, and any others.

Every stage takes null ids, texts and sources, empty and very long texts,
repeated rows and repeated ids, and gives an empty frame for an empty table;
what becomes of such rows stands at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import mixing, near_copies, packing, pii, quality_rules
from tagloom.functions.lineage import Scratch

#: No SQL form: boosted trees, sketches, a tokenizer and a packing heuristic are not SQL expressions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject; null and wordless texts fail the base and go, repeated rows are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the smallest doc_id.

    Texts link at a similarity of 0.8 or more over 5-word shingles: a trie
    self-join of SimHash fingerprints with a wide error budget, then an exact
    check.  Null ids come last in a group, then the least text hash decides; of
    repeated rows one stays; different texts under one id, or without one, are
    different documents; null and wordless texts are alike.
    """
    return near_copies.keep_near(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts, row by row; a null text stays null."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, shorten or drop documents so that sources meet their targets; a null source is one of its own, wordless texts go, repeated rows count each."""
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in packed sequences; a null text is the tail id alone, rows with null or repeated ids are packed like any other."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", mixture),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
