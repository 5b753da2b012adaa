"""File sources and sinks (OP-012 to OP-018, OP-023, OP-279, OP-280)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.columns import plain_path


def scan_files(spark: SparkSession, path: str, extensions: Sequence[str], content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, md5]) of files of some extensions below a folder (OP-012).

    Content is read only where its hash is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*(e.lower().lstrip(".") for e in extensions)))
    return wanted.select("path", "length", "modificationTime", F.md5("content").alias("md5")) if content else wanted.select("path", "length", "modificationTime")


def unprocessed(files: DataFrame, items: DataFrame, name: Column | None = None) -> DataFrame:
    """Files neither known by path nor by content, one per content (OP-013)."""
    named = files.withColumn("filepath", plain_path(F.col("path")) if name is None else name)
    fresh = named.join(items.select("filepath"), "filepath", "left_anti").join(items.select("md5"), "md5", "left_anti")
    return fresh.groupBy("md5").agg(F.min("filepath").alias("filepath"))


def missing_files(items: DataFrame, files: DataFrame) -> DataFrame:
    """(item_id, filepath) of items whose file is not on disk: catalog minus disk (OP-117)."""
    return items.join(files.select(plain_path(F.col("path")).alias("filepath")), "filepath", "left_anti").select("item_id", "filepath")


def oversized(files: DataFrame, most_bytes: int) -> DataFrame:
    """Derived files over a size, to be made anew (OP-266)."""
    return files.where(F.col("length") > most_bytes).select("path", "length")


def compact(df: DataFrame, path: str, files: int, by: str | None = None) -> None:
    """A table rewritten as so many files, rows of near values of a column together: what reindexing and vacuuming are to Parquet (OP-246)."""
    dealt = df.repartition(files) if by is None else df.repartitionByRange(files, by).sortWithinPartitions(by)
    dealt.write.mode("overwrite").parquet(path)


def metadata_index(spark: SparkSession, path: str) -> DataFrame:
    """(md5, path) of JSON files, the last path by name for each hash (OP-014)."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.md5").alias("md5"), F.input_file_name().alias("path"))
    return raw.where("md5 is not null").groupBy("md5").agg(F.max("path").alias("path"))


def tag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, count, aliases) of a CSV without header: name, kind, count, aliases (OP-015)."""
    rows = spark.read.csv(path, schema="tag string, kind string, count long, aliases string")
    return rows.select("tag", "count", F.filter(F.split(F.coalesce("aliases", F.lit("")), ","), lambda a: a != "").alias("aliases"))


def new_tags(dictionary: DataFrame, existing: DataFrame, limit: int) -> DataFrame:
    """The commonest dictionary tags that are not there yet (OP-015)."""
    return dictionary.join(existing.select("tag"), "tag", "left_anti").orderBy(F.desc("count"), "tag").limit(limit)


def with_aliases(labelled: DataFrame, done: DataFrame) -> DataFrame:
    """(tag, category): labels for tags and their aliases, those already done left out (OP-279)."""
    spread = labelled.select(F.explode(F.concat(F.array("tag"), "aliases")).alias("tag"), "category")
    return spread.join(done.select("tag"), "tag", "left_anti").groupBy("tag").agg(F.min("category").alias("category"))


def other_format(files: DataFrame, target: str) -> DataFrame:
    """Files of another extension than the target (OP-280)."""
    return files.where(F.lower(F.substring_index("path", ".", -1)) != target.lower().lstrip("."))


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines sink (OP-016, OP-017)."""
    df.write.mode("append" if append else "overwrite").json(path)


def save_model(tag_weights: DataFrame, pair_weights: DataFrame, path: str) -> None:
    """Classifier tables as compressed Parquet (OP-018)."""
    tag_weights.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/tags")
    pair_weights.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/pairs")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables that ``save_model`` wrote (OP-018, OP-193)."""
    return spark.read.parquet(f"{path}/tags"), spark.read.parquet(f"{path}/pairs")


def model_info(tag_weights: DataFrame, pair_weights: DataFrame) -> DataFrame:
    """(tags, pairs) in a model (OP-018)."""
    return tag_weights.agg(F.count("*").alias("tags")).join(F.broadcast(pair_weights.agg(F.count("*").alias("pairs"))), F.lit(True))  # one row each


def random_page(items: DataFrame, n: int, seed: int) -> DataFrame:
    """n items in an order fixed by the seed (OP-023, OP-112)."""
    return items.orderBy(F.md5(F.concat(F.col("item_id").cast("string"), F.lit(f"|{seed}"))), "item_id").limit(n)
