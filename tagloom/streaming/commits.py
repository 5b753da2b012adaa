"""Arriving files into the catalog exactly once: staged, published, entered in a ledger (OP-248, OP-250, OP-251).

A batch passes six stages: its paths are told apart, its contents hashed, those
that the catalog holds set aside, those that arrive twice given to one path,
rows made, and all of it published at once.  What a batch writes lies in one
folder, named by its number and moved into place in one step; a batch counts
once the ledger has its mark.  So a batch that is run again, or was cut off at
any point, leaves what one run leaves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.streaming.ingest import outcomes

ITEMS = "md5 string, path string"
OUTCOMES = "path string, md5 string, outcome string"


class Ledger:
    """A folder of published batches: ``batches/<n>/items``, ``batches/<n>/outcomes`` and ``marks/<n>``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the batches that count."""
        marks = self._path("marks")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(marks)) if self._files.exists(marks) else []

    def _read(self, kind: str, schema: str, but: int | None = None) -> DataFrame:
        paths = [f"{self.root}/batches/{n}/{kind}" for n in self.committed() if n != but]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def items(self, but: int | None = None) -> DataFrame:
        """(md5, path) of the catalog, without one batch if asked for."""
        return self._read("items", ITEMS, but)

    def outcomes(self) -> DataFrame:
        """(path, md5, outcome) of all arrivals of the batches that count."""
        return self._read("outcomes", OUTCOMES)

    def arrive(self, batch: DataFrame, number: int, after_stage: Callable[[str], None] = lambda stage: None) -> None:
        """One batch of arrivals (path, md5), md5 null where a file could not be read; a batch that counts already is left as it is.

        after_stage: called with "staged", "published" and "marked", for tests
        that cut a run off there.  The catalog's own rows of this number are not
        looked at, so a second run judges as the first did.
        """
        if number in self.committed():
            return
        staged, place = f"staged/{number}", f"batches/{number}"
        judged = outcomes(batch, self.items(but=number)).select("path", "md5", "outcome")
        judged.write.mode("overwrite").parquet(f"{self.root}/{staged}/outcomes")
        kept = self.spark.read.schema(OUTCOMES).parquet(f"{self.root}/{staged}/outcomes").where("outcome = 'success'")
        kept.select("md5", "path").write.mode("overwrite").parquet(f"{self.root}/{staged}/items")
        after_stage("staged")
        self._files.delete(self._path(place), True)  # of a run that was cut off before its mark
        self._files.mkdirs(self._path("batches"))
        if not self._files.rename(self._path(staged), self._path(place)):
            raise OSError(f"{self.root}/{staged} could not be moved to {place}")
        after_stage("published")
        self._files.mkdirs(self._path("marks"))
        self._files.create(self._path(f"marks/{number}"), True).close()
        after_stage("marked")

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Every batch that a stream of arrivals (path, md5) has to give now."""
        stream.writeStream.foreachBatch(self.arrive).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def folder_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, path, was) between two listings (path, md5) of a folder: created, moved, changed, removed; an unread file (md5 null) moves nowhere (OP-248).

    A file moved if its content was at a path that is gone; of several such
    paths and places the first of each by name belong together, and so on.
    """
    old, new = before.select(F.col("path").alias("was"), F.col("md5").alias("old")), after.select("path", "md5")
    both = new.join(old, new.path == old.was, "full_outer")
    changed = both.where("path is not null and was is not null and not (md5 <=> old)").select(F.lit("changed").alias("kind"), "path", "was")
    came, went = both.where("was is null").select("path", "md5"), both.where("path is null").select("was", F.col("old").alias("md5"))
    place = lambda rows, name: rows.withColumn("k", F.row_number().over(Window.partitionBy("md5").orderBy(name)))
    moved = place(came.where("md5 is not null"), "path").join(place(went.where("md5 is not null"), "was"), ["md5", "k"]).select(F.lit("moved").alias("kind"), "path", "was")
    none = F.lit(None).cast("string")
    created = came.join(moved, "path", "left_anti").select(F.lit("created").alias("kind"), "path", none.alias("was"))
    removed = went.join(moved, "was", "left_anti").select(F.lit("removed").alias("kind"), none.alias("path"), "was")
    return changed.unionByName(moved).unionByName(created).unionByName(removed)
