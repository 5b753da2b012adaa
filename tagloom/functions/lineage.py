"""Intermediate tables in the folder that all machines share.

Lineage is cut with written Parquet tables, so a lost executor costs a re-read
and never a recomputation, and plans in loops stay small.  The folder is
spark.checkpoint.dir; where that is unset a temporary one is made, but only on
a local master: on a cluster each executor would write to its own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's estimate up to which a join side is broadcast before anything was measured.
GUESSED_BROADCAST = 64 * 1024
#: Bytes of a measured join side that are broadcast at most, whatever the session allows: the driver holds several times as much, for each join under way.
MAX_MEASURED_BROADCAST = 10 * 1024 * 1024
#: Rows of a counted table of names or weights that are broadcast at most: some 10 MB.
MAX_BROADCAST_ROWS = 100_000
_GUESSED, _MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, SparkSession] = {}
_lock = threading.Lock()
_writers: dict[int, list] = {}


def base_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, else, on a local master, one made for this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def measured_broadcasts(spark: SparkSession) -> None:
    """Join sides of the session are broadcast by their measured size, up to the session's limit or 10 MB, and no longer by a guess.

    The guess is a share of the compressed files, which holds sorted keys many
    times over: 19 million item ids stand for 10 MB and take 544 in the driver.
    """
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit > GUESSED_BROADCAST:
        if spark.conf.get(_MEASURED, None) is None:
            spark.conf.set(_MEASURED, str(min(limit, MAX_MEASURED_BROADCAST)))
        spark.conf.set(_GUESSED, str(GUESSED_BROADCAST))


def small(table: DataFrame, n: int) -> DataFrame:
    """A written table of n short rows to be broadcast where n is small, else dealt like any other."""
    return F.broadcast(table) if n <= MAX_BROADCAST_ROWS else table


def hashed(side: DataFrame) -> DataFrame:
    """The far smaller side of a join, kept as a hash table in each task, so that the larger side is dealt but neither sorted nor spilled."""
    return side.hint("shuffle_hash")


class _ShuffleFilesGo:
    """While any write of a session is under way, shuffle files go once their query is done; then the setting is as before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        with _lock:
            held = _writers.setdefault(id(self.spark), [0, None])
            if not held[0]:
                held[1] = self.spark.conf.get(_CLEANUP, None)
                self.spark.conf.set(_CLEANUP, "true")
            held[0] += 1

    def __exit__(self, *_: object) -> None:
        with _lock:
            held = _writers[id(self.spark)]
            held[0] -= 1
            if not held[0]:
                if held[1] is None:
                    self.spark.conf.unset(_CLEANUP)
                else:
                    self.spark.conf.set(_CLEANUP, held[1])


class Scratch:
    """Tables of one operator call.

    ``save`` writes a frame and returns the table read back; ``drop`` deletes
    tables that later steps no longer read.  What is left goes at exit, since
    the frame that an operator returns still reads it.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{base_dir(spark)}/tagloom/{name}-{uuid.uuid4().hex[:12]}"
        _made[self.root] = spark

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with _ShuffleFilesGo(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counted(self, df: DataFrame, name: str, **sums: object) -> tuple[DataFrame, dict[str, object]]:
        """The table, and aggregates of it taken while it is written; ``n`` is its number of rows."""
        seen = Observation()
        table = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items())), name)
        return table, seen.get

    def together(self, *names: str) -> DataFrame:
        """Several saved tables of one form as one scan, so that a loop's plan does not grow by its rounds."""
        paths = [f"{self.root}/{name}" for name in names]
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for root, spark in list(_made.items()):
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, root)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit; nothing is left to do then
                return
