"""Tables that are made once and read by many queries, kept as long as what they were made from stays as it is."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
#: By session, directory and name: the state of the inputs when it was made, and what was made.
_kept: dict[tuple[str, str, str], tuple[tuple[object, ...], object]] = {}


def state_of(spark: SparkSession, paths: list[str]) -> tuple[object, ...]:
    """What tells one state of some tables from another: each file's name, length and time of change."""
    found: list[object] = []
    for path in sorted(paths):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(where):
            found += sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(where))
        else:
            found.append(path)
    return tuple(found)


def kept(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], T]) -> T:
    """What ``make`` gives, made anew when a file of the tables (names in sf_dir) has changed since."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), state_of(spark, [f"{sf_dir}/{t}.parquet" for t in tables])
    if key not in _kept or _kept[key][0] != now:
        _kept[key] = now, make()
    return _kept[key][1]  # type: ignore[return-value]


def forget(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Drop these, or all that is kept of a directory."""
    for key in [k for k in _kept if k[:2] == (spark.sparkContext.applicationId, sf_dir) and (not names or k[2] in names)]:
        del _kept[key]
