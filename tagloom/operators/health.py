"""Integrity checks and their repairs (OP-143 to OP-149, OP-247)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.constants import VIDEO_EXTENSIONS
from tagloom.functions.lineage import hashed
from tagloom.operators.merge import primary_source
from tagloom.sources.proxies import Catalog


def null_source(c: Catalog, priority: Sequence[str]) -> DataFrame:
    """(item_id, source): items without an active source and the one they should have (OP-143)."""
    return c.items.where("active_source is null").select("item_id").join(primary_source(c.item_sources, priority), "item_id")


def wrong_priority(c: Catalog, priority: Sequence[str]) -> DataFrame:
    """(item_id, active_source, expected) of items of several sources that use another than the first (OP-144)."""
    several = c.item_sources.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id")
    best = primary_source(c.item_sources, priority).withColumnRenamed("source", "expected")
    return c.items.select("item_id", "active_source").join(several, "item_id", "left_semi").join(best, "item_id").where("active_source <> expected")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the parents (OP-145, OP-075)."""
    return children.join(parents, key, "left_anti")


def without_tags(c: Catalog) -> DataFrame:
    """Items without any tag row (OP-146)."""
    return c.items.join(c.item_tags, "item_id", "left_anti").select("item_id")


def broken_items(c: Catalog, embeddings: DataFrame, dim: int) -> DataFrame:
    """(item_id, issues, n): what each item lacks: tags, a sound vector, or, unless a video, an upscaled version's hash (OP-119, OP-147)."""
    video = F.lower("filepath").rlike(r"\.(" + "|".join(VIDEO_EXTENSIONS) + ")$")
    issue = lambda df, name: df.select("item_id", F.lit(name).alias("issue"))
    sound = embeddings.where(F.size("embedding") == dim).select(F.col("vec_id").alias("item_id"))
    found = issue(without_tags(c), "no_tags").unionByName(issue(c.items.join(sound, "item_id", "left_anti"), "no_embedding")).unionByName(issue(c.items.where(F.col("upscaled_width").isNull() & ~video), "no_hash"))
    return found.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("issue")), ",").alias("issues"), F.countDistinct("issue").alias("n"))


def without_artefact(items: DataFrame, files: DataFrame, prefix: str, extension: str) -> DataFrame:
    """(item_id, expected) of items whose derived file, such as a preview, is not among the files (path) (OP-247)."""
    stem = F.regexp_replace(F.col("filepath"), r"\.[^./]+$", "")
    wanted = items.select("item_id", F.concat(F.lit(prefix.rstrip("/") + "/"), stem, F.lit(extension)).alias("expected"))
    return wanted.join(files.select(F.col("path").alias("expected")), "expected", "left_anti").select("item_id", "expected")


def cleanup(tables: dict[str, DataFrame], broken: DataFrame, action: str, embeddings: str = "embeddings") -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, work) after an action on broken items (item_id), which must be named (OP-148).

    delete: their rows leave every table, and work names their files to take in
    again; retry: only their vectors leave, and work names the items to process
    anew; scan: nothing changes.  ``tables`` holds ``items`` and any child tables.
    """
    paths = tables["items"].join(broken, "item_id", "left_semi").select("item_id", "filepath")
    if action == "scan":
        return tables, paths
    if action not in ("delete", "retry"):
        raise ValueError(action)
    gone = tables if action == "delete" else {k: v for k, v in tables.items() if k == embeddings}
    return tables | {k: v.join(hashed(broken), "item_id", "left_anti") for k, v in gone.items()}, paths


def run_checks(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, found, passed) of named frames of faults (OP-149)."""
    out: DataFrame | None = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found", (F.col("found") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    assert out is not None, "no checks"
    return out
