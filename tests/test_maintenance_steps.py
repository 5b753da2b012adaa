"""Maintenance jobs: each runs alone, rows of the tag table are moved once, and rows that need work are found."""

from pyspark.sql import functions as F

from tagloom.operators import similarity
from tagloom.plans import jobs
from tagloom.sources.proxies import Catalog


class _Stub:
    def __init__(self, spark, docs):
        self.spark, self._docs = spark, docs
        self.items = spark.createDataFrame([(1,), (2,), (9,)], "item_id long")
        rows = [(1, "rating_general", "general"), (1, "rating:general", "meta"), (2, "rating_explicit", "general"), (2, "rating:safe", "general"), (2, "red", "general"), (7, "red", "general"), (7, "blue", "general"), (None, "red", "general")]
        self.item_tags = spark.createDataFrame(rows, "item_id long, tag string, category string")

    def raw(self, name):
        return self._docs


def test_rows_that_need_work(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "doc_id long, text string")
    got = {r.job: r.n for r in jobs.run_maintenance(_Stub(spark, docs)).collect()}
    assert got == {"recount": 6, "recategorise": 2, "duplicates": 1, "orphans": 3, "without_tags": 1, "pivot": 4}


def test_jobs_are_run_one_by_one(spark, sf_dir):
    """The frame reads six written numbers; a union of all jobs held all their shuffles at a time."""
    assert "Exchange" not in jobs.run_maintenance(Catalog(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()


def test_tuning_pairs_are_found_once(spark, sf_dir):
    pairs = similarity.tuning_pairs(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 3)
    assert "MapInArrow" not in pairs._jdf.queryExecution().executedPlan().toString() and pairs.where(F.col("cosine") <= 0).count() == 0
