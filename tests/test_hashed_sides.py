"""The far smaller side of a join is hashed in the tasks, so the tag table is neither sorted nor spilled to meet it."""

import pytest
from pyspark.sql import functions as F

from tagloom.operators import dml, health, search, stats
from tagloom.sources.proxies import Catalog


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None)], "item_id long, tag string")
    return rows, spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (4, "w")], "item_id long, tag string")


def test_children_are_replaced(tables):
    rows, new = tables
    out = dml.replace_children(rows, new, "item_id")
    assert "SortMergeJoin" not in _plan(out) and "ShuffledHashJoin" in _plan(out)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(2, "a"), (None, "a"), (3, None), (1, "x"), (1, "y"), (None, "z"), (4, "w")]))


def test_rows_of_gone_keys_leave(tables):
    rows, gone = tables[0], tables[1].select("item_id")
    for out in (dml.delete_cascade(rows, {"tags": rows}, gone, "item_id")[1]["tags"], health.cleanup({"items": rows.withColumn("filepath", F.lit("p")), "tags": rows}, gone, "delete")[0]["tags"]):
        assert "SortMergeJoin" not in _plan(out) and "ShuffledHashJoin" in _plan(out)
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(2, "a"), (None, "a"), (3, None)]))


def test_the_index_follows_hashed_items(spark, tables):
    """Changed items meet the index and the rows as a hash table, so neither is sorted."""
    tags, changed = tables[0], spark.createDataFrame([(1,), (5,), (None,)], "item_id long")
    items = spark.createDataFrame([(1, "x/new.png"), (2, "y.jpg")], "item_id long, filepath string")
    index = spark.createDataFrame([("old", 1, "path"), ("a", 1, "tag"), ("y", 2, "path"), ("gone", 5, "tag"), ("n", None, "tag")], "word string, item_id long, field string")
    out = search.index_updated(index, items, tags, changed)
    assert "SortMergeJoin" not in _plan(out) and _plan(out).count("ShuffledHashJoin") == 3
    want = [("y", 2, "path"), ("n", None, "tag"), ("x", 1, "path"), ("new", 1, "path"), ("png", 1, "path"), ("a", 1, "tag"), ("b", 1, "tag")]
    assert sorted(map(str, map(tuple, out.select("word", "item_id", "field").collect()))) == sorted(map(str, want))


def test_predictions_of_holders(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    out = stats.prediction_crossref(c.predictions, c.item_tags, "red", 0.45, 5)
    assert "SortMergeJoin" not in _plan(out) and "BroadcastHashJoin" not in _plan(out) and _plan(out).count("ShuffledHashJoin") == 2
