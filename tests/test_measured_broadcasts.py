"""What goes through the driver is decided by measured sizes, and tags are moved as numbers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.functions.lineage import GUESSED_BROADCAST, measured_broadcasts
from tagloom.operators import health, rating, similarity
from tagloom.sources.proxies import Catalog

GUESSED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


@pytest.fixture
def limits(spark):
    """The session as its user left it, and so again afterwards."""
    before = {k: spark.conf.get(k, None) for k in (GUESSED, MEASURED)}
    for k in before:
        spark.conf.unset(k)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_small_files_of_many_rows_are_not_broadcast(spark, limits, tmp_path):
    """Two million items and tag rows are a few MB on disk and over 60 in the driver."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS o_orderkey, range % 9 AS o_custkey, 'F' AS o_orderstatus, 1.0 AS o_totalprice, TIMESTAMP '1995-01-01' AS o_orderdate, '2-HIGH' AS o_orderpriority FROM range(2000000)) TO '{tmp_path}/orders.parquet' (COMPRESSION zstd)")
    con.execute(f"COPY (SELECT range AS l_orderkey, range % 3 AS l_partkey, range AS l_suppkey FROM range(200000)) TO '{tmp_path}/lineitem.parquet' (COMPRESSION zstd)")
    con.execute(f"COPY (SELECT range AS p_partkey, 'red gear' AS p_name, 'BOLT' AS p_type, 'Brand#1' AS p_brand FROM range(3)) TO '{tmp_path}/part.parquet'")
    found = health.without_tags(Catalog(spark, str(tmp_path)))
    assert found.count() == 0  # each item has its rating
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    ran = found.agg(F.count("*"))
    ran.collect()
    assert "BroadcastHashJoin" not in ran._jdf.queryExecution().executedPlan().toString()


def test_limits_of_a_session(spark, limits):
    spark.conf.set(GUESSED, "5000000")
    measured_broadcasts(spark)
    measured_broadcasts(spark)
    assert (spark.conf.get(GUESSED), spark.conf.get(MEASURED)) == (str(GUESSED_BROADCAST), "5000000")
    spark.conf.unset(MEASURED)
    spark.conf.set(GUESSED, "-1")
    measured_broadcasts(spark)
    assert spark.conf.get(GUESSED) == "-1" and spark.conf.get(MEASURED, None) is None


def _sent(df):
    """Columns of the exchanges of a plan."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_pair_sums_move_numbers(spark, sf_dir):
    c = Catalog(spark, sf_dir)
    pairs = c.pool_items.where("pool_id < 20").alias("x").join(c.pool_items.alias("y"), "pool_id").where("x.item_id < y.item_id").select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"))
    for by_category in (False, True):
        sums = similarity.pair_sums(c, pairs, by_category)
        assert not [x for x in _sent(sums) if "tag#" in x]
        assert sums.where("inter > own + 1e-9 or inter > other + 1e-9").count() == 0 < sums.where("inter > 0").count()


def test_pairs_of_tags_are_not_sent(spark):
    """Pairs are laid out within an item's row; repeats count as often as they stand there, a null tag takes a place and no weight."""
    found = spark.createDataFrame([(1, 0, t) for t in ("a", "b", "b", "c")] + [(2, 3, t) for t in ("a", "b")] + [(None, 0, "a"), (None, 0, "b"), (3, 1, None)], "item_id long, rating long, tag string")
    got = {(r.tag1, r.tag2): (r.n, r["0"], r["3"]) for r in rating.pair_counts(found, 1, 1).collect()}
    assert got == {("a", "b"): (3, 2, 1), ("a", "c"): (1, 1, 0), ("b", "c"): (2, 2, 0)}
    tags = spark.createDataFrame([(1, None), (1, "a"), (1, "b"), (1, "c"), (1, "c"), (None, "a"), (None, "b")], "item_id long, tag string")
    weights = spark.createDataFrame([("a", 0, 1.0, 1), ("c", 0, 10.0, 1)], "tag string, rating long, weight double, n long")
    pairs = spark.createDataFrame([("a", "b", 0, 100.0, 1), ("b", "c", 0, 1000.0, 1), ("b", "a", 0, 5.0, 1)], "tag1 string, tag2 string, rating long, weight double, n long")
    scored = rating.scores(tags, weights, pairs, 1.0, 3)
    assert not [x for x in _sent(scored) if "k1#" in x or "tag1#" in x]
    assert {r.item_id: r.score for r in scored.where("rating = 0").collect()} == {1: 111.0, None: 1.0}


def test_a_generous_session_does_not_fill_the_driver(spark, limits):
    """Joins of one query are broadcast at the same time, each several times its size in the driver."""
    spark.conf.set(GUESSED, "200m")
    measured_broadcasts(spark)
    assert (spark.conf.get(GUESSED), spark.conf.get(MEASURED)) == (str(GUESSED_BROADCAST), str(10 * 1024 * 1024))
