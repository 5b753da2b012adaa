"""The tag table as words of 64 items: what searches ask for, and its rows on awkward tables."""

import shutil

import duckdb
import pytest

from tagloom.functions import lineage
from tagloom.operators import coded, search
from tagloom.plans.oracle import sql
from tagloom.sources import kept, proxies
from tagloom.sources.proxies import Catalog
from tests.oracle import connect, same


@pytest.mark.parametrize("query", ["metadata:missing", "has:video", "filename:ord_12", "has:pool"])
def test_searches_without_tags_make_no_tag_table(spark, sf_dir, query, monkeypatch):
    monkeypatch.setattr(Catalog, "_bridge", property(lambda c: pytest.fail("tag table made")))
    monkeypatch.setattr(Catalog, "tag_bits", property(lambda c: pytest.fail("bits made")))
    assert search.search(Catalog(spark, sf_dir), query).count() > 0


def test_whole_tags_are_searched_without_a_row_per_item_and_tag(spark, sf_dir, tmp_path):
    for name in ("orders", "lineitem", "part"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    assert search.search(Catalog(spark, str(tmp_path)), "red -gear").count() > 0
    assert {k[2] for k in kept._kept if k[1] == str(tmp_path)} == {"tag-runs"}


def test_rows_on_awkward_tables(spark, tmp_path):
    """Repeats, ids below zero, items without lines, lines without items, null ids and names, a word of two categories, priorities without a rating."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (1, '1-URGENT'), (1, '1-URGENT'), (2, '0-NONE'), (3, NULL), (4, '5-LOW'), (-5, '4-X'), (1000000, '2-HIGH')) t(o_orderkey, o_orderpriority)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 1), (1, 1), (1, 2), (-5, 2), (-64, 3), (63, 3), (64, 4), (NULL, 1), (7, NULL), (8, 99), (9, 5)) t(l_orderkey, l_partkey)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 'red gear', 'BOLT', 'Brand#1'), (2, 'bolt red', 'RED', 'Brand#2'), (2, 'Bolt red', 'RED', 'Brand#2'), (3, 'red red', 'Red', 'red'), (4, NULL, 'BOLT', NULL), (NULL, 'no part', 'X', 'Y')) t(p_partkey, p_name, p_type, p_brand)) TO '{tmp_path}/part.parquet'")
    c, con = Catalog(spark, str(tmp_path)), connect(tmp_path)
    assert same(c.item_tags, con, sql("SELECT item_id, tag, category FROM item_tags")) > 20
    bits = {(r.word, r.item_id) for r in coded.laid_out(c.tag_bits).collect()}
    assert bits == set(con.execute(sql("SELECT DISTINCT lower(tag), item_id FROM item_tags WHERE tag IS NOT NULL AND item_id IS NOT NULL")).fetchall())
    assert c.tag_bits.groupBy("word", "run").count().where("count > 1").count() == 0


def _dealt(plan):
    """The columns of each exchange by a given number of partitions."""
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    own = [sorted(plan.output().apply(k).name() for k in range(plan.output().size()))] if plan.nodeName() == "RepartitionByExpression" else []
    return own + [x for p in below for x in _dealt(p)]


def test_a_line_is_dealt_with_the_number_of_its_kind_alone(spark, sf_dir):
    made = Catalog(spark, sf_dir).derived_tag_runs()
    assert _dealt(made._jdf.queryExecution().optimizedPlan()) == [["item_id", "kind_id", "run"]]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("ShuffledHashJoin") == 1


@pytest.mark.parametrize("most", [0, 3000])
def test_rows_where_kinds_or_names_are_too_many_to_broadcast(spark, tmp_path, sf_dir, most, monkeypatch):
    for name in ("orders", "lineitem", "part"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    for module in (lineage, proxies):
        monkeypatch.setattr(module, "MAX_BROADCAST_ROWS", most)
    c = Catalog(spark, str(tmp_path))
    assert same(c.item_tags, connect(tmp_path), sql("SELECT item_id, tag, category FROM item_tags")) > 1000
