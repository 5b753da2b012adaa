"""The word index under search, what is kept and made anew, and refreshed tables."""

import shutil

import pytest
from pyspark.sql import functions as F

from tagloom.operators import detail, merge, search
from tagloom.sources.kept import kept
from tagloom.sources.proxies import Catalog, grams_of

WORDS = ["olt", "widg", "ord_1", "c1", ".png", "red", "_(", "zzz", "d_7", "ord_12", "economy", "o"]


@pytest.mark.parametrize("word", WORDS)
def test_parts_of_words_as_by_a_scan(spark, sf_dir, word):
    c = Catalog(spark, sf_dir)
    tagged = c.item_tags.where(F.contains(F.lower("tag"), F.lit(word))).select("item_id")
    named = c.items.where(F.contains(F.lower("filepath"), F.lit(word))).select("item_id")
    want = {r.item_id for r in tagged.union(named).distinct().collect()}
    got = [r.item_id for r in search.with_part(c.items, c, word).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_conditions_on_words_reach_the_scan(spark, sf_dir):
    plan = search.search(Catalog(spark, sf_dir), "red widg -gear")._jdf.queryExecution().executedPlan().toString()
    assert sum("PushedFilters" in line and "In(gram, [idg,wid])" in line for line in plan.splitlines()) == 2
    assert "EqualTo(word,gear)" in plan and "word" in plan


def test_runs_of_characters(spark):
    rows = spark.createDataFrame([("abcabc",), ("ab",), ("",), (None,), ("äöü",)], "t string").select("t", grams_of(F.col("t")).alias("g")).collect()
    assert {r.t: r.g for r in rows} == {"abcabc": ["abc", "bca", "cab"], "ab": [], "": [], None: [], "äöü": ["äöü"]}


def test_tables_are_made_anew_when_their_files_change(spark, sf_dir, tmp_path):
    for name in ("orders", "lineitem", "part"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path / f"{name}.parquet")
    c = Catalog(spark, str(tmp_path))
    before = c.item_tags.count()
    made = []
    assert c.kept("x", lambda: made.append(1) or 7) == 7 and c.kept("x", lambda: made.append(1) or 8) == 7 and len(made) == 1
    half = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0")
    half.write.parquet(str(tmp_path / "half"))
    (tmp_path / "orders.parquet").unlink()
    shutil.move(tmp_path / "half", tmp_path / "orders.parquet")
    after = Catalog(spark, str(tmp_path)).item_tags
    assert 0 < after.count() < before and after.where("category = 'meta' and item_id % 2 = 1").count() == 0
    assert c.kept("x", lambda: 9) == 9
    c.refresh()
    assert kept(spark, str(tmp_path), "x", (), lambda: 10) == 10


def test_refreshed_rows_come_and_go(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "item_id long, tag string")
    fresh = spark.createDataFrame([("z", 1), ("q", 9), ("no", 3)], "tag string, item_id long")
    changed = spark.createDataFrame([(1,), (2,), (9,), (9,)], "item_id long")
    assert sorted(map(tuple, detail.refreshed(rows, fresh, changed).collect())) == [(1, "z"), (3, "d"), (9, "q")]
    assert detail.refreshed(rows, fresh.limit(0), changed).collect() == [(3, "d")]


def test_tags_in_a_list(spark):
    data = '{"sources": {"g": {"tags": ["red", "blue x", "rating_safe"]}, "h": {"tags": []}, "i": {"tags": "[odd"}, "j": {"tags": "red [blue]"}}}'
    got = {(r.source, r.category, r.tag) for r in merge.extract_tags(spark.createDataFrame([(1, data)], "item_id long, data string")).collect()}
    assert {g for g in got if g[0] == "g"} >= {("g", "general", "red"), ("g", "general", "blue"), ("g", "general", "x")} and not any(set(t) & set('"],') for s, _, t in got if s == "g")
    assert {g for g in got if g[0] in "hj"} == {("j", "general", "red"), ("j", "general", "[blue]")}


def test_word_index_moves_names_by_item_alone(spark):
    """One exchange for each kind of name, none of words; rows are distinct though names, items and words repeat or are null."""
    items = spark.createDataFrame([(1, "c1/Red.png"), (1, "c1/Red.png"), (1, "c2/x"), (2, None), (None, "c1/y")], "item_id long, filepath string")
    tags = spark.createDataFrame([(1, "Red"), (1, "red"), (1, "red_(gear)"), (1, "red_(gear)"), (2, None), (2, ""), (None, "a b")], "item_id long, tag string")
    index = search.text_index(items, tags)
    moved = [line for line in index._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and not [line for line in moved if "word#" in line]
    assert sorted(map(tuple, index.collect()), key=repr) == sorted(
        [(w, 1, "path") for w in ("c1", "c2", "png", "red", "x")] + [(w, None, "path") for w in ("c1", "y")] + [(w, 1, "tag") for w in ("gear", "red", "red_(gear)")] + [("", 2, "tag")] + [(w, None, "tag") for w in ("a", "a b", "b")], key=repr
    )
