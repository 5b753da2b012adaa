"""Derived tables after random edits against tables built anew."""

import random

import pytest

from tagloom.operators import maintenance

TAGS = [("red", "general"), ("Blue_(sky)", "general"), ("kim", "artist"), ("red", "meta"), ("one two", "meta")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(spark, seed):
    r = random.Random(seed)
    items = {i: f"c{i % 3}/File {i}.png" for i in range(12)}
    tags = {(i, *t) for i in items for t in r.sample(TAGS, r.randint(0, 4))}
    table = lambda: spark.createDataFrame(sorted(tags), "item_id long, tag string, category string")
    listed = lambda: spark.createDataFrame(sorted(items.items()), "item_id long, filepath string")
    derived = maintenance.built(listed(), table())
    for _ in range(2):
        before = table()
        changes = {(r.randrange(14), *r.choice(TAGS)): r.choice(["add", "remove"]) for _ in range(10)}
        frame = spark.createDataFrame([(*k, op) for k, op in changes.items()], "item_id long, tag string, category string, op string")
        gone = r.sample(sorted(items), 2)
        items = {i: p for i, p in items.items() if i not in gone} | {12: "new/twelve.jpg"}
        tags = {t for t in tags | {k for k, op in changes.items() if op == "add"} if changes.get(t) != "remove"}
        after = maintenance.edited(before, frame)
        assert {tuple(x) for x in after.collect()} == tags
        touched = frame.select("item_id").union(spark.createDataFrame([(i,) for i in [*gone, 12]], "item_id long"))
        # tags of items that do not exist take no part in a table that is built
        tags = {t for t in tags if t[0] in items}
        derived = maintenance.maintained(derived, listed(), before, after, touched)
        for got, want in zip(derived, maintenance.built(listed(), table()), strict=True):
            assert rows(got.select(*want.columns)) == rows(want)


def test_scopes(spark):
    before = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y")], "item_id long, tag string, category string")
    after = before.replace({"b": "c"}, subset=["tag"])
    asked = spark.createDataFrame([("b",), ("c",), ("c",)], "tag string")
    assert rows(maintenance.items_of_tags(before, after, asked)) == [(2,)]
    none = maintenance.maintained(maintenance.built(before.limit(0).withColumn("filepath", before.tag), before.limit(0)), before.limit(0).withColumn("filepath", before.tag), before.limit(0), before.limit(0), before.limit(0))
    assert all(t.count() == 0 for t in none)
