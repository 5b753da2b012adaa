"""Tags as integers and bits against plain sets."""

import random

import pytest

from tagloom.operators import coded


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def held():
    r = random.Random(4)
    ids = [*range(-70, 70), 2**40, 2**40 + 63, -(2**40)]
    return {w: set(r.sample(ids, n)) for w, n in [("a", 90), ("b", 60), ("c", 30), ("d", 2)]} | {"all": set(ids)}


@pytest.fixture(scope="module")
def postings(spark, held):
    pairs = [(w, i) for w, ids in held.items() for i in ids]
    return spark.createDataFrame([*pairs, *pairs[:9], (None, 1), ("a", None)], "word string, item_id long")


CASES = [(["a"], []), (["a", "b"], []), (["a", "b", "a"], ["c"]), (["a"], ["a"]), (["all"], ["b", "c", "none"]), (["a", "none"], []), ([], ["a"]), ([], ["none"]), ([], ["a", "b", "d"]), ([], []), (["d", "all"], ["a"])]


@pytest.mark.parametrize(("every", "none"), CASES)
def test_conditions_as_sets(spark, held, postings, every, none):
    bits = coded.tag_bits(postings)
    want = set(held["all"])
    for w in every:
        want &= held.get(w, set())
    for w in none:
        want -= held.get(w, set())
    items = spark.createDataFrame([(i, -1, "x") for i in sorted(held["all"])], "item_id long, run long, bits string")
    got = coded.with_words(items, bits, every, none)
    assert got.columns == items.columns and sorted(r.item_id for r in got.collect()) == sorted(want)
    if every:
        found = coded.combined(bits, every, none)
        assert sorted(r.item_id for r in coded.items_of(found).collect()) == sorted(want)
        assert coded.counted(found).first().n == len(want)
    else:
        with pytest.raises(ValueError):
            coded.combined(bits, every, none)


def test_updated_bits_are_those_made_anew(spark, postings):
    bits = coded.tag_bits(postings)
    changed = [-70, -1, 5, 69, 2**40, 999]
    after = postings.where("item_id not in (-70, -1, 5, 69)").unionByName(spark.createDataFrame([("b", 5), ("new", 999)], "word string, item_id long"))
    frame = spark.createDataFrame([(i,) for i in [*changed, 5]], "item_id long")
    assert rows(coded.bits_updated(bits, after, frame)) == rows(coded.tag_bits(after))
    assert rows(coded.bits_updated(bits, postings, frame.limit(0))) == rows(bits)
    empty = postings.limit(0)
    assert coded.tag_bits(empty).count() == 0 and rows(coded.bits_updated(coded.tag_bits(empty), postings, postings.select("item_id").where("item_id is not null"))) == rows(bits)


def test_dictionary_and_round_trip(spark):
    tags = spark.createDataFrame([(1, "Red", "x"), (1, "red", "y"), (1, "blue", "x"), (2, "über", "x"), (3, None, "x")], "item_id long, tag string, category string")
    d = coded.tag_dictionary(tags)
    assert rows(d) == [("blue", 1), ("red", 2), ("über", 3)]
    assert rows(coded.coded_items(tags, d)) == [(1, [1, 2]), (2, [3])]
    assert rows(coded.decoded_items(coded.coded_items(tags, d), d)) == [(1, "blue"), (1, "red"), (2, "über")]
    more = coded.tag_dictionary(tags.unionByName(tags.replace("blue", "abc", "tag")), d)
    assert rows(more) == [("abc", 4), ("blue", 1), ("red", 2), ("über", 3)]
    assert coded.tag_dictionary(tags.limit(0)).count() == 0
