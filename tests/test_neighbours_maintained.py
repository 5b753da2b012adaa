"""Neighbour caches after edits of vectors against caches made anew."""

import numpy as np
import pytest

from tagloom.operators import similarity

SCHEMA = "vec_id long, embedding array<double>"


def rows(df):
    return sorted((r.source_id, r["rank"], r.similar_id, r.score) for r in df.collect())


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in sorted(vectors.items())], SCHEMA)


def ids(spark, values):
    return spark.createDataFrame([(i,) for i in values], "item_id long")


@pytest.mark.parametrize("block", [7, 1000])
def test_edits_as_made_anew(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = np.random.default_rng(block)
    draw = lambda d=3: r.integers(-2, 3, d).astype(float).tolist()  # noqa: E731  many equal scores
    vectors = {i: draw() for i in range(40)} | {i: draw(2) for i in range(100, 104)} | {200: None, 201: [0.0, 0.0, 0.0]}
    cache = similarity.neighbour_cache(frame(spark, vectors), 4)
    for change in ({3: draw(), 9: None, 11: draw(2), 50: draw(), 201: draw()}, {i: None for i in range(12, 30)}, {100: "gone", 7: "gone", 60: draw(2)}):
        vectors = {i: v for i, v in (vectors | change).items() if v != "gone"}
        cache = similarity.neighbours_maintained(cache, frame(spark, vectors), ids(spark, [*change, *change]), 4)
        assert rows(cache) == rows(similarity.neighbour_cache(frame(spark, vectors), 4))


def test_nothing_changed_and_nothing_there(spark):
    vectors = {i: [1.0, float(i)] for i in range(9)}
    cache = similarity.neighbour_cache(frame(spark, vectors), 3)
    assert rows(similarity.neighbours_maintained(cache, frame(spark, vectors), ids(spark, []), 3)) == rows(cache)
    none = similarity.neighbours_maintained(cache, frame(spark, {}), ids(spark, vectors), 3)
    assert rows(none) == []
    assert rows(similarity.neighbours_maintained(none, frame(spark, vectors), ids(spark, vectors), 3)) == rows(cache)


def test_few_sources_meet_all(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 5)
    r = np.random.default_rng(1)
    vectors = frame(spark, {i: r.normal(size=4).tolist() for i in range(23)})
    some = similarity.neighbour_cache(vectors, 5, sources=ids(spark, [2, 2, 19, 77]))
    assert rows(some) == [x for x in rows(similarity.neighbour_cache(vectors, 5)) if x[0] in (2, 19)]
