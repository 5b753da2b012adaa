"""Pairs of tags are counted and weighed on arrays, with the results of plain loops, whatever is held at a time."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import rating


@pytest.fixture
def little(monkeypatch):
    for name, value in {"PAIRS_AT_ONCE": 20, "COUNTS_HELD": 30, "MAX_DENSE": 100}.items():
        monkeypatch.setattr(rating, name, value)


def _draw(seed, n=60, width=14):
    r = np.random.default_rng(seed)
    return {i: (int(r.integers(0, 5)), sorted({f"t{x}" for x in r.integers(0, 25, r.integers(0, width))})) for i in range(n)}


def test_counts_equal_plain_loops(spark, little):
    own = _draw(3)
    found = spark.createDataFrame([(i, k if k < 4 else None, t) for i, (k, ts) in own.items() for t in ts], "item_id long, rating long, tag string")
    frequent = {t for t, n in Counter(t for _, ts in own.values() for t in ts).items() if n >= 5}
    want = Counter((a, b, k) for k, ts in own.values() for a, b in combinations([t for t in ts if t in frequent], 2))
    total = Counter()
    for (a, b, _), n in want.items():
        total[a, b] += n
    for limit in (None, 9):
        counts = rating.pair_counts(found, 5, 3, limit)
        assert " explode(" not in counts._jdf.queryExecution().optimizedPlan().toString()  # a row per pair and item was made and grouped
        got = {(r.tag1, r.tag2): (r.n, *(r[str(k)] for k in range(4))) for r in counts.collect()}
        kept = sorted(((p, n) for p, n in total.items() if n >= 3), key=lambda x: (-x[1], x[0]))[:limit]
        assert got == {p: (n, *(want[*p, k] for k in range(4))) for p, n in kept}


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("most", [4, None])
def test_scores_equal_plain_loops(spark, little, monkeypatch, dense, most):
    monkeypatch.setattr(rating, "MAX_DENSE", 10_000 if dense else 1)
    own, r = _draw(5), np.random.default_rng(9)
    tag_w = {(f"t{x}", k): float(r.normal()) for x in range(0, 25, 3) for k in range(4) if (x + k) % 5}
    pair_w = {(a, b, k): float(r.normal()) for a, b in combinations(sorted(f"t{x}" for x in range(20)), 2) for k in range(4) if r.random() < 0.2}
    tags = spark.createDataFrame([(i, t) for i, (_, ts) in own.items() for t in ts], "item_id long, tag string")
    weights = spark.createDataFrame([(*x, w, 1) for x, w in tag_w.items()], "tag string, rating long, weight double, n long")
    pairs = spark.createDataFrame([(*x, w, 1) for x, w in pair_w.items()], "tag1 string, tag2 string, rating long, weight double, n long")
    want = {}
    for i, (_, ts) in own.items():
        met = [[tag_w.get((t, k)) for k in range(4)] for t in ts] + [[1.5 * w if (w := pair_w.get((a, b, k))) is not None else None for k in range(4)] for a, b in combinations(ts[:most], 2)]
        if any(x is not None for m in met for x in m):
            want |= {(i, k): sum(m[k] or 0 for m in met) for k in range(4)}
    for many in (False, True):  # more weights than are broadcast meet the pairs in a join
        monkeypatch.setattr(rating, "MAX_LOOKED_UP", 0 if many else 100_000)
        scored = rating.scores(tags, weights, pairs, 1.5, most)
        assert (" explode(" in scored._jdf.queryExecution().analyzed().toString()) == many
        assert {(x.item_id, x.rating): x.score for x in scored.collect()} == pytest.approx(want)


def test_model_is_trained_once(spark):
    """Scores read the model three times; its pairs were counted anew for each."""
    tags = spark.range(80).select(F.col("id").alias("item_id"), F.explode(F.array(F.lit("a"), F.lit("b"), F.when(F.col("id") % 2 == 0, "rating:general").otherwise("rating:explicit"))).alias("tag"))
    for w in rating.train(tags):
        assert "Aggregate" not in w._jdf.queryExecution().optimizedPlan().toString()
