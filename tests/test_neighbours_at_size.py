"""Neighbours of many vectors: few copies are sent, what a task holds is bounded, and lists equal those of plain loops."""

import numpy as np
import pytest

from tagloom.operators import similarity
from tagloom.plans import lifecycles, registry
from tagloom.sources.proxies import Catalog


def frame(spark, v, kind="float"):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], f"vec_id long, embedding array<{kind}>")


def dealt(df):
    """Rows that each exchange of a plan was given, the query once run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_vectors_are_not_sent_once_per_block(spark):
    """As many as 720,000 vectors are dealt, by their number, to a few tens of tasks; it was 700 copies of each."""
    n = 300
    sent = dealt(similarity.neighbour_cache(frame(spark, np.random.default_rng(2).normal(size=(n, 64))), 3, rows=720_000))
    assert 0 < max(sent) <= 40 * n


@pytest.mark.parametrize("cores", [6, 1000])
@pytest.mark.parametrize("k", [3, 50])
def test_grid(cores, k):
    for n in (1, 2000, 120_000, 720_000, 5_000_000):
        down, across = similarity._grid(n, n, 64, k, cores)
        assert -(-n // down) <= 65_536 and down * across <= max(3 * cores, 2 * -(-n // 65_536))
        assert down * across >= min(cores, (n // similarity.BLOCK) ** 2)


@pytest.mark.parametrize("k", [1, 4])
def test_streams_equal_plain_loops(spark, monkeypatch, k):
    """Small blocks, many equal scores, copies of one vector, repeated ids, and vectors that have no direction."""
    for name, value in {"BLOCK": 40, "PRODUCT_ROWS": 7, "PRODUCT_COLUMNS": 16, "WAITING": 50}.items():
        monkeypatch.setattr(similarity, name, value)
    r = np.random.default_rng(k)
    v = r.integers(-2, 3, (150, 6)).astype(float)
    v[40:90] = v[40]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 6), (300, [0.0] * 6), (301, [float("nan")] * 6), (302, [float("inf")] + [1.0] * 5), (303, None), (5, [1.0] + [0.0] * 5)]
    got = sorted((x.source_id, x["rank"], x.similar_id, x.score) for x in similarity.neighbour_cache(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k).collect())
    unit = [(i, np.array(x) / np.linalg.norm(x)) for i, x in data if i is not None and i < 300 and np.linalg.norm(x)]
    want = []
    for i in sorted({i for i, _ in unit}):
        s = sorted((-float(np.sign(d) * np.floor(abs(d) * 1e5 + 0.5) / 1e5) + 0.0, j) for h, x in unit if h == i for j, y in unit if j != i for d in [float(x @ y)])[:k]
        want += [(i, place, j, -x) for place, (x, j) in enumerate(s, 1)]
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-9)


@pytest.mark.parametrize("name", ["neighbours_read", "neighbours_replaced", "neighbours_cleared", "neighbours_stats"])
def test_cache_is_made_once(spark, sf_dir, name):
    """What reads a neighbour cache reads a written one, which holds all vectors' lists; vectors are not compared again for each use."""
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert lifecycles._cache(Catalog(spark, sf_dir), 3).select("source_id").distinct().count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_edits_read_the_cache_once(spark, sf_dir):
    """Lists before an edit are needed three times, and vectors are compared with changed ones and for short lists alone."""
    cache = lifecycles._cache(Catalog(spark, sf_dir), 6)
    assert "MapInArrow" not in cache._jdf.queryExecution().executedPlan().toString()
