"""Nearest ranks, reachability and greedy groups against plain loops, and how many rounds long chains take."""

import random
from collections import defaultdict

import pytest

from tagloom.functions.lineage import Scratch
from tagloom.operators import graphs, ingest, selection


@pytest.mark.parametrize("parts", ["1", "7"])
def test_nearest_ranks(spark, parts):
    r = random.Random(3)
    rows = [("big", r.randint(0, 400)) for _ in range(3000)] + [("same", 5)] * 100 + [("one", 1), (None, 3), (None, 4), ("nothing", None), ("big", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x.g: tuple(x)[1:] for x in ingest.quantiles(spark.createDataFrame(rows, "g string, v long"), "g", "v").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = defaultdict(list)
    for g, v in rows:
        if v is not None:
            want[g].append(v)
    assert got == {g: (len(v), *(sorted(v)[round((len(v) - 1) * q)] for q in (0, 0.25, 0.5, 0.75, 1)), round(sum(v) / len(v), 6)) for g, v in want.items()}
    assert ingest.quantiles(spark.createDataFrame([], "g string, v long"), "g", "v").count() == 0


def test_a_million_equal_rows_are_one_value(spark):
    rows = spark.range(1_000_000).selectExpr("'g' AS g", "CASE WHEN id < 400000 THEN 1 ELSE 2 END AS v")
    got = selection.ranked_values(rows, "g", "v", {"p39": 0.39, "p41": 0.41}).first()
    assert (got.n, got.p39, got.p41) == (1_000_000, 1, 2)


@pytest.fixture
def rounds(monkeypatch):
    """Tables that were counted while they were written: one for each round of a loop."""
    seen, save = [], Scratch.save_counted
    monkeypatch.setattr(Scratch, "save_counted", lambda self, df, name, **sums: (seen.append(name), save(self, df, name, **sums))[1])
    return seen


def test_cycle_checks_on_a_chain_of_ten_thousand(spark, rounds):
    n = 10_000
    chain = spark.range(n).selectExpr("id AS a", "id + 1 AS b")
    asked = [(n, 0), (0, n), (9000, 17), (17, 9000), (5, 5), (n + 5, 3)]
    got = {(r.a, r.b): r.cycle for r in graphs.would_close(chain, spark.createDataFrame(asked, "a long, b long")).collect()}
    assert got == {(n, 0): True, (0, n): False, (9000, 17): True, (17, 9000): False, (5, 5): True, (n + 5, 3): False}
    assert len([x for x in rounds if x.startswith("on-")]) < 20 and len(rounds) < 40


@pytest.mark.parametrize("seed", range(4))
def test_cycle_checks_on_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = {(r.randrange(n), r.randrange(n)) for _ in range((20, 35, 50, 80)[seed])} | {(100 + k, 100 + (k + 1) % 6) for k in range(6)} | {(3, 100)}
    asked = {(r.randrange(n), r.randrange(n)) for _ in range(15)} | {(100, 3), (103, 101)}
    ahead = defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)

    def leads(x, y):
        seen, stack = set(), [x]
        while stack:
            for z in ahead[stack.pop()] - seen:
                seen.add(z)
                stack.append(z)
        return y in seen

    got = {(x.a, x.b): x.cycle for x in graphs.would_close(spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame(sorted(asked), "a long, b long")).collect()}
    assert got == {(a, b): a == b or leads(b, a) for a, b in asked}


def greedy(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    group = {}
    for i in sorted(near):
        if i not in group:
            group[i] = i
            group |= {j: i for j in near[i] if j not in group}
    return {(g, i) for i, g in group.items()}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_groups_of_random_pairs(spark, seed):
    r = random.Random(seed)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range((20, 45, 120)[seed])})
    got = {tuple(x) for x in graphs.star_groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == greedy(pairs)


def test_greedy_groups_on_a_chain_of_ten_thousand(spark, rounds):
    n = 10_000
    got = graphs.star_groups(spark.range(n).selectExpr("id AS a", "id + 1 AS b"))
    assert got.where("group_id <> item_id - item_id % 2").count() == 0 and got.count() == n + 1
    assert len(rounds) < 20
