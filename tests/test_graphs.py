"""Closures and cycle checks on chains longer than any fixed limit."""

import pytest

from tagloom.operators import graphs, implications, relations

N = 200


@pytest.fixture(scope="module")
def chain(spark):
    return spark.range(N).selectExpr("id AS a", "id + 1 AS b")


def test_reach_has_no_limit(chain):
    got = {(r.a, r.b): r.depth for r in graphs.reach(chain).collect()}
    assert got == {(a, b): b - a for a in range(N + 1) for b in range(a + 1, N + 1)}
    assert graphs.reach(chain, 10).count() == sum(min(10, N - a) for a in range(N))
    assert graphs.reach(chain.limit(0)).count() == 0


def test_reach_on_a_cycle(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 7) for k in range(7)] + [(3, 3)], "a long, b long")
    got = {(r.a, r.b): r.depth for r in graphs.reach(ring).collect()}
    assert got == {(a, b): (b - a) % 7 for a in range(7) for b in range(7) if a != b}


def test_cycle_checks_see_the_whole_chain(spark, chain):
    edges = chain.selectExpr("a", "b", "'parent_child' AS kind", "'manual' AS source")
    asked = spark.createDataFrame([(N, 0), (0, N), (N, N), (150, 3), (5, 900)], "a long, b long")
    got = {(r.a, r.b): r.cycle for r in relations.cycle_checks(edges, asked).collect()}
    assert got == {(N, 0): True, (0, N): False, (N, N): True, (150, 3): True, (5, 900): False}
    assert relations.would_cycle(edges.where("kind = 'sibling'"), 1, 1) and not relations.would_cycle(edges.limit(0), 1, 2)


def test_rules_apply_along_the_whole_chain(spark):
    rules = spark.range(40).selectExpr("concat('t', id) AS source_tag", "concat('t', id + 1) AS implied_tag")
    tags = spark.createDataFrame([(1, "t0"), (2, "t39")], "item_id long, tag string")
    got = {(r.item_id, r.tag) for r in implications.missing_tags(tags, implications.closure(rules)).collect()}
    assert got == {(1, f"t{k}") for k in range(1, 41)} | {(2, "t40")}
    assert implications.makes_cycle(rules, "t40", "t0") and not implications.makes_cycle(rules, "t0", "t40")
    known = spark.createDataFrame([("t1", "artist")], "tag string, category string")
    view = {r.implied_tag: (r.depth, r.category) for r in implications.chain(rules, known).where("source_tag = 't0'").collect()}
    assert view == {f"t{k}": (k, "artist" if k == 1 else "general") for k in range(1, 11)}


def test_components_and_stars_on_a_chain(spark, chain):
    assert {(r.group_id, r.item_id) for r in graphs.connected(chain).collect()} == {(0, k) for k in range(N + 1)}
    assert {(r.group_id, r.item_id) for r in graphs.star_groups(chain.where("a < 6")).collect()} == {(k - k % 2, k) for k in range(7)}
    assert graphs.connected(chain.limit(0)).count() == 0 and graphs.star_groups(chain.limit(0)).count() == 0
