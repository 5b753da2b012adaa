"""Life cycles on small hand-made tables, with nulls, repeats, malformed metadata and empty tables."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.operators import deltas, detail, dml, graphs, rating, rebuild, relations, rules, search, similarity
from tagloom.plans.jobs import Jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


RAW = [
    (1, json.dumps({"sources": {"a": {"id": 5, "rating": "E", "tag_string_general": "x  y", "tag_string_character": "x"}, "b": {"tags": {"general": ["z"], "species": ["y"]}, "rating": "g"}}})),
    (2, json.dumps({"sources": {"c": {"tags": "p q rating_safe rating_general"}}})), (3, "{bad"), (4, None), (5, json.dumps({"sources": {}})),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, "item_id long, data string")


def test_rebuild_and_merge(spark, raw):
    made = rebuild.rebuild(raw, ["b", "a"])
    assert rows(made) == [(1, "rating:general", "meta"), (1, "y", "species"), (1, "z", "general"), (2, "p", "general"), (2, "q", "general"), (2, "rating:general", "meta"), (2, "rating_safe", "general")]
    both = rows(rebuild.rebuild(raw, ["b", "a"], merged=True).where("item_id = 1"))
    assert both == [(1, "rating:explicit", "meta"), (1, "x", "character"), (1, "y", "species"), (1, "z", "general")]
    log = spark.createDataFrame([(1, "z", "general", "remove"), (1, "w", "meta", "add"), (1, "y", "general", "add")], "item_id long, tag string, category string, op string")
    assert rows(rebuild.rebuild(raw, ["b"], log).where("item_id = 1")) == [(1, "rating:general", "meta"), (1, "w", "meta"), (1, "y", "species")]
    assert rebuild.rebuild(raw.where("false"), ["a"]).count() == 0


def test_switch_merge_and_revert(spark, raw):
    tags = rebuild.rebuild(raw, ["a"])
    chosen = spark.createDataFrame([(1, "b"), (2, "nowhere"), (9, "b")], "item_id long, source string")
    after = rebuild.switch_source(tags, raw, chosen)
    assert rows(after.where("item_id = 1")) == [(1, "rating:general", "meta"), (1, "y", "species"), (1, "z", "general")] and rows(after.where("item_id = 2")) == rows(tags.where("item_id = 2"))
    active = spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "item_id long, active_source string")
    merged, now = rebuild.apply_merged(tags, active, raw)
    assert rows(now) == [(1, "merged"), (2, "c"), (3, None)] and merged.where("item_id = 1").count() == 4
    back, again = rebuild.revert_merged(merged, now, raw, ["a"])
    assert rows(back) == rows(tags) and rows(again) == rows(active)
    assert rows(rebuild.revert_merged(merged, now, raw, ["z"])[1]) == rows(now)  # no source of the list: it stays merged


def test_priority_is_applied_once(raw):
    tags = rebuild.rebuild(raw, ["a"])
    same, stored, changed = rebuild.apply_priority(tags, raw, ["a", "b"], None)
    assert not changed and rows(same) == rows(tags)
    assert not rebuild.apply_priority(tags, raw, ["a", "b"], stored)[2] and rebuild.apply_priority(tags, raw, ["a", "b"], stored, version=2)[2]
    new, _, changed = rebuild.apply_priority(tags, raw, ["b", "a"], stored)
    assert changed and rows(new) == rows(rebuild.rebuild(raw, ["b", "a"]))


def test_details_and_related(spark, raw):
    items = spark.createDataFrame([(1, "p1", None, "m1", 5, None), (2, "p2", "local_tagger", "m2", 6, 5), (3, "p3", None, "m3", 7, 99)], "item_id long, filepath string, active_source string, md5 string, post_id long, parent_id long")
    tags = spark.createDataFrame([(1, "b", "general"), (1, "a", "meta")], "item_id long, tag string, category string")
    assert rows(detail.details(items, tags, raw, ["b", "a"])) == [(1, "p1", "a b", "b", "a,b"), (2, "p2", "", "local_tagger", "c"), (3, "p3", "", None, "")]
    predicted = spark.createDataFrame([(1, "b", "general", 0.9), (1, "n", "general", 0.8), (1, "low", "general", 0.1), (1, "c", "artist", 0.9), (2, "n", "general", 0.9)], "item_id long, tag string, category string, confidence double")
    assert rows(detail.merged_general(items, tags, predicted)) == [(1, "n")]
    cross = spark.createDataFrame([(99, "m1")], "post_id long, md5 string")
    assert rows(detail.related(items, cross)) == [(1, 2, "child"), (1, 3, "child"), (2, 1, "parent"), (3, 1, "parent")]


def test_rule_life(spark):
    tags = spark.createDataFrame([("s", "character"), ("t", "general"), ("u", "meta"), ("v", "general")], "tag string, category string")
    none = spark.createDataFrame([], "source_tag string, implied_tag string, inference_type string, confidence double, status string")
    pairs = spark.createDataFrame([("s", "t"), ("s", "t"), ("t", "u"), ("u", "u"), ("s", "nothing")], "source_tag string, implied_tag string")
    made = rules.manual(none, pairs, tags)
    assert rows(made.select("source_tag", "implied_tag")) == [("s", "t"), ("t", "u")] and rows(rules.manual(made, pairs, tags)) == rows(made)
    assert [tuple(r)[:4] for r in rules.listed(made, tags).collect()] == [("s", "character", "t", "general"), ("t", "general", "u", "meta")]
    facts = spark.createDataFrame([(1, "s", "character", "original"), (1, "v", "general", "implication"), (2, "t", "general", "user")], "item_id long, tag string, category string, source string")
    now, counts = rules.reapplied(facts, made, tags)
    assert rows(now.where("source = 'implication'")) == [(1, "t", "general", "implication"), (1, "u", "meta", "implication"), (2, "u", "meta", "implication")]
    assert tuple(counts.first()) == (1, 2, 3, 2)
    assert rows(rules.reapplied(now, made, tags)[0]) == rows(now)  # idempotent
    assert rows(rules.applied(rules.cleared(now), rules.deleted(made, pairs.limit(1)), tags).where("source = 'implication'")) == [(2, "u", "meta", "implication")]
    assert rules.deleted(made).count() == 0
    found = rules.suggestions(made.select("source_tag", "implied_tag", "confidence"), made.limit(0).select("source_tag", "implied_tag", "confidence"), tags)
    assert rules.filtered(found, "S").count() == 1 and rules.filtered(found, source_categories=["!character"]).count() == 1 and rules.filtered(found, pattern="correlation").count() == 0 and rules.filtered(found, implied_categories=["all"]).count() == 2
    assert rules.page(found, 2, 1).first().source_tag == "t" and tuple(rules.summary(found, 1).first()) == (2, 2, 0, 2)


def test_manual_relations(spark):
    items = spark.range(1, 8).withColumnRenamed("id", "item_id")
    edges = spark.createDataFrame([(1, 2, "parent_child", "backfill"), (2, 3, "parent_child", "manual")], "a long, b long, kind string, source string")
    view = spark.createDataFrame([(1, 3, "parent"), (4, 1, "parent"), (4, 4, "sibling"), (5, 4, "sibling"), (6, 99, "child"), (2, 1, "parent"), (7, 1, "friend")], "item_id long, other long, role string")
    after = relations.create_manual(edges, items, view)
    assert rows(after.where("source = 'manual'").select("a", "b", "kind")) == [(1, 4, "parent_child"), (2, 3, "parent_child"), (4, 5, "sibling")]
    asked = spark.createDataFrame([(3, 1), (1, 1), (1, 2), (2, 1), (9, 1), (1, 7)], "a long, b long")
    assert dict(((r.a, r.b), r.problem) for r in relations.manual_checks(edges, items, asked).collect()) == {(3, 1): "cycle", (1, 1): "self", (1, 2): "exists", (2, 1): "mutual", (9, 1): "unknown item", (1, 7): None}
    assert relations.delete_edges(after, spark.createDataFrame([(5, 4)], "a long, b long")).count() == after.count() - 1
    assert tuple(relations.add_counted(edges, edges.unionByName(edges)).first()) == (0, 4)


def test_rating_life(spark):
    facts = spark.createDataFrame([(1, "rating:general", "meta", "user"), (1, "rating-source:user", "meta", "user"), (1, "x", "general", "original"), (2, "rating:explicit", "meta", "ai_inference")], "item_id long, tag string, category string, source string")
    chosen = spark.createDataFrame([(1, "rating:sensitive"), (2, None), (3, "rating:general")], "item_id long, rating string")
    after = rating.set_ratings(facts, chosen, "ai_inference")
    assert rows(after) == [(1, "rating-source:ai-inference", "meta", "ai_inference"), (1, "rating:sensitive", "meta", "ai_inference"), (1, "x", "general", "original"), (3, "rating-source:ai-inference", "meta", "ai_inference"), (3, "rating:general", "meta", "ai_inference")]
    assert rows(rating.rating_changes(facts, chosen)) == [(1, "rating:general", "remove"), (1, "rating:sensitive", "add"), (3, "rating:general", "add")]
    own = rating.Config().updated("threshold_general", 0.9)
    assert rating.config_from(own.table(facts)) == own and own.thresholds[0] == 0.9
    with pytest.raises(KeyError):
        own.updated("unknown", 1)
    assert rating.retrain_and_reapply(facts.select("item_id").distinct(), facts) is None
    many = spark.createDataFrame([(1, f"t{k:03}") for k in range(130)], "item_id long, tag string")
    weights = spark.createDataFrame([("t000", 0, 1.0, 1)], "tag string, rating long, weight double, n long")
    late = spark.createDataFrame([("t001", "t120", 0, 2.0, 1), ("t001", "t002", 0, 4.0, 1)], "tag1 string, tag2 string, rating long, weight double, n long")
    score = lambda **k: rating.scores(many, weights, late, **k).where("rating = 0").first().score
    assert score() == 7.0 and score(max_pair_tags=None) == 10.0


def walk(ops):
    state = 0
    for o in ops:
        s = 1 if o == "add" else -1
        state = s if state in (0, s) else 0
    return {1: "add", -1: "remove", 0: None}[state]


def last_two(ops):
    state = None
    for o in ops:
        state = "add" if o == "add" else None if state == "add" else "remove"
    return state


@pytest.mark.parametrize("seed", range(3))
def test_folds_equal_loops(spark, seed):
    """Histories over several spans of time, with ties in time."""
    import datetime as dt
    import random

    rng, log, want = random.Random(seed), [], {}
    for key in range(120):
        times = sorted(dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(0, 90, 3)) for _ in range(rng.randrange(1, 14)))
        ops = [rng.choice(("add", "remove")) for _ in times]
        log += [(len(log) + k, str(key), "t", o, t) for k, (o, t) in enumerate(zip(ops, times, strict=True))]
        want[str(key)] = (walk(ops), last_two(ops))
    df = spark.createDataFrame(log, "id long, md5 string, tag string, op string, ts timestamp").repartition(5)
    assert {r.md5: r.op for r in deltas.compacted(df).collect()} == {k: a for k, (a, _) in want.items() if a}
    assert {r.md5: r.op for r in deltas.net_state(df).collect()} == {k: b for k, (_, b) in want.items() if b}
    assert deltas.compacted(df.limit(0)).count() == deltas.net_state(df.limit(0)).count() == 0


def test_numbers_follow_the_order(spark):
    names = spark.createDataFrame([(f"n{k:04}",) for k in range(500)] + [(None,), ("n0001",)], "name string").repartition(9)
    keys = dml.surrogate_keys(names)
    assert rows(keys) == [(f"n{k:04}", k + 1) for k in range(500)]
    more = dml.surrogate_keys(spark.createDataFrame([("a",), ("zz",), ("n0003",)], "name string"), keys)
    assert {r.name: r.key for r in more.collect() if r.key > 500} == {"a": 501, "zz": 502}


def test_items_go_in_whole_or_not_at_all(spark):
    have = {"items": spark.createDataFrame([(1, "m1", "p1")], "item_id long, md5 string, filepath string"), "tags": spark.createDataFrame([(1, "t")], "item_id long, tag string")}
    new = {"items": spark.createDataFrame([(2, "m2", "p2"), (3, "m1", "p3"), (4, "m4", "p1"), (1, "m5", "p5"), (6, "m6", "p6"), (7, "m6", "p7")], have["items"].schema), "tags": spark.createDataFrame([(k, "n") for k in range(1, 8)], have["tags"].schema)}
    tables, outcome = dml.insert_items(have, new)
    good = {r.item_id for r in outcome.collect() if r.inserted}
    assert 2 in good and len(good) == 2 and good < {2, 6, 7} and {r.item_id for r in tables["tags"].where("tag = 'n'").collect()} == good


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    v[7], v[8] = 0, v[9]  # a zero vector, a tie
    data = [(int(i), x.tolist()) for i, x in enumerate(v)] + [(100, None), (101, [1.0, 2.0]), (102, [2.0, 4.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for r in similarity.neighbour_cache(df, 4, rows=7 * similarity.BLOCK).collect():
        got.setdefault(r.source_id, []).append((r.rank, r.similar_id, r.score))
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in data if x and np.linalg.norm(x)}
    for i, x in unit.items():
        s = sorted((-float(np.sign(d) * np.floor(abs(d) * 1e5 + 0.5) / 1e5), j) for j, y in unit.items() if j != i and len(y) == len(x) for d in [float(x @ y)])[:4]
        assert [(k, j) for k, j, _ in sorted(got[i])] == [(k + 1, j) for k, (_, j) in enumerate(s)] and [c for _, _, c in sorted(got[i])] == pytest.approx([-c for c, _ in s], abs=1e-5)
    assert set(got) == set(unit) and similarity.neighbour_cache(df.limit(0)).count() == 0


def test_equal_signatures_are_compared_once(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(25)]
    values = base + base[:10] + [b ^ 1 for b in base[:8]] + [b ^ 0xFFF for b in base[5:9]]
    df = spark.createDataFrame([(k, x & 0xFFFFFFFF, x >> 32) for k, x in enumerate(values)], "item_id long, w0 long, w1 long")
    for t in (3, 20):
        want = [(i, j, d) for i in range(len(values)) for j in range(i + 1, len(values)) if (d := (values[i] ^ values[j]).bit_count()) <= t]
        assert rows(similarity.hamming_pairs(df, t)) == sorted(want, key=repr)
        assert rows(similarity.hamming_pairs(df, t, rows=5 * similarity.BLOCK)) == sorted(want, key=repr)
        assert rows(similarity.signature_groups(df, t)) == rows(graphs.connected(spark.createDataFrame(want, "a long, b long, d int")).select("group_id", "item_id"))


def test_index_ranks_and_updates(spark):
    items = spark.createDataFrame([(1, "red/Bolt_12.png"), (2, "x/y.jpg"), (3, "z")], "item_id long, filepath string")
    tags = spark.createDataFrame([(1, "big_(thing)", "general"), (2, "red", "general"), (3, "redder", "general")], "item_id long, tag string, category string")
    index = search.text_index(items, tags)
    assert [r.item_id for r in search.index_search(index, ["red"]).collect()] == [1, 2] and [r.item_id for r in search.index_search(index, [], ["red"]).collect()] == [3, 1, 2]
    assert [r.item_id for r in search.index_search(index, ["BIG", "png"]).collect()] == [1] and search.index_search(index, []).count() == 0
    gone = search.index_updated(index, items.where("item_id <> 1"), tags.where("item_id <> 1"), items.where("item_id = 1").select("item_id"))
    assert gone.where("item_id = 1").count() == 0 and gone.count() == index.where("item_id <> 1").count()


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(C.id_in_name(F.lit("131010854_p0.png"))) == 131010854 == one(C.id_in_name(F.lit("site-131010854.jpg"))) == one(C.id_in_name(F.lit("131010854.png"))) and one(C.id_in_name(F.lit("12.png"))) is None
    assert one(C.short_name(F.lit("a.png"))) == "a.png" and one(F.octet_length(C.short_name(F.lit("é" * 300 + ".png")))) <= 200 and one(C.short_name(F.lit("é" * 300 + ".png"))).endswith(".png")
    C.register(spark)
    assert spark.sql("SELECT natural_sort_key('Page12b3')").first()[0] == one(C.natural_key(F.lit("Page12b3"))) == "page000000000012b000000000003"


def test_jobs(spark):
    jobs, ended, gate = Jobs(spark), [], threading.Event()
    jobs.on_end(lambda key, job: ended.append((job.name, job.status)))
    good = jobs.start("count", lambda s: s.range(100).count())
    assert jobs.wait(good, 60).result == 100 and jobs.get(good).status == "completed"
    bad = jobs.wait(jobs.start("fault", lambda s: s.sql("SELECT no_such").count()), 60)
    assert bad.status == "failed" and "no_such" in bad.error
    slow = jobs.start("slow", lambda s: (gate.set(), s.range(10**13).selectExpr("sum(id % 7)").collect()))
    assert gate.wait(60)
    import time

    while not jobs.get(slow).done.is_set():  # its Spark job may not have begun at the first call
        jobs.cancel(slow)
        time.sleep(0.2)
    assert jobs.get(slow).status == "cancelled" and ended == [("count", "completed"), ("fault", "failed"), ("slow", "cancelled")]
    assert [n for _, n, _ in jobs.listed()] == ["count", "fault", "slow"]
