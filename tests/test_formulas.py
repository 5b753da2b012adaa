"""Hand-computed values of the formulas, and their laws."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.operators import graphs, deltas, dml, implications, merge, rating, relations, review, similarity


def one(spark, column, **values):
    names = list(values)
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_jaccard(spark):
    arr = lambda s: F.array(*map(F.lit, s.split())) if s else F.array().cast("array<string>")
    assert one(spark, C.jaccard(arr("a b c"), arr("b c d"))) == 0.5
    assert one(spark, C.jaccard(arr(""), arr("a"))) == 0.0


def test_scores(spark):
    # weights a=1, b=2, c=3; "a b" against "b c"
    args = [F.lit(x) for x in (2.0, 3.0, 5.0)]
    assert one(spark, similarity.score("weighted", *args)) == pytest.approx(2 / 6)
    assert one(spark, similarity.score("asymmetric", *args)) == pytest.approx(0.6 * 2 / 3 + 0.4 * 2 / 6)


def test_hamming(spark):
    assert one(spark, C.hamming_hex(F.lit("00000000000000ff"), F.lit("000000000000000f"))) == 4
    assert one(spark, C.hamming_hex(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64
    assert one(spark, C.hamming_hex(F.lit("bad"), F.lit("000000000000000f"))) == 64
    assert one(spark, C.hash_score(F.lit(64), 256)) == 0.75
    score, distance = C.hybrid_score(F.lit(0.75), F.lit(None).cast("double"), 0.0)
    assert one(spark, distance) == 16.0


def test_registered_functions(spark):
    C.register(spark)
    r = spark.sql("SELECT hamming_hex64('00000000000000ff', '000000000000000f') a, tag_jaccard(array('a','b'), array('b','c')) b, hash_bucket('x') c").first()
    assert (r.a, round(r.b, 6), len(r.c)) == (4, 0.333333, 3)


def test_small_functions(spark):
    assert one(spark, C.natural_key(F.lit("img12b2"))) < one(spark, C.natural_key(F.lit("img12b10")))
    assert one(spark, C.natural_key(F.lit("img2"))) < one(spark, C.natural_key(F.lit("img10")))
    assert one(spark, C.normal_rating(F.lit("rating_explicit"))) == "rating:explicit"
    assert one(spark, C.plain_path(F.lit("/Images/a/b.png"))) == "a/b.png"
    assert one(spark, C.nearest_rank(F.array(*map(F.lit, (4.0, 1.0, 3.0, 2.0))), 0.5)) == 3.0
    assert one(spark, C.words(F.lit("  A  b "))) == ["a", "b"]


def test_llr(spark):
    # N_r = 2 of N = 4; in 2 of r and 1 of the rest
    assert one(spark, rating.llr(F.lit(2), F.lit(2), F.lit(3), F.lit(4))) == pytest.approx(math.log(1 / 0.5))
    assert one(spark, rating.llr(F.lit(0), F.lit(2), F.lit(1), F.lit(4))) == pytest.approx(-22.332704, abs=1e-6)


def test_softmax_tie_is_first_and_null(spark):
    scores = spark.createDataFrame([(1, r, 0.0) for r in range(4)], "item_id long, rating int, score double")
    got = rating.decide(rating.softmax(scores)).first()
    assert (got.rating, got.confidence) == (None, 0.25)
    sure = spark.createDataFrame([(1, 0, 5.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)], "item_id long, rating int, score double")
    assert rating.decide(rating.softmax(sure)).first().rating == "rating:general"


def test_provenance_is_no_feature(spark):
    tags = spark.createDataFrame([(1, "rating:general"), (1, "rating:explicit"), (1, "rating-source:user"), (1, "red")], "item_id long, tag string")
    rated = rating.rated_items(tags)
    assert rows(rated) == [(1, 0)]
    assert [r.tag for r in rating.features(tags, rated).collect()] == ["red"]


def test_metadata_adjustment(spark):
    raw = review.adjustment(F.lit(0.5), F.lit(1.0), F.lit(0.0))
    assert one(spark, raw) == pytest.approx(0.010)
    assert one(spark, review.guarded(raw, F.lit(0.0), F.lit(0.0))) == pytest.approx(0.0015)
    assert one(spark, review.guarded(raw, F.lit(0.02), F.lit(0.0))) == pytest.approx(0.010)


@pytest.mark.parametrize(("signal", "name", "sure"), [(0.012, "likely_duplicate", 0.0), (0.026, "uncertain", 1.0), (0.04, "likely_variation", 0.0)])
def test_label(spark, signal, name, sure):
    label, confidence = review.label(F.lit(signal), *review.bounds())
    assert one(spark, label) == name
    assert one(spark, confidence) == pytest.approx(sure, abs=1e-9)


def test_bounds():
    assert review.bounds() == (0.012, 0.04)
    assert review.bounds(0.5, 0.2) == (0.5, 0.55)
    assert review.bounds(-1, 9) == (0.0, 1.0)


def test_closure_and_cycle(spark):
    rules = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source_tag string, implied_tag string")
    assert rows(implications.closure(rules)) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)]
    tags = spark.createDataFrame([(1, "a", "general")], "item_id long, tag string, category string")
    assert rows(implications.missing_tags(tags, implications.closure(rules))) == [(1, "b"), (1, "c")]
    dims = spark.createDataFrame([("b", "artist")], "tag string, category string")
    once = implications.apply_rules(tags, rules, dims)
    assert rows(implications.apply_rules(once, rules, dims)) == rows(once)  # idempotent
    assert implications.makes_cycle(rules.limit(2), "c", "a") and not implications.makes_cycle(rules.limit(1), "a", "c")


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "parent_child", "m"), (2, 3, "parent_child", "m")], "a long, b long, kind string, source string")
    assert relations.would_cycle(edges, 3, 1) and not relations.would_cycle(edges, 1, 3)
    new = spark.createDataFrame([(5, 4, "sibling", "m"), (1, 2, "parent_child", "m"), (7, 7, "sibling", "m")], edges.schema)
    assert (4, 5, "sibling", "m") in rows(relations.add_edges(edges, new)) and relations.add_edges(edges, new).count() == 3


def test_components_follow_chains_and_stars_do_not(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    assert rows(similarity.duplicate_groups(pairs)) == [(1, 1), (1, 2), (1, 3), (1, 4), (8, 8), (8, 9)]
    assert rows(graphs.star_groups(pairs)) == [(1, 1), (1, 2), (3, 3), (3, 4), (8, 8), (8, 9)]


def test_banded_pairs_equal_grid(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base]
    df = spark.createDataFrame([(i, v & 0xFFFFFFFF, v >> 32) for i, v in enumerate(values)], "item_id long, w0 long, w1 long")
    want = sorted((i, j, (values[i] ^ values[j]).bit_count()) for i in range(60) for j in range(i + 1, 60) if (values[i] ^ values[j]).bit_count() <= 5)
    assert rows(similarity.hamming_pairs(df, 5)) == want
    assert [r for r in rows(similarity.hamming_pairs(df, 8, rows=9000)) if r[2] <= 5] == want


def log(spark, ops):
    return spark.createDataFrame([(i, "m", "t", op, i) for i, op in enumerate(ops)], "id long, md5 string, tag string, op string, ts long")


@pytest.mark.parametrize(
    ("ops", "net", "compact"),
    [(["add", "remove"], [], []), (["remove", "add"], ["add"], []), (["add"], ["add"], ["add"]), (["remove", "remove"], ["remove"], ["remove"]), (["add", "remove", "remove"], ["remove"], ["remove"])],
)
def test_folds(spark, ops, net, compact):
    df = log(spark, ops)
    assert [r.op for r in deltas.net_state(df).collect()] == net
    assert [r.op for r in deltas.compacted(df).collect()] == compact


def test_diff_then_apply_is_identity(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b")], "item_id long, tag string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "item_id long, tag string")
    d = deltas.diff(old, new)
    facts = old.select(F.col("item_id").cast("string").alias("md5"), "tag")
    changes = d.select(F.lit(1).alias("id"), F.col("item_id").cast("string").alias("md5"), "tag", "op", F.lit(0).alias("ts"))
    assert rows(deltas.replay(facts, changes)) == [("1", "b"), ("2", "c")]


def test_merge_and_dedupe(spark):
    both = spark.createDataFrame([(1, "x", "general"), (1, "x", "character"), (1, "a", "general")], "item_id long, tag string, category string")
    assert rows(merge.merge_categories(both)) == [(1, "a", "general"), (1, "x", "character")]
    assert rows(merge.dedupe_general(both)) == [(1, "a", "general"), (1, "x", "character")]
    assert rows(merge.from_category_columns(merge.category_columns(both))) == rows(both)


def test_extract_tags(spark):
    data = '{"sources": {"d": {"tag_string_general": "c d", "tag_string_artist": "z", "rating": "q", "score": 4}, "e": {"tags": {"species": ["x"], "general": ["c"]}, "score": {"total": 7}}, "g": {"tags": "m rating_general"}}}'
    raw = spark.createDataFrame([(1, data), (2, "{bad"), (3, None)], "item_id long, data string")
    assert rows(merge.extract_tags(raw)) == sorted(
        [(1, "d", "artist", "z"), (1, "d", "general", "c"), (1, "d", "general", "d"), (1, "e", "general", "c"), (1, "e", "species", "x"), (1, "g", "general", "m"), (1, "g", "general", "rating:general")]
    )
    assert rows(merge.extract_rating(raw)) == [(1, "d", "rating:questionable")]
    assert [r.s for r in raw.select(merge.score_of(F.col("data"), ["d", "e"]).alias("s")).collect()] == [4, None, None]
    assert [r.s for r in raw.select(merge.score_of(F.col("data"), ["e", "d"]).alias("s")).collect()] == [7, None, None]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    n = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows(dml.upsert(t, n, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(dml.insert_ignore(t, n, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(dml.toggle(t, n, "k")) == [(1,), (3,)]
    p = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "pool_id long, item_id long, sort_order long")
    moved = {r.item_id: r.sort_order for r in dml.reorder(p, 1, 2, 4).collect()}
    assert moved == {1: 1, 2: 4, 3: 2, 4: 3, 5: 5}
    back = {r.item_id: r.sort_order for r in dml.reorder(p, 1, 4, 2).collect()}
    assert back == {1: 1, 2: 3, 3: 4, 4: 2, 5: 5}
    keys = dml.surrogate_keys(spark.createDataFrame([("b",), ("a",), ("c",)], "name string"), spark.createDataFrame([("c", 7)], "name string, key long"))
    assert rows(keys) == [("a", 8), ("b", 9), ("c", 7)]


def test_commit_actions(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    edges = spark.createDataFrame([(1, 9, "sibling", "m")], "a long, b long, kind string, source string")
    actions = spark.createDataFrame([(1, 2, "delete_a", ""), (3, 4, "related", "parent_child_ba")], "a long, b long, action string, detail string")
    rest, left, gone = review.commit(pairs, edges, actions)
    assert rows(rest) == [(5, 6)] and rows(left) == [(4, 3, "parent_child", "review")] and rows(gone) == [(1,)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.sampled_from("abcde"), max_size=5, unique=True), b=st.lists(st.sampled_from("abcde"), max_size=5, unique=True))
def test_jaccard_is_symmetric(spark, a, b):
    arr = lambda s: F.array(*map(F.lit, s)) if s else F.array().cast("array<string>")
    x, y = one(spark, C.jaccard(arr(a), arr(b))), one(spark, C.jaccard(arr(b), arr(a)))
    assert x == y == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0.0)
