import datetime as dt
import json

from pyspark.sql import functions as F

from tagloom.operators import rating
from tagloom.sources import files
from tagloom.sources.proxies import Catalog
from tagloom.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_scan_and_content_dedupe(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, body in (("a.png", "1"), ("sub/b.PNG", "1"), ("c.jpg", "2"), ("d.txt", "3")):
        (tmp_path / "in" / name).write_text(body)
    found = files.scan_files(spark, str(tmp_path / "in"), [".png", "jpg"], content=True)
    assert found.count() == 3
    items = spark.createDataFrame([("x", "c81e728d9d4c2f636f067f89cc14862c")], "filepath string, md5 string")  # of "2"
    assert files.unprocessed(found, items).count() == 1
    assert files.other_format(files.scan_files(spark, str(tmp_path / "in"), ["png", "jpg"]), "jpg").count() == 2


def test_dictionary_and_index(spark, tmp_path):
    (tmp_path / "t.csv").write_text('red,0,5,"crimson,scarlet"\nblue,0,9,\ngreen,0,2,\n')
    d = files.tag_dictionary(spark, str(tmp_path / "t.csv"))
    have = spark.createDataFrame([("blue",)], "tag string")
    assert [r.tag for r in files.new_tags(d, have, 1).collect()] == ["red"]
    labelled = d.where("tag = 'red'").select("tag", "aliases", F.lit("general").alias("category"))
    assert rows(files.with_aliases(labelled, have)) == [("crimson", "general"), ("red", "general"), ("scarlet", "general")]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps({"md5": "m"}))
    (tmp_path / "j/b.json").write_text(json.dumps({"md5": "m"}))
    assert files.metadata_index(spark, str(tmp_path / "j")).first().path.endswith("b.json")


def test_model_round_trip(spark, sf_dir, tmp_path):
    tags, pairs = rating.train(Catalog(spark, sf_dir).item_tags)
    files.save_model(tags, pairs, str(tmp_path / "m"))
    t, p = files.load_model(spark, str(tmp_path / "m"))
    assert t.count() == tags.count()
    assert files.model_info(t, p).first().tags == t.count()


def test_json_sink_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    files.write_json(df, str(tmp_path / "o"))
    files.write_json(df, str(tmp_path / "o"), append=True)
    assert spark.read.json(str(tmp_path / "o")).count() == 2


def test_random_page_is_stable(spark):
    df = spark.range(100).withColumnRenamed("id", "item_id")
    a, b = (files.random_page(df, 10, 5).collect() for _ in range(2))
    assert a == b and a != files.random_page(df, 10, 6).collect()


def _stream(spark, path, rows_, schema):
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(path))
    return ingest.event_stream(spark, str(path), schema)


def test_debounce_drops_quick_repeats(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [("a", t), ("a", t + dt.timedelta(seconds=1)), ("b", t)]
    s = _stream(spark, tmp_path / "s", events, "path string, ts timestamp")
    assert ingest.drain(ingest.debounced(s, ["path"])).count() == 2


def test_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [(1, t), (1, t + dt.timedelta(minutes=1)), (1, t + dt.timedelta(hours=1)), (2, t), (9, t + dt.timedelta(days=9))]
    s = _stream(spark, tmp_path / "s", events, "user_id long, ts timestamp")
    got = ingest.drain(ingest.session_counts(s, "ts", "10 minutes", "user_id"))
    assert sorted((r.user_id, r.n) for r in got.collect() if r.user_id < 9) == [(1, 1), (1, 2), (2, 1)]


def test_limiter_matches_a_loop(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    events = [(u, t + dt.timedelta(seconds=s)) for u in (1, 2) for s in range(0, 90, u)]
    s = _stream(spark, tmp_path / "s", events, "user_id long, ts timestamp")
    got = {r.user_id: (r.seen, r.allowed) for r in ingest.drain(ingest.adaptive_limiter(s, start=10), "update", ["user_id"]).collect()}
    for u in (1, 2):
        limit, stamps, allowed = 10, [], 0
        for x in range(0, 90, u):
            stamps = [y for y in stamps if y > x - 30]
            if len(stamps) < limit:
                stamps.append(x)
                allowed += 1
                if len(stamps) * 2 < limit:
                    limit = min(limit + 1, 10)
            else:
                limit = max(2, limit // 2)
        assert got[u] == (len(range(0, 90, u)), allowed)


def test_batches_reach_the_sink(spark, tmp_path):
    s = _stream(spark, tmp_path / "s", [(1,), (2,)], "k long")
    ingest.write_batches(s, lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
