"""Source divergence, sentence pieces and timestamps: SQL, the library, plain loops and awkward rows."""

import hashlib
import random
import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tagloom.llm import queries, sentence_pieces, source_divergence, timestamps
from tests import oracle

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_timestamps"])
def test_matches_sql(spark, sf_dir, name):
    assert oracle.same(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name])


# source divergence


def brute_audit(rows, least, top):
    out, term = set(), re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
    split = [((lang or ""), (source or ""), term.findall((text or "").translate(lower))) for lang, source, text in rows]
    for lang in {r[0] for r in split}:
        own = [r for r in split if r[0] == lang]
        seen = Counter(t for _, _, words in own for t in set(words))
        kept = [t for t, n in seen.items() if n >= least]
        counts = {s: Counter() for _, s, _ in own}
        for _, s, words in own:
            counts[s].update(w for w in words if seen[w] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, o, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(found)}
    return out


AWKWARD = [
    ("en", "a", "The the cat"), ("en", "a", "cat CAT dog's"), ("en", "b", "the dog"), ("en", "c", None), ("en", "c", ""), ("en", None, "Äh äh cat"), (None, None, "only one"), (None, "z", "12 34 !"),
    ("", "z", "only"), ("de", "s", "wort " * 3000), ("de", "t", "wort anders"), ("de", "t", "wort anders"), ("de", "u", "日本 wort"), ("xx", "alone", "cat"),
]


@pytest.mark.parametrize("least", [1, 2, 50])
def test_divergence_of_awkward_rows(spark, least):
    docs = spark.createDataFrame([(*r, "x") for r in AWKWARD], "lang string, source string, text string, item string").repartition(5)
    got = source_divergence.audit(docs, min_documents=least, top_terms=2).collect()
    assert {tuple(r) for r in got} == brute_audit(AWKWARD, least, 2) and len(got) == len({tuple(r) for r in got})


def test_divergence_of_an_empty_table(spark):
    assert source_divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_histograms_cover_each_kept_term_once(spark):
    rows = [("en", t, s, n, 9, 4) for t, s, n in (("x", "a", 3), ("x", "b", 1), ("y", "a", 3), ("z", "b", 5), ("w", "c", 1))]
    kept = spark.createDataFrame(rows, "lang string, term string, source string, n long, size long, terms long")
    groups = spark.createDataFrame([("en", s, 9, 4) for s in "abc"], "lang string, source string, size long, terms long")
    got = {(r.g, r.h, r.a, r.b): r.m for r in source_divergence.joint_histograms(kept, groups).collect()}
    assert got == {
        ("a", "b", 3, 1): 1, ("a", "b", 3, 0): 1, ("a", "b", 0, 5): 1, ("a", "b", 0, 0): 1, ("a", "c", 3, 0): 2, ("a", "c", 0, 1): 1, ("a", "c", 0, 0): 1,
        ("b", "c", 1, 0): 1, ("b", "c", 5, 0): 1, ("b", "c", 0, 1): 1, ("b", "c", 0, 0): 1,
    }


# sentence pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Model(sentence_pieces.default_model())


def test_whole_table_as_the_library_does(spark, library):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_sentence_pieces(spark, DIR).collect()}
    want = {}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_random_texts_as_the_library_does(library, pieces):
    r = random.Random(5)
    texts = ["", " ", "   a  ", "▁", "▁▁ x▁", "\n\n a\t", "a\x00b", "<s></s><unk><0x0A>", "é é ﬁ", "日本語 漢字", "👍🏽", "a" * 3000, " " * 300, "ab " * 20000]
    texts += ["".join(r.choice(" ▁\n\tabcdeéß日本😀12.,<>x") for _ in range(r.randint(1, 50))) for _ in range(1500)]
    texts += ["".join(r.choice(pieces.text[259:]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    ids = pieces.encode([t.encode() for t in texts])
    assert [x.tolist() for x in ids] == library.encode(texts, add_bos=True, add_eos=True)
    assert [t.decode() for t in pieces.decode(ids)] == [library.decode(x.tolist()) for x in ids]


def test_any_ids_decode_as_the_library_does(library, pieces):
    r = random.Random(6)
    ids = [np.array([r.choice((r.randint(0, 300), r.randint(0, 31999))) for _ in range(r.randint(0, 12))], np.uint32) for _ in range(2000)]
    assert [t.decode() for t in pieces.decode(ids)] == [library.decode(x.tolist()) for x in ids]


def test_prefixes_have_one_last_token(library, pieces):
    text = "▁international▁▁▁▁returns,indented"
    last = pieces.last_tokens(text)
    for n in range(1, len(text) + 1):
        shown = library.encode(text[1:n].replace("▁", " "), out_type=int)
        assert n == 1 or last[n] == shown[-1]


def test_stores_that_start_anew_change_nothing(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE_SEGMENTS", 3)
    monkeypatch.setattr(sentence_pieces, "CACHE_PAIRS", 3)
    own = sentence_pieces.Model(sentence_pieces.default_model())
    for t in ("one two three four", "five six", "one two three", "seven eight nine ten eleven"):
        assert own.encode([t.encode()])[0].tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_pieces_of_awkward_rows(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, None), (None, "x" * 40000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids long")
    got = sentence_pieces.encode(docs, decoded=True).collect()
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(((i, library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t in rows), key=repr)
    back = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    assert sorted((repr(r.text) for r in back)) == sorted(repr(t or "") for _, t in rows)
    assert sentence_pieces.digest(docs.limit(0)).count() == 0 and sentence_pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
    bad = docs.limit(1).select("doc_id", F.expr("cast(X'61FF62' as string)").alias("text"))
    assert sentence_pieces.encode(bad, decoded=True).first().decoded == "a�b"


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(sentence_pieces.default_model(), "rb") as file:
        model = proto.ModelProto.FromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge model"):
        sentence_pieces.Model(str(tmp_path / "other.model"))


# timestamps


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


NY, BERLIN = "America/New_York", "Europe/Berlin"
CASES = [
    ("1733025832", "UTC", 1733025832 * 10**6, "epoch", False), ("1733942329007", None, 1733942329007 * 1000, "epoch", False), ("173394232900", "UTC", None, "bad", False),
    (" \t2024-05-18 07:18:57\n", "UTC", us("2024-05-18T07:18:57"), "plain", False), (" 2024-05-18", "UTC", None, "bad", False), ("2024-05-18 ", "UTC", None, "bad", False),
    ("2024-02-29", "UTC", us("2024-02-29T00:00:00"), "plain", False), ("2023-02-29", "UTC", None, "bad", False), ("2024-04-31", "UTC", None, "bad", False), ("2024-00-10", "UTC", None, "bad", False),
    ("20240502", "UTC", us("2024-05-02T00:00:00"), "plain", False), ("20240502 10:11", "UTC", us("2024-05-02T10:11:00"), "plain", False), ("2024010", "UTC", None, "bad", False), ("19991231", "UTC", None, "bad", False),
    ("26.01.2024 17:55:06", BERLIN, us("2024-01-26T16:55:06"), "plain", False), ("05 Nov 2024 02:48", NY, us("2024-11-05T07:48:00"), "plain", False), ("05 nov 2024", NY, None, "bad", False), ("5 Nov 2024", NY, None, "bad", False),
    ("2024-02-09T02:07:34+05:30", NY, us("2024-02-08T20:37:34"), "plain", False), ("2024-02-09T02:07:34-0800", None, us("2024-02-09T10:07:34"), "plain", False), ("2024-02-09T02:07:34 Z", "nowhere", us("2024-02-09T02:07:34"), "plain", False),
    ("2024-02-09T02:07+14:59", NY, us("2024-02-08T11:08:00"), "plain", False), ("2024-02-09T02:07+15:00", NY, None, "bad", False), ("2024-02-09T02:07+01:60", NY, None, "bad", False), ("2024-02-09T02:07z", NY, None, "bad", False),
    ("2024-02-09 24:00", "UTC", None, "bad", False), ("2024-02-09 23:60", "UTC", None, "bad", False), ("2024-02-09 23:59:60", "UTC", None, "bad", False), ("2024-02-09 ", "UTC", us("2024-02-09T00:00:00"), "plain", False), ("2024-02-09T", "UTC", None, "bad", False),
    ("2024-02-09 12:00 AM", "UTC", us("2024-02-09T00:00:00"), "plain", False), ("2024-02-09 12:30PM", "UTC", us("2024-02-09T12:30:00"), "plain", False), ("2024-02-09 01:30:05 PM Z", "UTC", us("2024-02-09T13:30:05"), "plain", False),
    ("2024-02-09 00:30 AM", "UTC", None, "bad", False), ("2024-02-09 13:30 PM", "UTC", None, "bad", False), ("2024-02-09 01:30 pm", "UTC", None, "bad", False),
    ("2024-03-31 02:30:00", BERLIN, us("2024-03-31T00:30:00"), "plain", True), ("2024-03-31 01:59:59", BERLIN, us("2024-03-31T00:59:59"), "plain", False), ("2024-03-31 03:00", BERLIN, us("2024-03-31T01:00:00"), "plain", False),
    ("2024-10-27 02:30", BERLIN, us("2024-10-27T01:30:00"), "plain", True), ("2024-10-27 03:00", BERLIN, us("2024-10-27T02:00:00"), "plain", False), ("2024-10-27 01:59:59", BERLIN, us("2024-10-26T23:59:59"), "plain", False),
    ("2024-03-10 02:00", NY, us("2024-03-10T06:00:00"), "plain", True), ("2024-11-03 01:00", NY, us("2024-11-03T06:00:00"), "plain", True), ("2011-12-30 12:00", "Pacific/Apia", us("2011-12-29T22:00:00"), "plain", True),
    ("2024-04-07 01:45", "Australia/Lord_Howe", us("2024-04-06T15:15:00"), "plain", True), ("2024-05-05", None, None, "bad", False), ("2024-05-05", "nowhere", None, "bad", False), (None, "UTC", None, "bad", False), ("", "UTC", None, "bad", False), ("x" * 10000, "UTC", None, "bad", False),
]


def test_forms_zones_and_changes(spark):
    stamps = spark.createDataFrame([(k, f"s{k}", zone, raw, "x") for k, (raw, zone, *_) in enumerate(CASES)], "stamp_id long, source string, zone string, raw string, offset string")
    got = {r.stamp_id: tuple(r)[1:] for r in timestamps.normalise(stamps).collect()}
    assert got == {k: c[2:] for k, c in enumerate(CASES)}


def test_votes(spark):
    rows = [
        (1, "us", "03/10/2024"), (2, "us", "12/31/2024"), (3, "us", "01/25/2024"), (4, "us", "25/01/2024"),  # two for month first, one against
        (5, "eu", "03/10/2024"), (6, "eu", "31/12/2024 10:00"), (7, "even", "03/10/2024"), (8, "even", "12/31/2024"), (9, "even", "31/12/2024"), (10, "none", "03/10/2024"), (11, "none", "05/05/2024"),
        (12, None, "03/10/2024"), (13, None, "12/31/2024"), (14, "bad", "03/10/2024"), (15, "bad", "12/31/2024 24:00"), (16, "bad", "31/31/2024"), (17, "us", "03/10/2024 08:00 PM -0100"), (1, "us", "03/10/2024"),
    ]
    stamps = spark.createDataFrame([(i, s, "UTC", t) for i, s, t in rows], "stamp_id long, source string, zone string, raw string")
    got = {(r.stamp_id, r.utc_us, r.rule, r.ambiguous) for r in timestamps.normalise(stamps).collect()}
    march, october = us("2024-03-10T00:00:00"), us("2024-10-03T00:00:00")
    assert {g for g in got if g[0] in (1, 5, 7, 10, 12, 14, 17)} == {
        (1, march, "votes", True), (5, october, "votes", True), (7, october, "default", True), (10, october, "default", True), (12, march, "votes", True), (14, october, "default", True), (17, us("2024-03-10T21:00:00"), "votes", True),
    }
    assert {g[2:] for g in got if g[0] in (2, 3, 4, 6, 8, 9, 11, 13)} == {("plain", False)} and {g[1:3] for g in got if g[0] in (15, 16)} == {(None, "bad")}
    strict = {r.stamp_id: r.rule for r in timestamps.normalise(stamps, majority=2).collect()}
    assert strict[1] == "default" and strict[5] == "votes"


def test_half_hours_about_changes_against_zone_rules(spark):
    zones = ["America/New_York", "Europe/London", "Australia/Lord_Howe", "Africa/Casablanca", "America/St_Johns", "Asia/Tehran", "Pacific/Apia", "Asia/Kolkata"]
    first = {z: datetime(2011, 12, 28) if z == "Pacific/Apia" else datetime(2021, 3, 1) for z in zones}
    rows = [(k, z, first[z] + timedelta(minutes=30 * k)) for z in zones for k in range(48 * (4 if z == "Pacific/Apia" else 75))]
    stamps = spark.createDataFrame([(10**6 * zones.index(z) + k, z, z, w.strftime("%Y-%m-%d %H:%M")) for k, z, w in rows], "stamp_id long, source string, zone string, raw string")
    got = {(zones[r.stamp_id // 10**6], r.stamp_id % 10**6): (r.utc_us, r.ambiguous) for r in timestamps.normalise(stamps).collect()}
    for k, z, w in rows:
        one, two = (w.replace(tzinfo=ZoneInfo(z), fold=f).utcoffset() for f in (0, 1))
        # fold 1 has the offset after a repeat, fold 0 that before a skip, of which the larger is the one after it
        after = two if one > two else max(one, two)
        assert got[z, k] == (int((w - after - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, one != two), (z, w)


def test_no_stamps(spark):
    assert timestamps.normalise(spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")).count() == 0
