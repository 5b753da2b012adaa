"""Each operator against a brute-force version written from its contract, on awkward small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import mixing, near_copies, packing, pii, quality_rules, simhash_trie, substring_dedup, topk_search

WORD = re.compile("[^\x20\x09-\x0d]+")
PROSE = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall tree near old water mills"

#: Nulls, empty and blank texts, unusual white space, ties, copies, near copies, shared passages, no ASCII, a long text.
TEXTS = [
    (1, PROSE), (2, PROSE), (3, PROSE + " today"), (4, None), (5, ""), (6, " \t\n"), (7, "one"), (8, "a b  c\x0bd\x1ce"), (9, "x " + PROSE + " y"),
    (10, "Ünïcode « été » straße İstanbul Σίσυφος ΟΔΟΣ ﬁne 東京 🙂 é"), (11, "it's they're I'M we'll 'sup don't ''s !'s 12 3.4"), (12, "word " * 60), (13, "line\nline\nother\n\nline"),
    (14, "mail a.b+c@x-y.example.org, a@b@c.de a@b..c 1.2.3.4.5 256.1.1.1 10.0.0.255 4111 1111 1111 1111 +1 (017) 555-7713 +12 token = 'abcdefghijkl' account no. 12345678"),
    (15, " ".join(f"w{i % 977}v{i}" for i in range(9000))), (16, PROSE.upper()), (None, PROSE + " null id"), (18, "###$$$ %%% &&& ***"), (19, PROSE), (20, "trailing passage " + PROSE[20:] + " more words here"),
    (21, "one <|endoftext|> two<|startoftext|><|ENDOFTEXT|> <| endoftext |>"),
]
SCHEMA = "doc_id long, text string, source string, key string, fp int, part string, rank string, h int, n int, m int, bucket int, component_id int, size int, u int, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, ("b", "a", None)[k % 3], "k", 1, "p", "r", 1, 1, 1, 1, 1, 1, 1, 1) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, TEXTS).where("false")


# --- near-duplicates --------------------------------------------------------


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash_trie.near_duplicates(docs).collect()}
    prints = {i: brute_print(t) for i, t in TEXTS}
    group = {i: {i} for i in prints}
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] is not group[j]:
                group[i] |= group[j]
                for x in group[i]:
                    group[x] = group[i]
    for i, p in prints.items():
        assert got[i].fingerprint == format(p, "016x")
        assert got[i].component_id == min((x for x in group[i] if x is not None), default=None)
    assert simhash_trie.near_duplicates(empty).count() == 0


def brute_components(fps, budget=4):
    parent = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= budget:
                a, b = i, j
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                parent[max(a, b)] = min(a, b)
    out = []
    for i in range(len(fps)):
        while parent[i] != i:
            i = parent[i]
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trie_forest(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for b in base for k in (1, 3, 5)]
    fps = np.unique(np.concatenate((base, np.array(near, np.uint64))))
    assert simhash_trie.trie_forest(fps, np.array([0])).tolist() == brute_components(fps)
    two = np.concatenate((fps, fps))  # groups do not mix
    n = len(fps)
    assert simhash_trie.trie_forest(two, np.array([0, n])).tolist() == brute_components(fps) + [n + x for x in brute_components(fps)]


def test_dense_ball_is_pruned():
    fps = np.arange(4096, dtype=np.uint64)  # all within twelve low bits
    assert set(simhash_trie.trie_forest(fps, np.array([0])).tolist()) == {0}


def test_large_bucket_in_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    fps = sorted({int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 4)} | {int(b) for b in base})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from tagloom.llm.components import components
    from tagloom.functions.lineage import Scratch

    for rows in (3, 500_000):
        roots = dict(tuple(r) for r in components(simhash_trie.links(df, Scratch(spark, f"t{rows}"), rows), Scratch(spark, f"c{rows}")).collect())
        want = brute_components(np.array(fps, np.uint64))
        assert [roots.get(f, f) for f in fps] == [fps[w] for w in want]


def test_components_of_a_chain_and_a_star(spark):
    from tagloom.llm.components import components
    from tagloom.functions.lineage import Scratch

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[100 + k] for k in range(40)} == {100}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_keep_one(spark):
    rows = [(3, PROSE), (1, PROSE), (2, PROSE.upper()), (7, "another text of its own kind"), (7, "another text of its own kind"), (None, PROSE)]
    kept = simhash_trie.keep_one(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7] and kept.columns[1] == "text"
    unique = simhash_trie.keep_one(table(spark, rows[:4]))
    assert sorted(r.doc_id for r in unique.collect()) == [1, 7]


def test_keep_one_where_groups_share_an_id(spark):
    other, third = "another text of its own kind", "a third one that is unlike both of them"
    rows = [(None, PROSE), (None, PROSE), (None, other), (None, third), (7, "two words"), (7, "under one id"), (7, "under one id"), (9, "under one id"), (8, None), (8, "")]
    kept = simhash_trie.keep_one(table(spark, rows))
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr) == sorted([(7, "two words"), (7, "under one id"), (8, ""), (None, PROSE), (None, other), (None, third)], key=repr)


# --- repeated passages ------------------------------------------------------


def brute_strip(rows):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - 12):
            if i is not None:
                k = tuple(w[p : p + 13])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if i is not None and first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=repr)


def strip(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(df).collect()), key=repr)


def test_substrings(docs, empty):
    assert strip(docs) == brute_strip(TEXTS)
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_substrings_random(spark, seed):
    rng = np.random.default_rng(seed)
    bank = [" ".join(rng.choice(["a", "b", "c", "dd"], rng.integers(13, 40))) for _ in range(8)]
    rows = [(int(rng.integers(0, 25)), " ".join(rng.choice(bank, rng.integers(1, 5)))) for _ in range(40)]
    assert strip(table(spark, rows).repartition(4)) == brute_strip(rows)


def test_spans_merge():
    s, e = substring_dedup.spans(np.array([20, 0, 5, 13]), np.array([13, 13, 13, 13]))
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(0, 33)]


# --- quality rules ----------------------------------------------------------


def test_rule_statistics(docs, empty):
    got = {r.doc_id: r for r in quality_rules.judge(docs, None).collect()}
    for i, t in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        seen = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        again = [False] * len(w)
        for p in range(len(w) - 4):
            if seen[tuple(w[p : p + 5])] > 1:
                again[p : p + 5] = [True] * 5
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * sum(again) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(again), failed,
        )
        assert r.kept == (not failed)
    assert quality_rules.judge(empty, None).count() == 0
    assert quality_rules.keep_good(docs, None).columns == docs.columns


def test_trees_learn_and_stay_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(3000) > 0.6).astype(float)
    trees = quality_rules.fit(x[:2000], y[:2000], [1, 0, -1])
    p = trees.probability(x[2000:])
    assert ((p > 0.5) == (y[2000:] > 0.5)).mean() > 0.9
    grid = np.linspace(0, 1, 101)
    for at in rng.random((20, 3)):
        up, down = np.tile(at, (101, 1)), np.tile(at, (101, 1))
        up[:, 0], down[:, 2] = grid, grid
        assert (np.diff(trees.probability(up)) >= -1e-12).all()
        assert (np.diff(trees.probability(down)) <= 1e-12).all()


def test_trained_rules_keep_good_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held_out = labels.where("doc_id % 2 = 0")
    trees = quality_rules.train(docs, labels.where("doc_id % 2 = 1"))
    judged = quality_rules.judge(docs, trees).join(held_out, "doc_id").where("not base_failed").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.35
    assert quality_rules.train(docs, labels.where("false")) is None


# --- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[1])))


def base(text):
    return [s for s in pii.spans(text) if s[1] in pii.BASE]


@pytest.mark.parametrize("seed", range(8))
def test_spans_like_patterns(seed):
    rng = np.random.default_rng(seed)
    alphabet = list("0123456789" * 3 + "@@.. --++()ab_%é\n") + ["1.2.3.4", "4111111111111111", "x@y.zz", "+1 234 567 890"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert base(text) == brute_spans(text), text


def test_pii(docs, empty):
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    for i, t in TEXTS:
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[1] == k for s in want) for k in PATTERNS]
    assert pii.find(empty).count() == 0
    safe = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert safe[1] == PROSE and safe[4] is None and "[EMAIL]" in safe[14] and "x-y.example" not in safe[14] and "[SECRET]" in safe[14] and "[ACCOUNT]" in safe[14]


def test_long_runs_are_linear():
    for text in ("a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "@" * 200_000, "a@" * 200_000):
        assert base(text) == [] or len(text) > 0


def test_added_kinds():
    found = {k for _, k, _ in pii.spans("see https://bob:pw@host.example/x and IBAN DE89370400440532013000 and IBAN DE00370400440532013000 api_key: ABCDEFGH12345678")}
    assert {"address", "account", "secret"} <= found
    assert [s for s in pii.spans("IBAN DE00370400440532013000") if s[1] == "account"] == []


# --- packing ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_pack(docs, empty, tokenizer):
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, t in TEXTS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == want, t
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_tokens_equal_the_library(seed, tokenizer):
    from tagloom.llm.fast_tokens import store

    rng = np.random.default_rng(seed)
    signs = list("abcXYZé¼ßÀİ'sdtm0123 \n\t.,!#ªʰ") + ["'ll", "'re", "the ", "́", "\xa0", "\x85", "\x00", "ﬁ", "中", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 80))) for _ in range(300)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in store(packing.default_tokenizer()).encode(texts)] == want


def optimum(sizes, capacity):
    """Least number of bins, by trying all placements."""
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best and k < len(sizes):
            return
        if k == len(sizes):
            best = min(best, len(bins))
            return
        for b in {x for x in bins if x + sizes[k] <= capacity}:
            i = bins.index(b)
            go(k + 1, bins[:i] + [b + sizes[k]] + bins[i + 1 :])
        go(k + 1, bins + [sizes[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 20, rng.integers(1, 9)).tolist()
    fixed, left = packing.reduce_instance(dict(Counter(sizes)), 20)
    used = Counter(x for lengths, times in fixed for x in lengths for _ in range(times))
    assert used + Counter(left) == Counter(sizes)
    assert all(sum(lengths) <= 20 for lengths, _ in fixed)
    rest = sorted(Counter(left).elements(), reverse=True)
    assert sum(t for _, t in fixed) + optimum(rest, 20) == optimum(sorted(sizes, reverse=True), 20)
    patterns = packing.plan(dict(Counter(sizes)), 20)
    assert Counter(x for lengths, times in patterns for x in lengths for _ in range(times)) == Counter(sizes)
    assert all(sum(lengths) <= 20 for lengths, _ in patterns)


# --- mixing -----------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, rest, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if level[s] > 2 * sizes[s]]
        if not over:
            return goal | level
        for s in over:
            goal[s] = 2 * sizes[s]
            rest -= 2 * sizes[s]
            free.discard(s)
    return goal


def test_mix(docs, empty):
    source = {i: ("b", "a", None)[k % 3] for k, (i, _) in enumerate(TEXTS)}
    sizes = Counter()
    for i, t in TEXTS:
        sizes[source[i]] += len(WORD.findall(t or ""))
    goal, taken = brute_targets(sizes), Counter()
    rows = mixing.mix(docs, bin_documents=2).collect()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert r.size == len(WORD.findall(dict(TEXTS)[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1
    assert sorted(map(repr, mixing.mix(docs.repartition(5)).collect())) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(got[s] - goal[s]) <= 1 for s in sizes)


def test_heavier_documents_go_first(spark):
    rows = [(i, "word " * 20 if i % 2 else "w" * 200) for i in range(400)]
    df = spark.createDataFrame([(i, t, "s" if i < 200 else "t") for i, t in rows], "doc_id long, text string, source string")
    taken = mixing.mix(df, weights=(1,), share=0.5, bin_documents=16).toPandas()
    assert taken[taken.doc_id % 2 == 1].taken.gt(0).mean() > 0.4


def mixed_words(rows):
    return sum(len(WORD.findall(r.text or "")) for r in rows)


def test_applied_mix_takes_what_the_mix_takes(spark):
    """Repeated rows, different texts under one id, null ids and sources, wordless texts, clashing names."""
    long = " ".join(f"w{k}" for k in range(10))
    rows = [(1, long, "a")] * 3 + [(2, long + " x y", "a")]
    rows += [(3, long, None)] * 7 + [(None, f"{long} {k}", None) for k in range(40)] + [(4, None, "b"), (4, " ", "b"), (4, "one", "b"), (4, "one two", "b"), (4, "one two", "b"), (9, "", "c")]
    df = spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, 2, 3, "s") for r in rows], "doc_id long, text string, source string, n_chars int, key string, size int, words int, room int, row string").repartition(5)
    for share in (0.3, 0.55, 1.0, 1.5, 1.9):
        taken = mixing.mix(df, share=share, bin_documents=4)
        want = {r.source: r.words for r in taken.groupBy("source").agg(F.sum("taken").alias("words")).collect()}
        goal = {r.source: round(r.target) for r in taken.select("source", "target").distinct().collect()}
        out = mixing.apply_mix(df, share=share, bin_documents=4)
        assert out.columns == df.columns and out.schema == df.schema
        got = defaultdict(list)
        for r in out.collect():
            got[r.source].append(r)
            assert r.n_chars == len(r.text) and r.key == "k" and r.row == "s"
        assert {s: mixed_words(got[s]) for s in want} == want
        assert all(abs(want[s] - goal[s]) <= 1 for s in want), (want, goal)
        assert sorted(map(str, out.collect())) == sorted(map(str, mixing.apply_mix(df.repartition(2), share=share, bin_documents=4).collect()))
    assert mixing.apply_mix(df.where("false")).count() == 0


def test_mix_of_a_hot_document_stays_spread(spark):
    """A third of all rows are one row, another third have no id."""
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a b c' ELSE concat('x y ', id) END AS text", "'s' AS source")
    for share in (0.37, 0.9):
        rows = mixing.mix(df, share=share, bin_documents=64).collect()
        assert sum(r.taken for r in rows) == round(9000 * share) and len(rows) == 3000 and all(0 <= r.taken <= 6 for r in rows)


# --- search -----------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), [float(x) for x in np.round(rng.standard_normal(6), 1)]) for i in range(120)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (300, []), (350, []), (205, [1.0, 2.0]), (None, [1.0] * 6), (5, vectors[5][1]), (250, [2.0, 1.0])]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<float>, label int, id string")
    usable = {(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    got = sorted(tuple(r) for r in topk_search.top_k(df.where("vec_id % 50 = 0"), df, query_block=2, candidate_block=7).collect())
    want = []
    for i, v in usable:
        if i % 50 == 0:
            ranked = sorted((-int(np.dot(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(ranked)]
    assert got == sorted(want)
    assert topk_search.top_k(df.where("false"), df).count() == 0 and topk_search.top_k(df, df.where("false")).count() == 0


def test_top_k_where_the_best_id_fills_the_list(spark):
    """Copies of one id, alike and not, are one candidate."""
    vectors = [(0, [1.0, 0.0])] + [(7, [9.0 + 0.5 * (k % 4), 0.0]) for k in range(12)] + [(8, [8.0, 0.0])] * 7 + [(20 + k, [float(k), 1.0]) for k in range(6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df.where("vec_id = 0"), df).orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(k + 1, i, int(s * 256 * 256)) for k, (i, s) in enumerate([(7, 10.5), (8, 8.0), (25, 5.0), (24, 4.0), (23, 3.0)])]


# --- near copies ------------------------------------------------------------


def brute_near(rows):
    """The rows kept: connected by a Jaccard similarity of 0.8 over 5-word shingles, least id first."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for (i, _), g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    return sorted((None if n else i for n, i in best.values()), key=repr)


@pytest.mark.parametrize(("seed", "block_rows"), [(0, 1024), (1, 1024), (2, 2), (3, 3)])
def test_near_copies(spark, seed, block_rows):
    rng = np.random.default_rng(seed)
    rows = list(TEXTS)
    for base in range(12):
        words = [f"w{k}" for k in rng.integers(0, 500, 150)]
        rows.append((1000 + 100 * base, " ".join(words)))
        for n in range(1, 8):  # a word replaced takes up to five shingles, so about J 0.94 to 0.6; some on the copy before
            other = list(rows[-1][1].split() if base % 3 == 0 else words)
            for at in rng.choice(150, n, replace=False):
                other[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((1000 + 100 * base + n, " ".join(other)))
    got = near_copies.keep_near(table(spark, rows).repartition(4), block_rows)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == brute_near(rows)
    assert near_copies.keep_near(table(spark, rows).where("false")).count() == 0


def test_pipeline_stage_finds_near_copies_over_four_bits(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (596, 917, 0, 7818, 2938, 4024)")
    got = corpus_pipeline.near_dedup(spark, rows, "").collect()
    assert sorted(r.doc_id for r in got) == [0, 596, 2938]
