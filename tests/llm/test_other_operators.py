"""Weak labels, chat repair, fixity, and the queries of the package."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import chat_repair as chat
from tagloom.llm import queries, warc_fixity, weak_labels
from tagloom.functions.lineage import Scratch
from tests import oracle

# --- weak labels ------------------------------------------------------------


def drawn(rng, n, accuracies, speaks=0.8, share=0.3):
    truth = rng.random(n) < share
    votes = np.zeros((n, len(accuracies)), np.int64)
    for k, right in enumerate(accuracies):
        said = np.where(rng.random(n) < right, truth, ~truth)
        votes[:, k] = np.where(rng.random(n) < speaks, np.where(said, weak_labels.LOW, weak_labels.HIGH), weak_labels.ABSTAIN)
    return truth, votes


def test_expectation_maximisation_finds_the_good_labellers():
    truth, votes = drawn(np.random.default_rng(1), 20_000, (0.97, 0.95, 0.93, 0.9, 0.55))
    p, n = np.unique(weak_labels.pattern(votes), return_counts=True)
    low = weak_labels.posterior(p, n, "abuse")
    guess = low[np.searchsorted(p, weak_labels.pattern(votes))] > 0.5
    assert (guess == truth).mean() > 0.93


def plain_posterior(rows, question, rounds):
    """Expectation-maximisation document by document, with plain numbers."""
    kinds = weak_labels.KINDS[question]
    truths, labellers = range(len(kinds) + 1), range(weak_labels.LABELLERS[question])
    belief = [[weak_labels.TRUE_LOW if c and k in kinds[c - 1] else weak_labels.FALSE_LOW for c in truths] for k in labellers]
    soft = []
    for v in rows:
        low = [0.01 + sum(v[k] == weak_labels.LOW for k in g) for g in kinds]
        p = [0.3 ** sum(low), *low]
        soft.append([x / sum(p) for x in p])
    for _ in range(rounds):
        share = [sum(p[c] for p in soft) + 0.5 for c in truths]
        chance = []
        for k in labellers:
            chance.append([])
            for c in truths:
                low = sum(p[c] for v, p in zip(rows, soft, strict=True) if v[k] == weak_labels.LOW)
                said = sum(p[c] for v, p in zip(rows, soft, strict=True) if v[k] != weak_labels.ABSTAIN)
                s = weak_labels.BELIEF * share[c]
                chance[k].append((low + s * belief[k][c]) / (said + s))
        after = []
        for v in rows:
            p = []
            for c in truths:
                x = share[c]
                for k in labellers:
                    x *= {weak_labels.LOW: chance[k][c], weak_labels.HIGH: 1 - chance[k][c], weak_labels.ABSTAIN: 1}[v[k]]
                p.append(x)
            after.append([x / sum(p) for x in p])
        soft = after
    return [1 - p[0] for p in soft]


@pytest.mark.parametrize("question", weak_labels.QUESTIONS)
def test_posteriors_equal_plain_loops(question):
    _, votes = drawn(np.random.default_rng(3), 150, [0.9] * weak_labels.LABELLERS[question], 0.7)
    p, n = np.unique(weak_labels.pattern(votes), return_counts=True)
    got = weak_labels.posterior(p, n, question, 12)[np.searchsorted(p, weak_labels.pattern(votes))]
    assert got == pytest.approx(plain_posterior(votes.tolist(), question, 12), abs=1e-9)


def test_no_pattern_is_held_at_good():
    """Where two labellers contradict a third, the third's silence or praise does not save a document."""
    votes = np.array([[1, 1, 1, 1, 0]] * 50 + [[2, 2, 2, 2, 0]] * 900 + [[0, 0, 0, 0, 0]] * 50)
    p, n = np.unique(weak_labels.pattern(votes), return_counts=True)
    low = weak_labels.posterior(p, n, "abuse")
    assert 0 < low[p == 0][0] < 0.5 and low[p == weak_labels.pattern(votes[:1])[0]][0] > 0.99


def test_patterns_unpack():
    v = np.array([[0, 1, 2, 1], [2, 2, 0, 0]])
    assert (weak_labels.unpack(weak_labels.pattern(v), 4) == v).all()


def plain_features(text):
    """What is present in one text, by the definitions: words, beginnings, shapes and octaves."""
    import re

    h = lambda w: int(weak_labels.Words([w]).hashes()[0])
    top = (1 << weak_labels.BITS) - 16 * len(weak_labels.OCTAVES)
    third = top // 3
    raw = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    plain = "".join(c.lower() if c.isascii() else c for c in text)
    plain = [w for w in re.split(r"[\x00-\x7f]+", re.sub(r"[a-z0-9]", lambda m: chr(0x10FF00 + ord(m[0])), plain)) if w]
    words = ["".join(chr(ord(c) - 0x10FF00) if ord(c) >= 0x10FF00 else c for c in w) for w in plain]
    out = {}
    for w in words:
        out[h(w.encode()) % third] = 1.0
        for k in weak_labels.BEGINNINGS:
            if len(w) > k:
                out[third + h(w[:k].encode()) % third] = 1.0
    shapes = []
    for w in raw:
        codes = ["A" if 65 <= b <= 90 else "a" if 97 <= b <= 122 or b >= 128 else "0" if 48 <= b <= 57 else chr(b) for b in w]
        shapes.append("".join(c for i, c in enumerate(codes) if not i or c != codes[i - 1]))
    for s in set(shapes):
        key = 2 * third + h(s.encode()) % third
        out[key] = out.get(key, 0.0) + 6.0 * shapes.count(s) / len(shapes)
    s = weak_labels.statistics([text.encode()])
    for j, name in enumerate(weak_labels.OCTAVES):
        out[top + 16 * j + min(int(np.floor(np.log2(1 + 4096 * float(s[name][0])))), 15)] = 2.0
    return out


def test_features_equal_plain_loops():
    texts = ["", " \n", "one", "Good Morning, you IDIOT!! réeuxpa réeuxtion 123 a-b", "achlichpf " * 30 + "x" * 50, "東京の夜 Ärger über\tTASK #1"]
    d, f, x = weak_labels.features(weak_labels.Reading([t.encode() for t in texts]))
    for k, t in enumerate(texts):
        got = {int(i): float(v) for i, v in zip(f[d == k], x[d == k], strict=True)}
        want = plain_features(t)
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want), t


def test_votes_look_at_different_evidence():
    texts = ["such an idiot here", "a pathetic thing", "wordone wordtwo", "beginner's luck", "Listen you LOUD man", "you and I agree", "nothing here", ""]
    own = weak_labels.Lexicon(weak_labels.word_hashes(("wordtwo",)), weak_labels.word_hashes(("beginn",)))
    v = weak_labels.votes(weak_labels.Reading([t.encode() for t in texts]), own)["abuse"]
    low = [(int(d), int(k)) for d, k in zip(*np.nonzero(v == weak_labels.LOW), strict=True)]
    assert low == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)] and (v[7] == weak_labels.ABSTAIN).all()
    assert not set(weak_labels.INSULT_NAMES) & set(weak_labels.INSULT_QUALITIES)


def plain_loss(docs, targets, w, bias, l2):
    """The loss and its slopes, document by document and feature by feature."""
    import math

    n, share = len(docs), min(max(sum(targets) / len(docs), 0.01), 0.5)
    total, slope, slope_b = l2 / 2 * sum(x * x for x in w.values()), {i: l2 * x for i, x in w.items()}, 0.0
    for x, t in zip(docs, targets, strict=True):
        z = bias + sum(w[i] * v for i, v in x.items() if i in w)
        weight = (t * 0.5 / share + (1 - t) * 0.5 / (1 - share)) / n
        total += weight * (math.log1p(math.exp(z)) - t * z)
        g = weight * (1 / (1 + math.exp(-z)) - t)
        slope_b += g
        for i, v in x.items():
            if i in w:
                slope[i] += g * v
    return total, slope, slope_b


def test_scorer_equals_plain_loops(spark):
    """The fit stands at the least loss that plain loops measure, and documents are scored as they would."""
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words, 6)) + (" idiot moron pathetic" if k % 3 == 0 else "") for k in range(40)]
    docs = [plain_features(t) for t in texts]
    targets = [1.0 if k % 3 == 0 else 0.1 for k in range(40)]
    doc = np.concatenate([np.full(len(x), k) for k, x in enumerate(docs)])
    feature, value = np.concatenate([list(x) for x in docs]), np.concatenate([list(x.values()) for x in docs])
    got = weak_labels.fit(doc, feature, value, np.array(targets), 400, 1e-3)
    holders = {}
    for x in docs:
        for i in x:
            holders[i] = holders.get(i, 0) + 1
    w, bias = {i: float(got[i]) for i, n in holders.items() if n >= weak_labels.MIN_HOLDERS}, float(got[-1])
    assert set(np.flatnonzero(got[:-1])) <= set(w)
    least, slope, slope_b = plain_loss(docs, targets, w, bias, 1e-3)
    assert max(map(abs, [*slope.values(), slope_b])) < 1e-3
    for _ in range(20):  # the loss is convex: no step in any direction lowers it
        other = {i: x + rng.normal(0, 0.05) for i, x in w.items()}
        assert plain_loss(docs, targets, other, bias + rng.normal(0, 0.05), 1e-3)[0] > least - 1e-6
    mixed = rng.permutation(len(doc))  # neither does the order of entries matter
    assert weak_labels.fit(doc[mixed], feature[mixed], value[mixed], np.array(targets), 400, 1e-3) == pytest.approx(got, abs=0.02)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    scored = df.mapInArrow(weak_labels._score({"junk": np.zeros_like(got), "abuse": got}, 0.6), "doc_id long, junk double, abuse double, kept boolean").collect()
    for r in scored:
        z = bias + sum(w.get(i, 0.0) * v for i, v in docs[r.doc_id].items())
        assert r.abuse == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4) and r.junk == 0.5 and r.kept == (r.abuse <= 0.6)
    assert all((r.abuse > 0.5) == (r.doc_id % 3 == 0) for r in scored)


def test_lexicon_is_what_marks_the_labelled(spark):
    rows = [(k, f"common{k % 7} text number {k} " + ("grumpfxyz bomentexal" if k % 4 == 0 else "quiet words"), 1 if k % 4 == 0 else 0) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = weak_labels.mine(docs, labels)
    assert set(found.words) == set(weak_labels.word_hashes(("grumpfxyz", "bomentexal")))
    assert set(found.beginnings) == set(weak_labels.word_hashes(("grumpf", "grumpfxy", "boment", "bomentex")))
    assert not len(weak_labels.mine(docs.where("false"), labels).words) and not len(weak_labels.mine(docs, labels.where("false")).words)


def test_classifier_on_labelled_documents(spark):
    """Accuracy on documents whose labels no part of the classifier has seen."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    got = weak_labels.classify(docs, seen)
    assert got.count() == docs.count()
    rows = got.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = rows[(rows.quality == 1) & (rows.toxic == 0)]
    assert clean.kept.mean() > 0.97
    assert rows[rows.quality == 0].kept.mean() < 0.1 and rows[rows.toxic == 1].kept.mean() < 0.35


def test_classifier_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "some text"), (4, "some text"), (4, "some text"), (5, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2, "th") for r in rows], "doc_id long, text string, junk int, kept int, th string")
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    assert weak_labels.classify(df, labels).count() == weak_labels.classify(df).count() == len(rows)
    assert weak_labels.classify(df.where("false"), labels.where("false")).count() == 0


# --- chat repair ------------------------------------------------------------


def cost_of(codes, decisions):
    """Total cost of decisions, checked step by step against the automaton."""
    total, state = 0, chat.START
    for code, (action, role, before) in zip(codes, decisions, strict=True):
        for r in before:
            assert chat.STATES.index(r) in chat.LEGAL[state]
            state, total = chat.STATES.index(r), total + chat.INSERT
        to = chat.STATES.index(role)
        if action == "merge":
            assert to == state != chat.START
            total += chat.MERGE + (0 if state == code + 1 else 20)
        else:
            assert to in chat.LEGAL[state] and (action == "keep") == (to == code + 1)
            total += chat.KEEP if action == "keep" else chat.RELABEL
        state = to
    return total + chat.INSERT * len(chat.closing(decisions[-1][1]))


def cheapest(codes):
    best = [None]

    def go(k, state, cost):
        if best[0] is not None and cost >= best[0]:
            return
        if k == len(codes):
            end = cost + chat.INSERT * len(chat.closing(chat.STATES[state]))
            best[0] = end if best[0] is None else min(best[0], end)
            return

        def place(at, so_far, depth):
            for to in chat.LEGAL[at]:
                go(k + 1, to, so_far + (chat.KEEP if to == codes[k] + 1 else chat.RELABEL))
                if depth < 3:
                    place(to, so_far + chat.INSERT, depth + 1)

        if state != chat.START:
            go(k + 1, state, cost + chat.MERGE + (0 if state == codes[k] + 1 else 20))
        place(state, cost, 0)

    go(0, chat.START, 0)
    return best[0]


@pytest.mark.parametrize("codes", [c for n in (1, 2, 3) for c in itertools.product((-1, 0, 1, 2), repeat=n)])
def test_least_cost(codes):
    assert cost_of(codes, chat.repair(list(codes))) == cheapest(codes)


def test_legal_chats_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", None), (2, 0, " User ", "u"), (2, 1, "ASSISTANT", "a")]
    got = chat.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.action for r in got.collect()} == {"keep"} and got.where("size(inserted) + size(closing) > 0").count() == 0
    text = "".join(r.rendered for r in got.where("conv_id = 1").orderBy("turn").collect())
    assert text == "<|system|>\ns\n<|end|>\n<|user|>\nu\n<|end|>\n<|assistant|>\n\n<|end|>\n"


def test_one_conversation_over_many_parts(spark):
    rng = random.Random(4)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "other", None]), str(i)) for i in range(2000)] + [(k, 0, "user", "q") for k in range(30)] + [(None, 1, "user", "x"), (None, 0, "assistant", "y"), (8, None, "user", "z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, part int, seq int")
    got = chat.repair_chats(df.repartition(5)).collect()
    assert len(got) == len(rows)
    own = sorted((r for r in got if r.conv_id == 7), key=lambda r: r.turn)
    codes = [chat.code(r.role) for r in own]
    least = int((chat.chain(codes)[chat.START] + chat._FINAL).min())
    assert cost_of(codes, [(r.action, r.new_role, r.inserted) for r in own]) == least
    assert own[-1].closing == chat.closing(own[-1].new_role) and all(not r.closing for r in own[:-1])
    assert chat.repair_chats(df.where("false")).count() == 0


# --- fixity -----------------------------------------------------------------


def pages(spark, n=600):
    return spark.createDataFrame([(i, f"http://h/{i % 3}", f"<p>{i} é</p>" * (i % 5), "x", 1) for i in range(n)], "page_id long, url string, html string, leaf string, offset int")


def faults(spark, own, other):
    rows = warc_fixity.check_replica(own, other).collect()
    assert all(r.intact == (r.status in ("intact", "moved")) for r in rows)
    return sorted(((r.page_id, r.status) for r in rows if not r.intact), key=str), {r.page_id for r in rows if r.status == "moved"}


def test_each_fault_is_reported_once_and_alone(spark):
    own = pages(spark)
    assert faults(spark, own, own) == ([], set())
    html = F.when(F.col("page_id") == 301, F.translate("html", "p", "q"))  # as long as before
    assert faults(spark, own, own.withColumn("html", html.otherwise(F.col("html")))) == ([(301, "corrupt")], set())
    longer = F.when(F.col("page_id").isin(5, 300), F.concat("html", F.lit("!!")))  # 5 and 300 are empty pages
    assert faults(spark, own, own.withColumn("html", longer.otherwise(F.col("html")))) == ([(300, "corrupt"), (5, "corrupt")], set(range(6, 600)) - {300})
    empty = F.when(F.col("page_id") == 4, F.lit(None)).otherwise(F.col("html"))
    assert faults(spark, own, own.withColumn("html", empty)) == ([(4, "corrupt")], set(range(5, 600)))
    assert faults(spark, own, own.where("page_id <> 10")) == ([(10, "missing")], set(range(11, 600)))
    assert faults(spark, own.where("page_id <> 10"), own) == ([(10, "added")], set(range(11, 600)))
    assert faults(spark, own, own.where("page_id < 599")) == ([(599, "missing")], set())
    far = own.where("page_id = 0").withColumn("page_id", F.lit(10**9).cast("long"))
    assert faults(spark, own, own.unionByName(far)) == ([(10**9, "added")], set())


def test_audit_descends_only_into_differing_branches(spark):
    own = pages(spark)
    other = own.withColumn("html", F.when(F.col("page_id") == 301, F.lit("longer than it was")).otherwise(F.col("html")))
    none = own.where("false").select("page_id")
    scratch = Scratch(spark, "t")
    a, b = (scratch.save(warc_fixity.leaves(warc_fixity.hashed(warc_fixity.records(x)), none), n) for x, n in ((own, "a"), (other, "b")))
    archives, slots = warc_fixity.audit(a, b, scratch)
    assert [tuple(r) for r in slots.collect()] == [(0, 301)] and archives.count() == 1
    assert [spark.read.parquet(f"{scratch.root}/differ-{k}").count() for k in range(4)] == [1, 1, 1, 1]


def test_fixity_on_awkward_rows(spark):
    rows = [(1, None, None), (None, "u", "h"), (None, "u", "h"), (None, "u", "i"), (2, "u", ""), (2, "u", ""), (2, "u", "x"), (10**12, "u", "h"), (-5, "u", "h")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, status string, copies int")
    got = warc_fixity.check_replica(df, df).collect()
    assert sum(r.copies for r in got) == len(rows) and {r.status for r in got} == {"intact"} and len({(r.archive, r.leaf, r.sha256) for r in got}) == len(got)
    assert faults(spark, df.where("false"), df.where("page_id = 1"))[0] == [(1, "added")] and warc_fixity.check_replica(df.limit(0), df.limit(0)).count() == 0
    assert faults(spark, df, df.where("html <> 'i' or html is null"))[0] == [(None, "missing")]  # known by its content
    once = df.where("page_id is null").limit(1).unionByName(df.where("page_id is not null"))
    assert ("missing" in {s for _, s in faults(spark, df, once)[0]}) and {i for i, _ in faults(spark, df, once)[0]} == {None}
    text = df.where("page_id = 2").limit(1).select(warc_fixity.record_text(F.col("page_id"), F.col("url"), F.lit("é")).alias("r")).first().r
    assert text.startswith("WARC/1.0\r\n") and "Content-Length: 2\r\n\r\né\r\n\r\n" in text


# --- queries ----------------------------------------------------------------


def test_ten_queries():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert oracle.same(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    columns, docs = ["doc_id", "text", "lang", "source", "n_chars"], spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, seen = Scratch(spark, "t"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] > 0
    mixed = docs.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() >= docs.count() and packed.agg(F.sum("length")).first()[0] > mixed
