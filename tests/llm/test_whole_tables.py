"""Operators over a whole table of documents against plain loops, and the pipeline's stages on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import chat_repair, mixing, packing, pii, quality_rules, simhash_trie
from tests.llm.test_contracts import PROSE, TEXTS, WORD, brute_components, brute_print, brute_spans, brute_targets, table

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def rows(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.collect()]


def test_fingerprints_and_components(frame, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_trie.near_duplicates(frame).collect()}
    prints = np.array([brute_print(t) for _, t, _ in rows], np.uint64)
    least = {}
    for (i, _, _), g in zip(rows, groups := brute_components(prints), strict=True):
        least[g] = min(least.get(g, i), i)
    assert got == {i: (format(int(p), "016x"), least[g]) for (i, _, _), p, g in zip(rows, prints, groups, strict=True)}


def plain_base(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    again = [False] * len(w)
    for p in range(len(w) - 4):
        if windows[tuple(w[p : p + 5])] > 1:
            again[p : p + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(again)


def descend(trees, x):
    """One document's probability, tree by tree from root to leaf."""
    total = trees.bias
    for t in range(len(trees.feature)):
        node = 0
        while (after := trees.below[t, node] if x[trees.feature[t, node]] <= trees.threshold[t, node] else trees.above[t, node]) != node:
            node = after
        total += trees.value[t, node]
    return 1 / (1 + np.exp(-total))


def test_rules_and_verdicts(spark, frame, rows):
    trees = quality_rules.train(frame, spark.read.parquet(f"{DIR}/labels.parquet"))
    got = {r.doc_id: r for r in quality_rules.judge(frame, trees).collect()}
    for i, t, _ in rows:
        n, chars, symbols, dup, again = plain_base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again), i
        failed = n < 10 or 100 * again > 20 * n
        s = quality_rules.statistics([(t or "").encode()])
        low = descend(trees, [float(s[k][0]) for k in quality_rules.FEATURES])
        assert r.base_failed == failed and r.low_quality == pytest.approx(low) and r.kept == (not failed and low <= quality_rules.REJECT_ABOVE)


def test_personal_data(frame, rows):
    got = {r.doc_id: r for r in pii.digest(pii.find(frame)).collect()}
    for i, t, _ in rows:
        want = brute_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()


def plain_added(text):
    """Accounts, secrets and user addresses, from every place where a cue ends."""
    out = set()
    for kind, cues, pattern in (("account", pii.ACCOUNT_CUES, pii._ACCOUNT), ("secret", pii.SECRET_CUES, pii._SECRET)):
        for at in range(len(text) + 1):
            if any(text[:at].endswith(w) for c in cues for w in pii.written(c)) and (m := pattern.match(text, at)):
                number = m[1].replace(" ", "")
                mod = int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in number[4:] + number[:4])) % 97 if kind == "account" and not number[0].isdigit() else 1
                if mod == 1:
                    out.add((m.start(1), kind, m.end(1)))
    for m in re.finditer(r"(?=://[^\x20\t\n\r\x0b\f/@\"'<>]+@([^\x20\t\n\r\x0b\f\"'<>]+))", text):
        start = m.start()
        while start and re.match("[A-Za-z0-9]", text[start - 1]):
            start -= 1
        out.add((start, "address", m.end(1)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_added_kinds_like_plain_scans(seed):
    rng = np.random.default_rng(seed)
    bits = ["Konto", "IBAN", "Account no.", "cuenta", "Compte:", "token", "Passwort", "MOT DE PASSE", "contraseña", "api_key", "=", ": ", " ", "\"", "DE89370400440532013000", "DE00370400440532013000", "GB82 WEST 1234 5698 7654 32", "12345678", "1234-5678-9012", "AbC-123_x/yZ==", "0123456789abcdef", "http://u:p@h.example/x", "ftp://me@h", "://", "@", "x", "é", "\n"]
    for _ in range(200):
        text = "".join(rng.choice(bits, rng.integers(1, 9)))
        assert {s for s in pii.spans(text) if s[1] not in pii.BASE} == plain_added(text), text


def test_targets_and_words(frame, rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal, taken = brute_targets(sizes), Counter()
    source = {i: (t, s) for i, t, s in rows}
    for r in mixing.mix(frame).collect():
        t, s = source[r.doc_id]
        assert r.size == len(WORD.findall(t or "")) and r.source_size == sizes[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)


def test_packed_pieces(frame, rows):
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for (i, _, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    got, places = packing.pack(frame).collect(), defaultdict(list)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


# --- chat rendering ---------------------------------------------------------


def plain_rendering(turns):
    """A conversation turn by turn: what is put in, merged and closed, with each turn's end mark."""
    out, open_ = [], False
    decisions = chat_repair.repair([chat_repair.code(r) for _, r, _ in turns])
    for (_, _, text), (action, role, before) in zip(turns, decisions, strict=True):
        if action != "merge":
            out += ["<|end|>\n"] * open_ + [f"<|{r}|>\n<|end|>\n" for r in before] + [f"<|{role}|>\n"]
        out.append((text or "") + "\n")
        open_ = True
    return "".join([*out, "<|end|>\n", *(f"<|{r}|>\n<|end|>\n" for r in chat_repair.closing(decisions[-1][1]))])


def test_rendered_chats(spark):
    rng = np.random.default_rng(3)
    chats = {c: [(k, rng.choice(["user", "assistant", "system", "User ", "bot", None]), rng.choice([f"t{c}.{k}", "", None])) for k in range(rng.integers(1, 9))] for c in range(120)}
    data = [(c, k, r if r is None else str(r), t if t is None else str(t)) for c, turns in chats.items() for k, r, t in turns]
    got = defaultdict(list)
    for r in chat_repair.repair_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)).collect():
        got[r.conv_id].append((r.turn, r.rendered))
    seen = Counter()
    for c, turns in chats.items():
        whole = "".join(x for _, x in sorted(got[c]))
        assert whole == plain_rendering(turns), turns
        roles = re.findall(r"<\|(user|assistant|system)\|>", whole)
        assert roles[-1] == "assistant" and all(a != b for a, b in zip(roles, roles[1:], strict=False)) and "system" not in roles[1:]
        assert whole.count("<|end|>") == len(roles) and all(t in whole for _, _, t in turns if t)
        seen.update(a for a, _, _ in chat_repair.repair([chat_repair.code(r) for _, r, _ in turns]))
        seen["inserted"] += sum(len(b) for _, _, b in chat_repair.repair([chat_repair.code(r) for _, r, _ in turns]))
    assert all(seen[k] for k in ("keep", "merge", "relabel", "inserted"))


def test_rendered_conversations_of_the_table(spark):
    frame = spark.read.parquet(f"{DIR}/conversations.parquet")
    chats, got = defaultdict(list), defaultdict(list)
    for r in frame.collect():
        chats[r.conv_id].append((r.turn, r.role, r.text))
    for r in chat_repair.repair_chats(frame).collect():
        got[r.conv_id].append((r.turn, r.rendered))
    for c, turns in chats.items():
        if len({k for k, _, _ in turns}) == len(turns):  # the order of equal turns goes by a hash
            assert "".join(x for _, x in sorted(got[c])) == plain_rendering(sorted(turns, key=lambda t: t[0]))


# --- stages -----------------------------------------------------------------

AWKWARD = [*TEXTS, (1, PROSE), (1, PROSE), (None, None), (None, PROSE + " another without an id"), (None, "x y z " * 40), (7, "the second text of one id " + PROSE[::-1])]


def test_stages_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (12, 0, 0), (None, 0, 1), (3, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, AWKWARD).repartition(4)
    name = dict(corpus_pipeline.STAGES)
    good = name["quality_rules"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} <= {i for i, t in AWKWARD if len(WORD.findall(t or "")) >= 10}
    near = name["simhash_near_dedup"](spark, docs, str(tmp_path))
    kept = near.collect()
    assert near.columns == docs.columns and [r.doc_id for r in kept].count(None) == 1 and sum(r.doc_id == 7 for r in kept) == 2 and sum(r.text == PROSE for r in kept) == 1
    safe = name["personal_data"](spark, docs, str(tmp_path))
    assert safe.columns == docs.columns and safe.count() == len(AWKWARD) and safe.where("text is null").count() == 2
    mixed = name["source_mixing"](spark, docs, str(tmp_path))
    words = sum(len(WORD.findall(r.text or "")) for r in mixed.collect())
    sizes = Counter()
    for k, (_, t) in enumerate(AWKWARD):
        sizes[("b", "a", None)[k % 3]] += len(WORD.findall(t or ""))
    assert mixed.columns == docs.columns and abs(words - sum(brute_targets(sizes).values())) <= 3
    packed = name["best_fit_packing"](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == len(AWKWARD)
    none = docs.where("false")
    assert [stage(spark, none, str(tmp_path)).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_documents_are_kept_once_per_group(spark):
    """Unrelated texts without an id, or under one, are all kept, and so is one of each group of copies among them."""
    prose = ["one text about rivers and the long way that they take down to the sea", "another that speaks of mountains only and of the snow which lies upon them", "the third is on cities at night when all the lamps along the streets are lit"]
    for key in (None, 1):
        docs = spark.createDataFrame([(key, t) for t in prose * 3], "doc_id long, text string")
        assert sorted(r.text for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(prose)
        assert sorted(r.text for r in simhash_trie.keep_one(docs).collect()) == sorted(prose)
