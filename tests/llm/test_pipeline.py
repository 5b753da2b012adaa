"""The pipeline's rows against plain loops over the same documents."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

import corpus_pipeline
from tagloom.llm import mixing, packing, pii, quality_rules
from tests.llm.test_contracts import WORD, brute_targets


def plain_quality(docs, trees):
    kept = []
    for d in docs:
        w = WORD.findall(d["text"] or "")
        seen, again = Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4)), [False] * len(w)
        for p in range(len(w) - 4):
            if seen[tuple(w[p : p + 5])] > 1:
                again[p : p + 5] = [True] * 5
        s = quality_rules.statistics([(d["text"] or "").encode()])
        low = trees.probability(np.array([[float(s[k][0]) for k in quality_rules.FEATURES]]))[0]
        if len(w) >= 10 and 100 * sum(again) <= 20 * len(w) and low <= quality_rules.REJECT_ABOVE:
            kept.append(d)
    return kept


def plain_dedup(docs):
    """Groups over 5-word shingle sets with a Jaccard similarity of 0.8 or more; sets that share no shingle are never compared."""
    sets, holders = [], defaultdict(list)
    for k, d in enumerate(docs):
        w = (d["text"] or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
        for s in sets[-1]:
            holders[s].append(k)
    group = list(range(len(docs)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, own in enumerate(sets):
        shared = Counter(j for s in own for j in holders[s] if j < k)
        for j, both in shared.items():
            if 5 * both >= 4 * (len(own) + len(sets[j]) - both) and top(j) != top(k):
                group[max(top(j), top(k))] = min(top(j), top(k))
    least = {}
    for k, d in enumerate(docs):
        least[top(k)] = min(least.get(top(k), d["doc_id"]), d["doc_id"])
    return [d for d in docs if d["doc_id"] in set(least.values())]


def plain_redact(text):
    out, at = "", 0
    for start, kind, end in pii.spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def plain_mix(docs):
    sizes = Counter()
    for d in docs:
        d["size"] = len(WORD.findall(d["text"]))
        sizes[d["source"]] += d["size"]
        own = xxhash.xxh64(d["text"].encode(), 42).digest()[::-1]
        h = xxhash.xxh64_intdigest(struct.pack("<i", 20240601), xxhash.xxh64_intdigest(own, xxhash.xxh64_intdigest(struct.pack("<q", d["doc_id"]), 42)))
        weight = 1 / (1 + abs(len(d["text"]) / max(d["size"], 1) - 6) / 6)
        d["key"] = -math.log(((h >> 12) + 0.5) / 2**52) / weight
    goal = brute_targets(sizes)
    out = []
    for source, size in sizes.items():
        epochs = math.floor(goal[source] / size)
        rest = math.floor(goal[source] + 0.5) - epochs * size
        for d in sorted((d for d in docs if d["source"] == source), key=lambda d: (d["key"], d["doc_id"])):
            taken = epochs * d["size"] + min(d["size"], max(rest, 0))
            rest -= d["size"]
            out += [(d["doc_id"], d["text"])] * (taken // d["size"])
            if taken % d["size"]:
                out.append((d["doc_id"], " ".join(WORD.findall(d["text"])[: taken % d["size"]])))
    return out


def test_rows_equal_plain_loops(spark, sf_dir):
    from tokenizers import Tokenizer

    frame, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality_rules.train(frame, labels)
    docs = plain_dedup(plain_quality([r.asDict() for r in frame.collect()], trees))
    docs = [d | {"text": plain_redact(d["text"])} for d in docs]
    texts = plain_mix(docs)
    tokenizer, want, total = Tokenizer.from_file(packing.default_tokenizer()), Counter(), 0
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [packing.TAIL_ID], "<u4")
        total += len(ids)
        for k, s in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[s : s + packing.CAPACITY]
            want[doc_id, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    assert len(places) <= -(-total // packing.CAPACITY) + 1


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "personal_data", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None and mixing.SHARE == 1.5 and re.fullmatch(mixing.WORD, "a")
