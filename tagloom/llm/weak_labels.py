"""Quality classifier from weak labels.

Overlapping heuristic labellers vote low, high or nothing on each document, for
two questions: is it junk, is it abusive.  Labellers of one question look at
different evidence: shapes and repeats of a text, two disjoint lists of insults,
words and word beginnings that a bounded labelled sample shows to mark abuse
(each learnt on its own half of the sample), and shouting at the reader.

Votes of all documents are counted per pattern (at most 3 to the number of
labellers rows); expectation-maximisation over those counts estimates each
labeller's accuracy, per kind of fault, and so each pattern's posterior.  The
posteriors of a bounded sample of documents train a hashed linear scorer, which
then judges every document by its words, beginnings, shapes and statistics.

What is gathered for fitting is bounded by MAX_LABELLED, MAX_LEXICON,
MAX_TRAINING and MAX_FEATURES; texts are never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch
from tagloom.llm import samples
from tagloom.llm.quality_rules import statistics
from tagloom.llm.words import Words, slices

#: Common insults, as disjoint lists of names and of qualities.
INSULT_NAMES = ("bastard", "clown", "clowns", "dumbass", "fool", "fools", "freak", "garbage", "idiot", "idiots", "imbecile", "jerk", "loser", "losers", "moron", "morons", "scum", "trash", "vermin")
INSULT_QUALITIES = ("brainless", "despicable", "disgusting", "dumb", "filthy", "hateful", "idiotic", "moronic", "pathetic", "revolting", "stupid", "ugly", "useless", "worthless")
#: Words that address the reader, in four languages.
ADDRESS = ("dein", "deine", "dich", "du", "eres", "tes", "toi", "ton", "tu", "usted", "votre", "vous", "you", "your", "yourself")

ABSTAIN, LOW, HIGH = 0, 1, 2
QUESTIONS = ("junk", "abuse")
LABELLERS = {"junk": 9, "abuse": 5}
#: Kinds of low documents, by the labellers that look for each.
KINDS = {"junk": ((0,), (1, 2), (3, 4, 5), (6, 7, 8)), "abuse": ((0, 1, 2, 3, 4),)}
BITS = 18
#: Code points of a word's beginnings.
BEGINNINGS = (6, 8)
#: Statistics whose order of magnitude is a feature.
OCTAVES = ("symbol_share", "upper_share", "bang_share", "repeat_share", "dup_line_share", "distinct_share", "stop_share", "long_word_share")
MAX_LABELLED = 3_000
MAX_LEXICON = 2_048
MAX_TRAINING = 6_000
MAX_FEATURES = 4_000_000
#: A word or beginning marks abuse if so many abusive documents of its half sample hold it, and their share is so many times that of the others.
MIN_MARKED, MIN_RATIO = 4, 40.0
#: What is believed of labellers before any vote is seen, worth BELIEF times as many votes as there are: how seldom one votes low on a good document, and how often on one of the kind that it looks for.
FALSE_LOW, TRUE_LOW, BELIEF = 0.002, 0.7, 0.2
#: Features that fewer sampled documents hold are left out of the scorer.
MIN_HOLDERS = 8
DROP_ABOVE = 0.4

_LOWER = np.full(256, 0x20, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 0x80:
        _LOWER[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = ord("A")
_SHAPE[list(b"abcdefghijklmnopqrstuvwxyz")] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[list(b"0123456789")] = ord("0")


@dataclass(frozen=True)
class Lexicon:
    """Hashes of words and of word beginnings that mark abuse, ascending."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    beginnings: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def word_hashes(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(Words([w.encode() for w in words]).hashes())


def _hits(doc: np.ndarray, hashes: np.ndarray, wanted: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc[np.isin(hashes, wanted)], minlength=n) if len(wanted) else np.zeros(n, np.int64)


def beginnings(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the words' beginnings of each length."""
    each = [words.beginnings(k) for k in BEGINNINGS]
    return np.concatenate([d for d, _ in each]), np.concatenate([h for _, h in each])


class Reading:
    """What votes and features are taken from: statistics, and lower-cased words of letters and digits alone."""

    def __init__(self, texts: list[bytes]) -> None:
        self.n = len(texts)
        self.stats = statistics(texts)
        self.raw = Words(texts)
        self.plain = Words.mapped(_LOWER[self.raw.data], self.raw.ends)
        self.words = self.plain.hashes()
        self.begun, self.beginnings = beginnings(self.plain)

    def shouted_at(self) -> np.ndarray:
        """Documents in which a word that ends with an exclamation mark or stands in capitals follows closely on one that addresses the reader."""
        r = self.raw
        own = np.isin(Words.mapped(np.where((r.data >= 65) & (r.data <= 90), r.data + 32, r.data).astype(np.uint8), r.ends).hashes(), word_hashes(ADDRESS))
        capitals = np.concatenate((np.zeros(1, np.int64), np.cumsum((r.data >= 65) & (r.data <= 90))))
        long = r.end - r.start
        loud = (r.data[r.end - 1] == ord("!")) | ((long >= 3) & (capitals[r.end] - capitals[r.start] == long))
        hit = np.zeros(self.n, bool)
        for k in (1, 2, 3):
            near = own[:-k] & loud[k:] & (r.doc[:-k] == r.doc[k:]) if len(own) > k else np.zeros(0, bool)
            hit[r.doc[:-k][near]] = True
        return hit


def votes(r: Reading, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Per question, (documents, labellers) votes."""
    s = r.stats

    def vote(low: np.ndarray, high: np.ndarray | bool = False) -> np.ndarray:
        return np.where(low, LOW, np.where(high, HIGH, ABSTAIN)).astype(np.int64)

    few = s["n_words"] < 10
    junk = [
        vote(s["symbol_share"] > 0.02, s["symbol_share"] < 0.004),
        vote(s["upper_share"] > 0.3, (s["upper_share"] < 0.12) & ~few),
        vote(s["bang_share"] > 0.02),
        vote(s["repeat_share"] > 0.35, s["repeat_share"] < 0.02),
        vote((s["distinct_share"] < 0.2) & ~few, s["distinct_share"] > 0.35),
        vote(s["dup_line_share"] > 0.4, s["dup_line_share"] == 0),
        vote((s["digit_share"] > 0.3) | (s["n_words"] < 3), s["n_words"] > 40),
        vote((s["stop_share"] < 0.003) & ~few, s["stop_share"] > 0.008),
        vote(s["long_word_share"] > 0.1, s["long_word_share"] < 0.02),
    ]
    some = s["n_words"] > 0
    names, qualities = (_hits(r.plain.doc, r.words, word_hashes(x), r.n) for x in (INSULT_NAMES, INSULT_QUALITIES))
    words = _hits(r.plain.doc, r.words, lexicon.words, r.n)
    begun = _hits(r.begun, r.beginnings, lexicon.beginnings, r.n)
    abuse = [
        vote(names > 0, some), vote(qualities > 0, some), vote(words > 0, some & (len(lexicon.words) > 0)),
        vote(begun > 0, some & (len(lexicon.beginnings) > 0)), vote(r.shouted_at()),
    ]
    return {"junk": np.stack(junk, 1), "abuse": np.stack(abuse, 1)}


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def unpack(p: np.ndarray, labellers: int) -> np.ndarray:
    return (p[:, None] // 3 ** np.arange(labellers)) % 3


def posterior(patterns: np.ndarray, counts: np.ndarray, question: str, rounds: int = 60) -> np.ndarray:
    """P(low) of each vote pattern, by expectation-maximisation.

    The truth is "good" or one of the kinds of low; each labeller has its own
    chance of voting low given each truth, and votes are independent given it.
    Saying nothing says nothing.  The start gives a pattern to the kinds whose
    labellers vote low, and mostly to good where none does; after that all
    patterns follow the votes and the beliefs above, and none is held fixed.
    """
    labellers, kinds = LABELLERS[question], KINDS[question]
    v, n = unpack(patterns, labellers), counts.astype(np.float64)
    low = np.stack([(v[:, list(g)] == LOW).sum(1) for g in kinds], 1).astype(np.float64) + 0.01
    p = np.concatenate((0.3 ** low.sum(1, keepdims=True), low), 1)
    p /= p.sum(1, keepdims=True)
    believed = np.full((labellers, 1 + len(kinds)), FALSE_LOW)
    for c, g in enumerate(kinds):
        believed[list(g), c + 1] = TRUE_LOW
    said_low, said = (v == LOW).astype(np.float64), (v != ABSTAIN).astype(np.float64)
    for _ in range(rounds):
        weight = n[:, None] * p
        share = weight.sum(0) + 0.5
        belief = BELIEF * share
        chance = (said_low.T @ weight + belief * believed) / (said.T @ weight + belief)
        log_p = np.log(share) + said_low @ np.log(chance) + (said - said_low) @ np.log1p(-chance)
        p = np.exp(log_p - log_p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
    return 1 - p[:, 0]


def features(r: Reading) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value): presence of each plain word and beginning, the share of words of each shape, and each statistic's octave.

    Words, beginnings and shapes are hashed into thirds of the feature space,
    below the octaves' own places.
    """
    octaves = 16 * len(OCTAVES)
    third = ((1 << BITS) - octaves) // 3
    top = (1 << BITS) - octaves

    def present(doc: np.ndarray, hashes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, many = np.unique(doc * third + (hashes % np.uint64(third)).astype(np.int64), return_counts=True)
        return key // third, key % third + first, many

    word_doc, word, _ = present(r.plain.doc, r.words, 0)
    head_doc, head, _ = present(r.begun, r.beginnings, third)
    shape = _SHAPE[r.raw.data]
    keep = np.concatenate(([True], shape[1:] != shape[:-1]))
    keep[r.raw.ends - 1] = True
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))
    shapes = Words.mapped(shape[keep], at[r.raw.ends])
    shape_doc, kind, many = present(shapes.doc, shapes.hashes(), 2 * third)
    share = 6.0 * many / shapes.count[shape_doc]
    octave = np.minimum(np.stack([np.floor(np.log2(1 + 4096 * r.stats[k])) for k in OCTAVES], 1).astype(np.int64), 15)
    stat = top + 16 * np.arange(len(OCTAVES)) + octave
    return (
        np.concatenate((word_doc, head_doc, shape_doc, np.repeat(np.arange(r.n), len(OCTAVES)))),
        np.concatenate((word, head, kind, stat.ravel())),
        np.concatenate((np.ones(len(word) + len(head)), share, np.full(stat.size, 2.0))),
    )


def fit(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = 60, l2: float = 5e-3, memory: int = 8) -> np.ndarray:
    """Logistic weights (the last is the bias) of least loss for soft targets, with a penalty of l2 / 2 on the squares of all but the bias.

    Limited-memory quasi-Newton steps with a line search: the loss never rises,
    and its one minimum does not depend on the order of documents or on the way
    to it.  Rare positives weigh as much as the rest.
    """
    n, size = len(target), 1 << BITS
    use = (np.bincount(feature, minlength=size) >= MIN_HOLDERS)[feature]
    doc, feature, value = doc[use], feature[use], value[use]
    # feature by feature: weights are spread and gradients summed in order, and what is looked up by document stays in cache
    order = np.argsort(feature, kind="stable")
    doc, value = doc[order], value[order]
    columns, starts, many = np.unique(feature[order], return_index=True, return_counts=True)
    share = np.clip(target.mean(), 0.01, 0.5)
    weight = (target * (0.5 / share) + (1 - target) * (0.5 / (1 - share))) / n

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(doc, weights=value * np.repeat(w[:-1], many), minlength=n) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        each = np.add.reduceat(value * g[doc], starts) if len(columns) else np.zeros(0)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + l2 / 2 * (w[:-1] @ w[:-1])), np.append(each + l2 * w[:-1], g.sum())

    w = np.zeros(len(columns) + 1)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, scale = -g, []
        for s, y in reversed(past):
            scale.append((s @ d) / (s @ y))
            d = d - scale[-1] * y
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 0.1 / max(np.abs(g).max(), 1e-12))
        for (s, y), a in zip(past, reversed(scale), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        after, slope = loss(w + d), g @ d
        while after[0] > f + 1e-4 * step * slope and step > 1e-6:
            step /= 2
            after = loss(w + step * d)
        if after[0] >= f:
            break
        s, y, gain = step * d, after[1] - g, f - after[0]
        past = [*past, (s, y)][-memory:] if s @ y > 1e-15 else past
        w, (f, g) = w + s, after
        if gain < 1e-9 * f:
            break
    out = np.zeros(size + 1, np.float32)
    out[columns], out[size] = w[:-1], w[-1]
    return out


# --- lexicon ----------------------------------------------------------------


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, toxic, text) to the distinct (kind, gram, toxic) of each: words where th is even, beginnings where it is odd."""
    for b in batches:
        for at, to, texts in slices(b.column(2)):
            odd = b.column(0).slice(at, to - at).to_numpy() % 2 != 0
            toxic = b.column(1).slice(at, to - at).to_numpy()
            plain = Words.mapped(_LOWER[(w := Words(texts)).data], w.ends)
            for kind, (doc, gram) in enumerate(((plain.doc, plain.hashes()), beginnings(plain))):
                mine = odd[doc] == bool(kind)
                pair = np.unique(np.stack((doc[mine].astype(np.uint64), gram[mine])), axis=1)
                own = pair[0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), kind, np.int32)), pa.array(pair[1].view(np.int64)), pa.array(toxic[own].astype(np.int32))], ["kind", "gram", "toxic"])


def mine(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_lexicon: int = MAX_LEXICON) -> Lexicon:
    """Words and beginnings far commoner in documents labelled toxic, from at most ``max_labelled`` labelled documents.

    Half of the sample, by text hash, teaches words and the other half
    beginnings, so that the two labellers do not learn from the same texts.
    """
    scratch = Scratch(docs.sparkSession, "lexicon")
    sample = scratch.save(samples.labelled(docs, labels, "toxic", max_labelled), "sample")
    size = {(r.kind, r.toxic): r.n for r in sample.groupBy((F.pmod("th", F.lit(2)) != 0).cast("int").alias("kind"), (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    grams = sample.select("th", (F.col("toxic") > 0).cast("int").alias("toxic"), "text").mapInArrow(_grams, "kind int, gram long, toxic int")
    counts = grams.groupBy("kind", "gram").agg(F.sum("toxic").alias("marked"), F.sum(1 - F.col("toxic")).alias("other"))
    found = []
    for kind in (0, 1):
        toxic, other = size.get((kind, 1), 0), size.get((kind, 0), 0)
        ratio = ((F.col("marked") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1))
        best = counts.where((F.col("kind") == kind) & (F.col("marked") >= MIN_MARKED) & (ratio >= MIN_RATIO)).orderBy(ratio.desc(), "gram").limit(max_lexicon)
        found.append(np.sort(np.array([r.gram for r in best.select("gram").collect()], np.int64).view(np.uint64)))
    scratch.drop("sample")
    return Lexicon(*found)


# --- classifier -------------------------------------------------------------


def _vote(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, texts in slices(b.column(2)):
                v = votes(Reading(texts), lexicon)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns[:2]), *(pa.array(pattern(v[q])) for q in QUESTIONS)], ["doc_id", "th", *QUESTIONS])

    return run


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to (doc_id, th, feature, value), both arrays."""
    for b in batches:
        for at, to, texts in slices(b.column(2)):
            d, f, x = features(Reading(texts))
            order = np.argsort(d, kind="stable")
            ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(np.bincount(d, minlength=to - at)))).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(ends), pa.array(y)) for y in (f[order].astype(np.int32), x[order].astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in b.columns[:2]), *lists], ["doc_id", "th", "feature", "value"])


def train(docs: DataFrame, lexicon: Lexicon, scratch: Scratch, max_training: int = MAX_TRAINING, max_features: int = MAX_FEATURES) -> dict[str, np.ndarray]:
    """Weights per question; empty for an empty table."""
    voted = scratch.save(samples.keyed(docs).select("doc_id", "th", "text").mapInArrow(_vote(lexicon), "doc_id long, th long, junk long, abuse long"), "votes")
    truth: dict[str, dict[int, float]] = {}
    for q in QUESTIONS:
        counted = voted.groupBy(q).count().collect()  # at most 3 ** LABELLERS[q] rows
        p, n = np.array([r[q] for r in counted], np.int64), np.array([r["count"] for r in counted], np.int64)
        order = np.argsort(p)
        truth[q] = dict(zip(p[order].tolist(), posterior(p[order], n[order], q).tolist(), strict=True)) if len(p) else {}
    picks = scratch.save(voted.groupBy("doc_id", "th").agg(*(F.min(q).alias(q) for q in QUESTIONS)).orderBy(*samples.order()).limit(max_training), "picks")
    texts = samples.texts_of_rows(docs, picks.select("doc_id", "th"))
    found = scratch.save(texts.mapInArrow(_featured, "doc_id long, th long, feature array<int>, value array<float>"), "features")
    same = F.col("f.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("f.th") == F.col("p.th"))
    rows = found.alias("f").join(picks.alias("p"), same).select("f.doc_id", "f.th", "feature", "value", *QUESTIONS)
    # documents in sampling order until their features are too many; at most max_training sizes are gathered to see where
    sizes = [r.n for r in found.select("doc_id", "th", F.size("feature").alias("n")).orderBy(*samples.order()).select("n").collect()]
    taken = int(np.searchsorted(np.cumsum(sizes), max_features, "right")) if sizes else 0
    table = rows.orderBy(*samples.order()).limit(max(taken, 1)).drop("doc_id", "th").toArrow()
    scratch.drop("votes", "picks", "features")
    if not table.num_rows:
        return {}
    lists = table.column("feature").combine_chunks()
    doc = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
    feature, value = lists.flatten().to_numpy().astype(np.int64), table.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    return {q: fit(doc, feature, value, np.array([truth[q][p] for p in table.column(q).to_pylist()])) for q in QUESTIONS}


def _score(weights: dict[str, np.ndarray], drop_above: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    sparse = {q: (np.flatnonzero(w), w[np.flatnonzero(w)]) for q, w in weights.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {q: np.zeros((1 << BITS) + 1, np.float32) for q in QUESTIONS}
        for q, (at, w) in sparse.items():
            dense[q][at] = w
        for b in batches:
            for at, to, texts in slices(b.column(1)):
                d, f, x = features(Reading(texts))
                scores = []
                for q in QUESTIONS:
                    z = np.bincount(d, weights=x * dense[q][f], minlength=to - at) + float(dense[q][-1])
                    scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                kept = (scores[0] <= drop_above) & (scores[1] <= drop_above)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), *(pa.array(s) for s in scores), pa.array(kept)], ["doc_id", *QUESTIONS, "kept"])

    return run


def classify(docs: DataFrame, labels: DataFrame | None = None, max_labelled: int = MAX_LABELLED, max_training: int = MAX_TRAINING, drop_above: float = DROP_ABOVE) -> DataFrame:
    """(doc_id, junk, abuse, kept) for each row of docs (doc_id, text; more columns are ignored).

    junk, abuse: probabilities by the trained scorer.  labels: (doc_id, toxic),
    of which a bounded sample teaches two of the labellers; without it they
    abstain.  A null text counts as empty; an empty one has no words and is
    scored by the bias and its statistics alone.  Null and repeated doc_ids are
    judged like any other; repeated rows count once in what is fitted.  An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "weak-labels")
    lexicon = Lexicon() if labels is None else mine(docs, labels, max_labelled)
    weights = train(docs, lexicon, scratch, max_training)
    return samples.keyed(docs).select("doc_id", "text").mapInArrow(_score(weights, drop_above), "doc_id long, junk double, abuse double, kept boolean")
