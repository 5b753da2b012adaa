"""Classifier over tags and tag pairs by log-likelihood ratios (OP-187 to OP-201, OP-277)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.constants import MIN_CONFIDENCE, PAIR_MULTIPLIER, RATING_THRESHOLDS, RATINGS
from tagloom.functions.lineage import Scratch, small
from tagloom.operators.dml import numbered

EPSILON = 1e-10
#: Tags of an item whose pairs are scored, by name; None for all.
MAX_PAIR_TAGS = 100
PROVENANCE = "rating-source:"
#: Pairs of tags that a task holds at a time, and counts of pairs before they are sent.
PAIRS_AT_ONCE, COUNTS_HELD = 1 << 20, 1 << 21
#: Tags of weighed pairs up to whose square the places of their weights are a table of all pairs.
MAX_DENSE = 1 << 22
#: Weights that are looked up on arrays in each task: some 25 MB, which the driver holds too.
MAX_LOOKED_UP = 500_000


@dataclass(frozen=True)
class Config:
    """Settings of training and inference, numbers all (OP-201)."""

    threshold_general: float = RATING_THRESHOLDS[0]
    threshold_sensitive: float = RATING_THRESHOLDS[1]
    threshold_questionable: float = RATING_THRESHOLDS[2]
    threshold_explicit: float = RATING_THRESHOLDS[3]
    min_confidence: float = MIN_CONFIDENCE
    pair_multiplier: float = PAIR_MULTIPLIER
    min_training_samples: float = 50
    min_tag_frequency: float = 10
    min_pair_cooccurrence: float = 10
    max_pair_count: float | None = 25_000
    pruning_threshold: float = 0.01
    stale_after: float = 50

    @property
    def thresholds(self) -> tuple[float, ...]:
        return self.threshold_general, self.threshold_sensitive, self.threshold_questionable, self.threshold_explicit

    def updated(self, key: str, value: float) -> Config:
        """With one setting changed; an unknown name is an error."""
        if key not in {f.name for f in fields(self)}:
            raise KeyError(key)
        return replace(self, **{key: value})

    def table(self, like: DataFrame) -> DataFrame:
        """(key, value) of all settings."""
        return like.sparkSession.createDataFrame([(f.name, None if (v := getattr(self, f.name)) is None else float(v)) for f in fields(self)], "key string, value double")


def config_from(table: DataFrame) -> Config:
    """Settings from (key, value); what is missing has its default, and unknown keys are left out (OP-201)."""
    known = {f.name for f in fields(Config)}
    return replace(Config(), **{r.key: r.value for r in table.where(F.col("key").isin(*sorted(known))).collect()})  # a row per setting


def rated_items(item_tags: DataFrame) -> DataFrame:
    """(item_id, rating): the first rating in order of each rated item (OP-187, OP-110)."""
    place = F.array_position(F.array(*map(F.lit, RATINGS)), F.col("tag")) - 1
    return item_tags.where(F.col("tag").isin(*RATINGS)).groupBy("item_id").agg(F.min(place).cast("long").alias("rating"))


def features(item_tags: DataFrame, rated: DataFrame) -> DataFrame:
    """(item_id, rating, tag) of rated items, rating tags and their provenance left out."""
    return item_tags.where(~F.startswith("tag", F.lit("rating"))).select("item_id", "tag").join(rated, "item_id")


def llr(n_hit: Column, n_rating: Column, n_total: Column, n: Column) -> Column:
    """ln of a feature's rate within a rating over that without (OP-189)."""
    inside, outside = n_hit / n_rating, (n_total - n_hit) / (n - n_rating)
    return F.log(F.greatest(inside, F.lit(EPSILON)) / F.greatest(outside, F.lit(EPSILON)))


def _per_rating_counts() -> list[Column]:
    return [F.count_if(F.col("rating") == k).alias(str(k)) for k in range(len(RATINGS))]


def weigh(found: DataFrame, rated: DataFrame, key: list[str]) -> DataFrame:
    """(key, rating, weight, n) of every feature and rating, zero counts included; tiny weights go (OP-189, OP-191)."""
    return weigh_counts(found.groupBy(*key).agg(*_per_rating_counts()), rated, key)


def weigh_counts(hits: DataFrame, rated: DataFrame, key: list[str]) -> DataFrame:
    """The same from (key, "0", "1", ..): a feature's items of each rating."""
    per_rating = rated.groupBy("rating").agg(F.count("*").alias("n_rating"))  # four rows at most
    every = rated.agg(F.count("*").alias("n_all"))
    usable = per_rating.join(F.broadcast(every), F.lit(True)).where("n_rating < n_all")
    long = hits.select(*key, sum(F.col(str(k)) for k in range(len(RATINGS))).alias("n_total"), F.posexplode(F.array(*(F.col(str(k)) for k in range(len(RATINGS))))).alias("rating", "n"))
    w = llr(F.col("n"), F.col("n_rating"), F.col("n_total"), F.col("n_all"))
    return long.join(F.broadcast(usable), long.rating == usable.rating).select(*key, long.rating.cast("long").alias("rating"), w.alias("weight"), F.col("n").cast("long").alias("n")).where("abs(weight) > 0.01")


def pairs_of(keys: Column) -> Column:
    """Structs (k1, k2) of each two places of an array, the earlier first: n (n - 1) / 2 of n, laid out where the row is and never sent."""
    return F.flatten(F.transform(keys, lambda x, i: F.transform(F.slice(keys, i + 2, F.size(keys)), lambda y: F.struct(x.alias("k1"), y.alias("k2")))))


def _row_pairs(keys: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, k1, k2) of each two places of a row's array, the earlier first, some at a time; k1 and k2 have a line for each row."""
    flat, n = keys.flatten().to_numpy(), np.diff(keys.offsets.to_numpy())
    first = np.cumsum(n) - n
    for length in np.unique(n[n > 1]).tolist():
        rows = np.flatnonzero(n == length)
        one, step = length * (length - 1) // 2, max(1, PAIRS_AT_ONCE // length)
        if one <= PAIRS_AT_ONCE:
            i, j = np.triu_indices(length, 1)
            for at in range(0, len(rows), max(1, PAIRS_AT_ONCE // one)):
                some = rows[at : at + max(1, PAIRS_AT_ONCE // one)]
                own = flat[first[some][:, None] + np.arange(length)]
                yield some, own[:, i], own[:, j]
        else:  # a row of so many keys is laid out place by place
            for row in rows:
                own = flat[first[row] : first[row] + length]
                for at in range(0, length, step):
                    i, j = np.nonzero(np.arange(at, min(at + step, length))[:, None] < np.arange(length))
                    yield np.array([row]), own[None, at + i], own[None, j]


def _count_pairs(n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(k1, k2, rating, n) of rows (rating, keys), summed within the task as far as the held counts go; rating 4 stands for none of the four."""
    wide, kinds = n_keys + 1, len(RATINGS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, raw, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, n = np.unique(np.concatenate(raw), return_counts=True) if raw else (held[:0], counts[:0])
            every = np.concatenate([held, codes])
            order = np.argsort(every, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(every[order]) != 0])) if len(every) else order
            return every[order][starts], np.add.reduceat(np.concatenate([counts, n])[order], starts) if len(every) else counts

        def sent() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), 65536):
                pair, rating = np.divmod(held[at : at + 65536], kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair // wide, pair % wide, rating, counts[at : at + 65536])], ["k1", "k2", "rating", "n"])

        for b in batches:
            rating = b.column(0).fill_null(-1).to_numpy()
            rating = np.where((rating >= 0) & (rating < len(RATINGS)), rating, len(RATINGS))
            for row, k1, k2 in _row_pairs(b.column(1)):
                codes = ((k1 * wide + k2) * kinds + rating[row][:, None])[k1 < k2]
                raw.append(codes)
                waiting += len(codes)
                if waiting >= COUNTS_HELD:
                    held, counts = merged()
                    raw, waiting = [], 0
                    if len(held) > COUNTS_HELD:
                        yield from sent()
                        held, counts = held[:0], counts[:0]
        held, counts = merged()
        yield from sent()

    return run


def pair_counts(found: DataFrame, min_tag: int = 10, min_pair: int = 10, limit: int | None = 25_000) -> DataFrame:
    """(tag1, tag2, n, "0", "1", ..): pairs of frequent tags on one item, the commonest or all, with their items of each rating (OP-190).

    One pass over the items' pairs gives both what is frequent and what weights
    need.  Pairs are laid out and counted on arrays, and their counts are sent.
    """
    scratch = Scratch(found.sparkSession, "pair-counts")
    common = found.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_tag).select("tag").where("tag is not null")
    names, seen = scratch.save_counted(numbered(common, "tag"), "names")
    items = found.join(small(names, seen["n"]), "tag").groupBy("item_id", "rating").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    own = items.where("item_id is not null").select(F.col("rating").cast("long").alias("rating"), "keys")
    per_rating = [F.sum(F.when(F.col("rating") == k, F.col("n")).otherwise(0)).alias(str(k)) for k in range(len(RATINGS))]
    counted = own.mapInArrow(_count_pairs(seen["n"]), "k1 long, k2 long, rating long, n long")
    counts = counted.groupBy("k1", "k2").agg(F.sum("n").alias("n"), *per_rating).where(F.col("n") >= min_pair)
    named = lambda k: small(names.select(F.col("key").alias(f"k{k}"), F.col("tag").alias(f"tag{k}")), seen["n"])
    pairs = counts.join(named(1), "k1").join(named(2), "k2").select("tag1", "tag2", *counts.columns[2:])
    return pairs if limit is None else pairs.orderBy(F.desc("n"), "tag1", "tag2").limit(limit)


def frequent_pairs(found: DataFrame, min_tag: int = 10, min_pair: int = 10, limit: int | None = 25_000) -> DataFrame:
    """(tag1, tag2, n): pairs of frequent tags on one item, the commonest, or all of them (OP-190)."""
    return pair_counts(found, min_tag, min_pair, limit).select("tag1", "tag2", "n")


def pair_weights(counts: DataFrame, rated: DataFrame) -> DataFrame:
    """(tag1, tag2, rating, weight, n) of pairs as from ``pair_counts`` (OP-191)."""
    return weigh_counts(counts.drop("n"), rated, ["tag1", "tag2"])


def _per_rating(weights: DataFrame, key: list[str], times: float = 1.0) -> DataFrame:
    """(key, w): the weights of all ratings in one array, 0 where there is none."""
    each = [F.coalesce(F.max(F.when(F.col("rating") == k, F.col("weight") * times)), F.lit(0.0)) for k in range(len(RATINGS))]
    return weights.groupBy(*key).agg(F.array(*each).alias("w"))


def _sum_weights(table: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item_id, "0", "1", ..) of rows (item_id, own, first): the summed weights of own keys and of pairs of first keys that the table (k1, k2, w) has."""
    k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
    w = table.column("w").combine_chunks()
    w = np.vstack([np.zeros(len(RATINGS)), w.flatten().to_numpy().reshape(len(table), -1)])  # place 0: no weight
    known = np.unique(np.concatenate([k1, k2]))
    at, to = np.searchsorted(known, k1), np.searchsorted(known, k2)
    codes = at * len(known) + to
    order = np.argsort(codes)
    codes, dense = codes[order], len(known) ** 2 <= MAX_DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.zeros(len(known) ** 2 if dense else 0, np.int32)
        if dense:
            places[codes] = order + 1

        def place_of(code: np.ndarray) -> np.ndarray:
            if dense:
                return places[code]
            found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            return np.where(codes[found] == code, order[found] + 1, 0)

        for b in batches:
            if not len(known):
                break
            sums, hits = np.zeros((b.num_rows, len(RATINGS))), np.zeros(b.num_rows, np.int64)
            own, first = b.column(1), b.column(2)
            flat, row = own.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
            key = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            place = np.where(known[key] == flat, place_of(key * len(known) + key), 0)
            hits += np.bincount(row, place > 0, b.num_rows).astype(np.int64)
            for r in range(len(RATINGS)):
                sums[:, r] += np.bincount(row, w[place, r], b.num_rows)
            compact = pa.ListArray.from_arrays(pa.array(first.offsets.to_numpy() - first.offsets[0].as_py(), pa.int32()), pa.array(np.searchsorted(known, first.flatten().to_numpy())))
            for rows, x, y in _row_pairs(compact):
                place = place_of(x * len(known) + y)
                hits[rows] += (place > 0).sum(axis=1)
                for r in range(len(RATINGS)):
                    sums[rows, r] += w[:, r][place].sum(axis=1)
            there = hits > 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(there)), *(pa.array(sums[there, r]) for r in range(len(RATINGS)))], ["item_id", *map(str, range(len(RATINGS)))])

    return run


def scores(tags: DataFrame, weights: DataFrame, pair_w: DataFrame | None = None, multiplier: float = PAIR_MULTIPLIER, max_pair_tags: int | None = MAX_PAIR_TAGS) -> DataFrame:
    """(item_id, rating, score) of items (item_id, tag): tag weights, and 1.5 times pair weights over the first 100 tags by name, or over all (OP-194).

    Up to 500,000 weights are looked up on arrays; pairs of items meet more in a join.
    """
    scratch, tags = Scratch(tags.sparkSession, "scores"), tags.select("item_id", "tag")
    names = numbered(tags.select("tag").distinct(), "tag").join(_per_rating(weights, ["tag"]), "tag", "left").withColumn("paired", F.lit(False))
    if pair_w is not None:  # only tags that stand in some weighed pair are paired at all
        known = pair_w.select(F.col("tag1").alias("tag")).unionByName(pair_w.select(F.col("tag2").alias("tag"))).distinct().withColumn("known", F.lit(True))
        names = names.join(known, "tag", "left").withColumn("paired", F.coalesce("known", F.lit(False)))
    names, seen = scratch.save_counted(names.select(F.col("tag").alias("name"), "key", "w", "paired"), "names")
    # a name may stand in two categories; numbers are in order of name
    given = tags.join(small(names.drop("w"), seen["n"]), F.col("tag").eqNullSafe(F.col("name")))
    items = given.groupBy("item_id").agg(F.array_sort(F.collect_set(F.struct("key", "paired"))).alias("own"))
    table, first = names.where("w is not null").select(F.col("key").alias("k1"), F.col("key").alias("k2"), "w"), F.array().cast("array<long>")
    if pair_w is not None:
        first = F.col("own") if max_pair_tags is None else F.slice("own", 1, max_pair_tags)
        first = F.when(F.col("item_id").isNotNull(), F.transform(F.filter(first, lambda x: x.paired), lambda x: x.key)).otherwise(F.array().cast("array<long>"))
        key = lambda k: names.select(F.col("name").alias(f"tag{k}"), F.col("key").alias(f"k{k}"))
        table = table.unionByName(_per_rating(pair_w, ["tag1", "tag2"], multiplier).join(key(1), "tag1").join(key(2), "tag2").where("k1 < k2").select("k1", "k2", "w"))
    table, weighed = scratch.save_counted(table, "weights")
    items = items.select("item_id", F.transform("own", lambda x: x.key).alias("own"), first.alias("first"))
    if weighed["n"] <= MAX_LOOKED_UP:
        item = tags.schema["item_id"].dataType.simpleString()
        sums = items.mapInArrow(_sum_weights(table.toArrow()), f"item_id {item}, " + ", ".join(f"`{k}` double" for k in range(len(RATINGS))))
    else:
        laid = F.concat(F.transform("own", lambda x: F.struct(x.alias("k1"), x.alias("k2"))), pairs_of(F.col("first")))
        part = items.select("item_id", F.explode(laid).alias("p")).select("item_id", "p.k1", "p.k2").join(table, ["k1", "k2"]).select("item_id", "w")
        sums = part.groupBy("item_id").agg(*(F.sum(F.col("w")[k]).alias(str(k)) for k in range(len(RATINGS))))
    return sums.select("item_id", F.posexplode(F.array(*(F.col(str(k)) for k in range(len(RATINGS))))).alias("rating", "score"))


def softmax(scored: DataFrame) -> DataFrame:
    """(item_id, rating, p) (OP-195)."""
    w = Window.partitionBy("item_id")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select("item_id", "rating", (F.col("e") / F.sum("e").over(w)).alias("p"))


def decide(p: DataFrame, config: Config = Config()) -> DataFrame:
    """(item_id, rating, confidence): the likeliest rating, ties to the first, null below its threshold (OP-196)."""
    best = p.groupBy("item_id").agg(F.max(F.struct(F.round("p", 9).alias("p"), (-F.col("rating")).alias("r"))).alias("m"))
    place = (-F.col("m.r")).cast("int")
    needed = F.greatest(F.element_at(F.array(*map(F.lit, config.thresholds)), place + 1), F.lit(config.min_confidence))
    name = F.element_at(F.array(*map(F.lit, RATINGS)), place + 1)
    return best.select("item_id", F.when(F.col("m.p") >= needed, name).alias("rating"), F.round("m.p", 5).alias("confidence"))


def top_weighted(weights: DataFrame, rating: int, k: int) -> DataFrame:
    """The strongest tags of a rating (OP-200)."""
    return weights.where(F.col("rating") == rating).select("tag", F.round("weight", 3).alias("weight"), "n").orderBy(F.desc("weight"), F.desc("n"), "tag").limit(k)


def top_weighted_pairs(pair_w: DataFrame, rating: int, k: int) -> DataFrame:
    """The strongest tag pairs of a rating (OP-200)."""
    return pair_w.where(F.col("rating") == rating).select("tag1", "tag2", F.round("weight", 3).alias("weight"), "n").orderBy(F.desc("weight"), F.desc("n"), "tag1", "tag2").limit(k)


def pruned(weights: DataFrame, least: float) -> DataFrame:
    """Weights of at least so much either way (OP-192)."""
    return weights.where(F.abs("weight") >= least)


def train(item_tags: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame] | None:
    """Tag and pair weights; None with fewer rated items than needed (OP-192)."""
    scratch = Scratch(item_tags.sparkSession, "training")
    rated, seen = scratch.save_counted(rated_items(item_tags), "rated")
    if seen["n"] < config.min_training_samples:
        return None
    found = features(item_tags, rated)
    limit = None if config.max_pair_count is None else int(config.max_pair_count)
    pairs = pair_counts(found, int(config.min_tag_frequency), int(config.min_pair_cooccurrence), limit)
    tag_w, pair_w = weigh(found, rated, ["tag"]), pair_weights(pairs, rated)
    return tuple(scratch.save(pruned(w, config.pruning_threshold), name) for w, name in ((tag_w, "tags"), (pair_w, "pairs")))


def unrated(items: DataFrame, item_tags: DataFrame) -> DataFrame:
    """(item_id) of items without a rating (OP-188)."""
    return items.join(item_tags.where(F.col("tag").isin(*RATINGS)), "item_id", "left_anti").select("item_id")


def infer(items: DataFrame, item_tags: DataFrame, weights: DataFrame, pair_w: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(item_id, rating, confidence) of given items; without a tag that the model knows, null and 0 (OP-197, OP-277)."""
    own = item_tags.where(~F.startswith("tag", F.lit("rating"))).join(items.select("item_id"), "item_id", "left_semi")
    made = decide(softmax(scores(own, weights, pair_w, config.pair_multiplier)), config)
    return items.select("item_id").join(made, "item_id", "left").select("item_id", "rating", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def inference_stats(inferred: DataFrame) -> DataFrame:
    """(processed, rated, skipped_low, skipped_unknown, and one count per rating) of a run (OP-197, OP-277)."""
    r = F.col("rating")
    return inferred.agg(
        F.count("*").alias("processed"), F.count("rating").alias("rated"), F.count_if(r.isNull() & (F.col("confidence") > 0)).alias("skipped_low"), F.count_if(r.isNull() & (F.col("confidence") == 0)).alias("skipped_unknown"),
        *(F.count_if(r == name).alias(name.removeprefix("rating:")) for name in RATINGS),
    )


def set_ratings(facts: DataFrame, chosen: DataFrame, given_by: str = "user") -> DataFrame:
    """The facts with the ratings of chosen (item_id, rating) replaced, and a tag that tells who gave them; a null rating takes it away (OP-198)."""
    old = F.col("tag").isin(*RATINGS) | F.startswith("tag", F.lit(PROVENANCE))
    rest = facts.where(~old).unionByName(facts.where(old).join(chosen, "item_id", "left_anti"))
    meta = [F.lit("meta").alias("category"), F.lit(given_by).alias("source")]
    new = chosen.where("rating is not null").select("item_id", F.explode(F.array("rating", F.lit(PROVENANCE + given_by.replace("_", "-")))).alias("tag"), *meta)
    return rest.select("item_id", "tag", "category", "source").unionByName(new)


def rating_changes(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(item_id, tag, op) that ratings given by hand write into the change log (OP-198)."""
    old = facts.where(F.col("tag").isin(*RATINGS)).join(chosen, "item_id").where("rating is not null and tag <> rating").select("item_id", "tag", F.lit("remove").alias("op"))
    return chosen.where("rating is not null").select("item_id", F.col("rating").alias("tag"), F.lit("add").alias("op")).unionByName(old)


def pending_corrections(log: DataFrame, last_trained: str | None) -> DataFrame:
    """(pending): changes of ratings since the last training; none before the first one (OP-128, OP-199)."""
    since = F.lit(False) if last_trained is None else F.col("ts") > F.lit(last_trained).cast("timestamp_ntz")
    return log.where(since & F.startswith("tag", F.lit("rating:"))).agg(F.count("*").alias("pending"))


def model_stats(items: DataFrame, facts: DataFrame, log: DataFrame, last_trained: str | None, config: Config = Config()) -> DataFrame:
    """One row: trained, pending, stale, unrated, and ratings in total and by who gave them (OP-199)."""
    given = facts.where(F.col("tag").isin(*RATINGS))
    by = given.agg(F.count("*").alias("ratings"), *(F.count_if(F.col("source") == k).alias(name) for k, name in (("user", "by_user"), ("original", "by_source"), ("ai_inference", "by_model"))))
    pending = pending_corrections(log, last_trained)
    free = unrated(items, facts).agg(F.count("*").alias("unrated"))
    rows = pending.join(F.broadcast(free), F.lit(True)).join(F.broadcast(by), F.lit(True))  # one row each
    return rows.select(F.lit(last_trained is not None).alias("trained"), "pending", (F.col("pending") >= config.stale_after).alias("stale"), "unrated", "ratings", "by_user", "by_source", "by_model")


def without_inferred(facts: DataFrame) -> DataFrame:
    """The facts without ratings that the model gave (OP-199)."""
    return facts.where("source <> 'ai_inference'")


def retrain_and_reapply(items: DataFrame, facts: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame] | None:
    """(facts, inferred): the model's ratings cleared, the model trained anew, every unrated item rated again; None with too few rated items (OP-199)."""
    clean = without_inferred(facts)
    trusted = clean.where(F.col("source").isin("user", "original"))
    model = train(trusted, config)
    if model is None:
        return None
    inferred = infer(unrated(items, clean), clean, *model, config)
    return set_ratings(clean, inferred.where("rating is not null").select("item_id", "rating"), "ai_inference"), inferred
