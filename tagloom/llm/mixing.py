"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

Each document gets an exponential key, -ln(u) / quality, with u from a hash of
its id and text, so reruns agree.  A source's target is some complete epochs of
all its documents, then a fraction: documents in key order until the budget of
words is spent, the last one in part.

The order within a source is never laid out in one task.  Keys fall into bins
of a few thousand documents by a monotone function; sizes are summed per bin,
bins are prefix-summed, and only the one bin in which a source's budget ends is
sorted, in which repeated rows count once with their number.  So each source
has one document at which its budget ends, the cut, and every row compares
itself with it; only copies of the cut are numbered, in their partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Documents that share a bin, about.
BIN_DOCUMENTS = 4096


def quality_weight() -> Column:
    """Between 0 and 1: how near a text's characters per word are to those of prose, about six with the gap."""
    mean = F.col("chars") / F.greatest(F.col("size"), F.lit(1))
    return 1.0 / (1.0 + F.abs(mean - 6.0) / 6.0)


def _measures(seed: int) -> dict[str, Column]:
    """What the order within a source needs of a row; ties in key go by id, null last, then text hash and size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {
        "source": F.col("source").cast("string"), "size": F.regexp_count(text, F.lit(WORD)).cast("long"), "chars": F.char_length(text),
        "no_id": F.col("doc_id").isNull(), "id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "th": F.xxhash64(text), "h": F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text), F.lit(seed)),
    }


def exponential_key() -> Column:
    """Of a row with ``_measures``; least keys go first."""
    u = (F.shiftrightunsigned("h", 12) + 0.5) / float(2**52)
    return -F.log(u) / quality_weight()


def _place() -> Column:
    """A row's place in its source's order; equal only for repeated rows."""
    return F.struct("key", "no_id", "id", "th", "size")


def targets(per_source: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, n, source_size, target, epochs, rest) from (source, n, source_size).

    Filling by weight until no source is above its ceiling is one level: sources
    in order of ceiling / weight are capped while the level that is left for the
    others reaches them.  There is one row per source, so its windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    rows = per_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * float(share)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    rows = rows.withColumn("place", F.row_number().over(by_ratio))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))).over(every)["level"])
    rows = rows.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return rows.withColumn("epochs", epochs).select(
        "source", "n", "source_size", "target", "epochs", (F.round("target").cast("long") - F.col("epochs") * F.col("source_size")).alias("rest"), "mean_key"
    )


def _limits(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float, bin_documents: int, scratch: Scratch) -> DataFrame:
    """One row per source: (source, source_size, target, epochs, rest, cut, room): the cut's place and the words of it and its copies that are taken; null without one.

    sized: (source, size, key, no_id, id, th).
    """
    per_source = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.avg("key").alias("mean_key"))
    goal = scratch.save(targets(per_source, weights, share, max_epochs), "targets")
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    bins = F.ceil(F.col("n") / bin_documents)
    # 1 - exp(-key / mean) rises with the key and spreads exponential keys evenly
    at = F.least(F.floor((1.0 - F.exp(-F.col("key") / F.col("mean_key"))) * bins), bins - 1).cast("long")
    binned = sized.alias("s").join(goal.alias("g"), same).where("rest > 0").select("s.*", "rest", at.alias("bin"))
    sums = binned.groupBy("source", "bin", "rest").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    ends = sums.withColumn("before", upto - F.col("words")).where("before < rest and before + words >= rest").groupBy("source").agg(F.min(F.struct("bin", "before")).alias("e")).select("source", "e.bin", "e.before")
    ends = scratch.save(ends, "ends")
    last = binned.alias("s").join(ends.alias("g"), same & (F.col("s.bin") == F.col("g.bin"))).select("s.*", "before")
    items = last.groupBy("source", "rest", "before", _place().alias("cut")).agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum("words").over(earlier), F.lit(0))
    cuts = items.withColumn("room", room).where("room > 0 and room <= words").groupBy("source").agg(F.min(F.struct("cut", "room")).alias("e")).select("source", "e.cut", "e.room")
    out = goal.alias("s").join(cuts.alias("g"), same, "left").select("s.source", "source_size", "target", "epochs", "rest", "cut", "room")
    return scratch.save(out, "limits")


def _taken(rows: DataFrame, limits: DataFrame, scratch: Scratch) -> DataFrame:
    """rows, of which the columns of ``_place`` and source are used, with source_size, target, epochs and more: what the fractional epoch takes of each."""
    # the cut is known by what does not depend on how a machine rounds logarithms; a source without one has a budget of nothing
    is_cut = F.coalesce(reduce(lambda x, y: x & y, (F.col(c) == F.col(f"cut.{c}") for c in ("no_id", "id", "th", "size"))), F.lit(False))
    joined = rows.alias("s").join(limits.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "source_size", "target", "epochs", "rest", "cut", "room").withColumn("is_cut", is_cut)
    other = joined.where("not is_cut").withColumn("more", F.when(_place() < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    # copies of the cut, each source's one document: numbered in the partitions of a written table, then over them
    copies = scratch.save(joined.where("is_cut").withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("uid", 33)), "copies")
    counts = copies.groupBy("source", "part").agg(F.count("*").alias("c"))
    before = counts.withColumn("earlier", F.sum("c").over(Window.partitionBy("source").orderBy("part")) - F.col("c"))
    number = F.row_number().over(Window.partitionBy("source", "part").orderBy("uid")) - 1
    numbered = copies.withColumn("number", number).alias("s").join(before.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")) & (F.col("s.part") == F.col("g.part"))).select("s.*", "earlier")
    left = F.col("room") - (F.col("earlier") + F.col("number")) * F.col("size")
    numbered = numbered.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    gone = ("rest", "cut", "room", "is_cut")
    return other.drop(*gone).unionByName(numbered.drop(*gone, "uid", "part", "number", "earlier"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 20240601, bin_documents: int = BIN_DOCUMENTS) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for each row of docs (doc_id, text, source).

    size: words of the text (null: 0); taken: words that the mix takes of it,
    ``epochs`` times all of them and once more all, a first part, or none.
    Sources in code point order, null last as a source of its own, weigh
    ``weights`` in turn.  Sources without words have target 0.  Rows alike in id
    and text tie; which of them the fraction takes changes nothing but their
    order.  Null and repeated ids are documents like any other.  More columns
    are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in _measures(seed).items()))
    sized = scratch.save(measured.withColumn("key", exponential_key()).drop("h", "chars"), "sized")
    limits = _limits(sized.drop("doc_id"), weights, share, max_epochs, bin_documents, scratch)
    return _taken(sized, limits, scratch).select("doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("int").alias("epochs"), (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = 20240601, bin_documents: int = BIN_DOCUMENTS) -> DataFrame:
    """The mixture itself: each row of docs as often as its epochs say, and the last, partial epoch's first words.

    All columns stay; a shortened text has its words joined by one space (and
    ``n_chars`` counted anew where it exists).  Documents of which the mix takes
    nothing, wordless ones among them, are gone.  Rows are treated as by
    ``mix``: each of some repeated rows is taken for itself, so the words that
    come out are those that ``mix`` takes.  An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "apply-mix")
    measures = _measures(seed)
    sized = scratch.save(docs.select(*(c.alias(k) for k, c in measures.items())).withColumn("key", exponential_key()).drop("h", "chars"), "sized")
    limits = _limits(sized, weights, share, max_epochs, bin_documents, scratch)
    scratch.drop("sized")
    # the texts are read again and decided row by row, never shuffled; the row itself is one column, so names cannot clash
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in measures.items())).withColumn("key", exponential_key()).drop("h", "chars")
    taken = _taken(whole, limits, scratch)
    part = F.when(F.col("more") < F.col("size"), F.col("more")).otherwise(F.lit(0))
    times = (F.col("epochs") + F.when((F.col("size") > 0) & (F.col("more") == F.col("size")), 1).otherwise(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.when(F.col("size") > 0, times).otherwise(0)), F.when(part > 0, F.array(part.cast("long"))).otherwise(F.array().cast("array<bigint>")))
    spread = taken.select("row", F.explode(copies).alias("words"))
    text = F.col("row.text").cast("string")
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), 1, F.greatest(F.lit(1), F.col("words").cast("int"))), " ")
    shown = F.when(F.col("words") > 0, first_words).otherwise(text)
    kind = {f.name: f.dataType for f in docs.schema.fields}
    own = {"text": shown.cast(kind["text"])}
    if "n_chars" in kind:
        own["n_chars"] = F.when(F.col("words") > 0, F.char_length(shown)).otherwise(F.col("row.n_chars")).cast(kind["n_chars"])
    return spread.select(*(own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
