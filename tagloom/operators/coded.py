"""Tags as integers and as bits (OP-005, OP-047).

A dictionary numbers the tags in order of name, so an item is an array of small
integers.  For conditions on several tags, each tag has words of 64 bits, one
for each run of 64 item ids in which it occurs; a conjunction is the bitwise
AND of the words of a run, an exclusion its AND with the complement.  Only runs
that hold a tag have a row, so a rare tag costs no more than its postings and a
common one up to 64 times less, in the table and in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.dml import surrogate_keys


def run_of(item: Column) -> Column:
    """The number of the run of 64 ids that holds an id, for ids below zero too."""
    return F.shiftright(item.cast("long"), 6)


def bit_of(item: str) -> Column:
    """The word of a run in which an id alone is set."""
    return F.expr(f"shiftleft(1L, cast(cast({item} as long) & 63 as int))")


def bit_at(bits: Column | str, item: Column | str) -> Column:
    """Whether the bit of an id is set in the word of its run."""
    return F.getbit(bits, (F.col(item) if isinstance(item, str) else item).cast("long").bitwiseAND(F.lit(63)).cast("int")) == 1


def tag_dictionary(item_tags: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(word, tag_id) of the tags in lower case, from 1 on; those of an existing dictionary keep their numbers (OP-005)."""
    names = item_tags.select(F.lower("tag").alias("name"))
    old = None if existing is None else existing.select(F.col("word").alias("name"), F.col("tag_id").alias("key"))
    return surrogate_keys(names, old).select(F.col("name").alias("word"), F.col("key").alias("tag_id"))


def coded_items(item_tags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(item_id, tag_ids): each item's tags as ascending integers; tags outside the dictionary are left out (OP-005)."""
    rows = item_tags.select("item_id", F.lower("tag").alias("word")).join(dictionary, "word")
    return rows.groupBy("item_id").agg(F.array_sort(F.collect_set("tag_id")).alias("tag_ids"))


def decoded_items(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(item_id, word) of coded items."""
    return coded.select("item_id", F.explode("tag_ids").alias("tag_id")).join(dictionary, "tag_id").select("item_id", "word")


def tag_bits(postings: DataFrame) -> DataFrame:
    """(word, run, bits) of postings (word, item_id); repeated rows count once, null words and ids not at all."""
    return postings.where("word is not null and item_id is not null").groupBy("word", run_of(F.col("item_id")).alias("run")).agg(F.bit_or(bit_of("item_id")).alias("bits"))


def bits_updated(bits: DataFrame, postings: DataFrame, changed: DataFrame) -> DataFrame:
    """The bits after items (item_id) changed: the runs that hold one are made anew from the postings as they are now (OP-009)."""
    runs = changed.select(run_of(F.col("item_id")).alias("run")).distinct()
    fresh = tag_bits(postings.withColumn("run", run_of(F.col("item_id"))).join(runs, "run", "left_semi").drop("run"))
    return bits.join(runs, "run", "left_anti").select("word", "run", "bits").unionByName(fresh)


def combined(bits: DataFrame, every: Sequence[str], none: Sequence[str] = ()) -> DataFrame:
    """(run, bits) of ids that have each word of ``every`` and no word of ``none``; runs without any are left out.

    One aggregate over the words' own rows; the words reach the scan.  Without
    ``every`` the complement of an unknown set is asked for, which has no rows:
    see ``with_words``.
    """
    if not every:
        raise ValueError("an exclusion alone has no finite set of ids")
    null = F.lit(None).cast("long")
    rows = bits.where(F.col("word").isin(*every)).select("run", F.col("bits").alias("held"), null.alias("barred"))
    if none:
        rows = rows.unionByName(bits.where(F.col("word").isin(*none)).select("run", null.alias("held"), F.col("bits").alias("barred")))
    both = rows.groupBy("run").agg(F.count("held").alias("n"), F.bit_and("held").alias("held"), F.bit_or("barred").alias("barred"))
    left = F.col("held").bitwiseAND(F.bitwise_not(F.coalesce("barred", F.lit(0).cast("long"))))
    return both.where(F.col("n") == len(set(every))).select("run", left.alias("bits")).where("bits <> 0")


def with_words(items: DataFrame, bits: DataFrame, every: Sequence[str], none: Sequence[str] = ()) -> DataFrame:
    """Items that have every word of one list as a tag and none of the other; all columns stay (OP-041, OP-047).

    A run meets at most one row of bits, so no item is multiplied.
    """
    if not every and not none:
        return items
    keyed = items.withColumn("__run", run_of(F.col("item_id")))
    if every:
        hit = combined(bits, every, none).select(F.col("run").alias("__run"), F.col("bits").alias("__bits"))
        return keyed.join(hit, "__run").where(bit_at("__bits", "item_id")).drop("__run", "__bits")
    barred = bits.where(F.col("word").isin(*none)).groupBy("run").agg(F.bit_or("bits").alias("__bits")).withColumnRenamed("run", "__run")
    return keyed.join(barred, "__run", "left").where(F.col("__bits").isNull() | ~bit_at("__bits", "item_id")).drop("__run", "__bits")


def items_of(found: DataFrame) -> DataFrame:
    """(item_id) of (run, bits)."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit("bits", k) == 1)
    return found.select("run", F.explode(places).alias("k")).select((F.shiftleft("run", 6) + F.col("k")).alias("item_id"))


def laid_out(found: DataFrame) -> DataFrame:
    """Rows of runs with a row for each id (item_id); a null run stands for a null id.  Loops over places in compiled code, where ``items_of`` builds an array."""
    k = F.col("__k")
    there = (F.getbit("bits", k) == 1) | F.col("run").isNull() & (k == 0)
    rows = found.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(there)
    return rows.withColumn("item_id", F.shiftleft("run", 6) + k).drop("__k", "run", "bits")


def counted(found: DataFrame) -> DataFrame:
    """(n): how many ids (run, bits) holds, without laying them out (OP-103)."""
    return found.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))
