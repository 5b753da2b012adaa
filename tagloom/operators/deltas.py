"""The change log: differences, folds and replay (OP-118, OP-240 to OP-245)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

#: Span of a log whose times are plain numbers.
COUNTED_SPAN = 1 << 16


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(item_id, tag, op) that turns one tag table into another (OP-118, OP-241)."""
    key = ["item_id", "tag"]
    added = new.select(*key).distinct().join(old, key, "left_anti").withColumn("op", F.lit("add"))
    removed = old.select(*key).distinct().join(new, key, "left_anti").withColumn("op", F.lit("remove"))
    return added.unionByName(removed)


def net_state(log: DataFrame) -> DataFrame:
    """(md5, tag, op): an add that is later removed cancels; a removal that is later added is an add (OP-243).

    Only the last two operations count: an add is an add, a removal right after
    an add is nothing, any other a removal.  So two aggregates do, and no key's
    history is gathered.
    """
    key, at = ["md5", "tag"], F.struct("ts", "id")
    last = log.groupBy(*key).agg(F.max(F.struct("ts", "id", "op")).alias("last"))
    earlier = log.join(last, key).where(at < F.struct("last.ts", "last.id")).groupBy(*key).agg(F.max_by("op", at).alias("before"))
    state = F.when(F.col("last.op") == "add", "add").when(F.col("before") == "add", "none").otherwise("remove")
    return last.join(earlier, key, "left").select(*key, state.alias("op")).where("op <> 'none'")


def compacted(log: DataFrame, span: str = "day") -> DataFrame:
    """(md5, tag, op): each operation cancels the opposite one before it, either way round (OP-240, OP-244).

    The state is a walk between -1 (remove), 0 and 1 (add) that stops at its
    ends.  Two equal operations in a row settle it; after that operations
    alternate, so it depends on how many follow.  A key's log is cut into spans
    of time, each summed up by its first operation, its last settling pair and
    the number of operations after it; a fold over spans gives the state, so no
    task holds more of a key than a span.
    """
    sign = F.when(F.col("op") == "add", 1).otherwise(-1)
    timed = isinstance(log.schema["ts"].dataType, (TimestampType, TimestampNTZType))
    part = F.date_trunc(span, "ts") if timed else F.floor(F.col("ts") / COUNTED_SPAN)
    rows = log.select("md5", "tag", "ts", "id", sign.alias("s"), part.alias("span"))
    within = Window.partitionBy("md5", "tag", "span").orderBy("ts", "id")
    placed = rows.withColumn("k", F.row_number().over(within)).withColumn("settles", F.lag("s").over(within) == F.col("s"))
    parts = placed.groupBy("md5", "tag", "span").agg(F.count("*").alias("n"), F.min_by("s", "k").alias("first"), F.max(F.when(F.col("settles"), F.struct("k", "s"))).alias("settled"))

    def after(state: Column, part: Column) -> Column:
        # alternating operations from a known state: the first moves it unless it is there already, then each undoes the one before
        odd = lambda n: n % 2 == 1
        from_settled = F.when(odd(part["n"] - part["settled"]["k"]), 0).otherwise(part["settled"]["s"])
        same = F.when(odd(part["n"]), part["first"]).otherwise(0)
        against = F.when(odd(part["n"]), 0).otherwise(-part["first"])
        return F.when(part["settled"].isNotNull(), from_settled).when(state == -part["first"], against).otherwise(same)

    spans = F.array_sort(F.collect_list(F.struct("span", "n", "first", "settled")))  # a row per span of time
    state = F.aggregate("spans", F.lit(0), lambda s, p: after(s, p).cast("int"))
    folded = parts.groupBy("md5", "tag").agg(spans.alias("spans")).select("md5", "tag", state.alias("state")).where("state <> 0")
    return folded.select("md5", "tag", F.when(F.col("state") == 1, "add").otherwise("remove").alias("op"))


def last_operation(log: DataFrame) -> DataFrame:
    """(md5, tag, op): the latest of each; a partial aggregate, since only one row per key is kept (OP-242)."""
    return log.groupBy("md5", "tag").agg(F.max_by("op", F.struct("ts", "id")).alias("op"))


def replay(facts: DataFrame, log: DataFrame) -> DataFrame:
    """(md5, tag) after the log: last additions in, last removals out (OP-242)."""
    last = last_operation(log)
    kept = facts.select("md5", "tag").join(last.where("op = 'remove'"), ["md5", "tag"], "left_anti")
    return kept.unionByName(last.where("op = 'add'").select("md5", "tag")).distinct()


def clear(log: DataFrame, md5: str | None = None) -> DataFrame:
    """The log without one entity's rows, or empty (OP-245)."""
    return log.where(F.lit(False)) if md5 is None else log.where(F.col("md5") != md5)
