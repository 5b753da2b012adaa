"""Order statistics of groups of any size, by counts and cumulative counts over ranges of values (OP-132, OP-263)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

QUARTILES = {"least": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "most": 1.0}


def ranked_values(rows: DataFrame, group: str, value: str, shares: Mapping[str, float]) -> DataFrame:
    """(group, n, one column per share, mean): the value of nearest rank, the rounded index (n - 1) q with halves to even, of each share q.

    Equal values are one row with their number.  These rows are dealt into
    ranges of (group, value); a range's sum tells how many values lie before the
    next one, so the range that holds a rank is known from the sums alone, and
    only there is a running count made, over one group's part of one range.  No
    group's values meet in one place.  A null group is a group; null values are
    left out; a group without others has no row; an empty table gives none.
    """
    scratch = Scratch(rows.sparkSession, "ranks")
    each = scratch.save(rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n")), "values")
    ranged = scratch.save(each.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranges")
    of_group = Window.partitionBy("g")
    sums = ranged.groupBy("g", "part").agg(F.sum("n").alias("here"))
    sums = sums.withColumn("upto", F.sum("here").over(of_group.orderBy("part"))).withColumn("total", F.sum("here").over(of_group))
    index = lambda q: F.rint((F.col("total") - 1) * F.lit(q)).cast("long")
    asked = F.array(*(F.struct(F.lit(name).alias("name"), (index(q) - F.col("upto") + F.col("here")).alias("at")) for name, q in shares.items()))
    wanted = sums.select("g", "part", F.filter(asked, lambda x: (x["at"] >= 0) & (x["at"] < F.col("here"))).alias("asked")).where(F.size("asked") > 0)
    same = F.col("r.g").eqNullSafe(F.col("w.g")) & (F.col("r.part") == F.col("w.part"))
    running = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v"))
    placed = ranged.alias("r").join(wanted.alias("w"), same).select("r.g", "r.part", "v", "n", "asked").withColumn("upto", running)
    found = placed.select("g", "v", F.explode(F.filter("asked", lambda x: (x["at"] < F.col("upto")) & (x["at"] >= F.col("upto") - F.col("n")))).alias("x")).select("g", "v", "x.name")
    picked = found.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares))
    whole = each.groupBy("g").agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    return whole.alias("a").join(picked.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g"))).select(F.col("a.g").alias(group), "n", *shares, "mean")
