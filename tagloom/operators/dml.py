"""Changes to tables as algebra on immutable frames (OP-107, OP-108, OP-133 to OP-142)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch, hashed


def upsert(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of equal key; others are added (OP-133, OP-135, OP-172, OP-278)."""
    return table.join(new, key, "left_anti").unionByName(new.select(*table.columns))


def insert_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added (OP-134)."""
    return table.unionByName(new.select(*table.columns).dropDuplicates(key).join(table, key, "left_anti").select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Non-null values of ``changes`` replace those of equal key (OP-138)."""
    fresh = [c for c in changes.columns if c not in key]
    joined = table.alias("t").join(changes.alias("c"), key, "left")
    return joined.select(*(F.coalesce(f"c.{c}", f"t.{c}").alias(c) if c in fresh else F.col(c) if c in key else F.col(f"t.{c}") for c in table.columns))


def replace_children(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by its rows (OP-137, OP-142)."""
    return table.join(hashed(new.select(key).distinct()), key, "left_anti").unionByName(new.select(*table.columns))


def toggle(members: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Chosen keys leave if they are members and enter if not (OP-139)."""
    return members.select(key).join(chosen, key, "left_anti").unionByName(chosen.select(key).join(members, key, "left_anti"))


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the gone keys, and each child table without their rows (OP-140)."""
    return parents.join(gone, key, "left_anti"), {name: df.join(hashed(gone), key, "left_anti") for name, df in children.items()}


def next_order(pool_items: DataFrame) -> DataFrame:
    """(pool_id, next_order): one after the last place (OP-107)."""
    return pool_items.groupBy("pool_id").agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 1).alias("next_order"))


def reorder(pool_items: DataFrame, pool_id: int, item_id: int, to: int) -> DataFrame:
    """One item moved to a place of its pool, those between shifted by one (OP-108, OP-141)."""
    start = pool_items.where((F.col("pool_id") == pool_id) & (F.col("item_id") == item_id)).select(F.col("sort_order").alias("s"))
    at, s = F.col("sort_order"), F.col("s")
    moved = F.when(F.col("item_id") == item_id, F.lit(to)).when((at > s) & (at <= to), at - 1).when((at < s) & (at >= to), at + 1).otherwise(at)
    mine = pool_items.where(F.col("pool_id") == pool_id).join(F.broadcast(start), F.lit(True)).select("pool_id", "item_id", moved.cast("long").alias("sort_order"))  # one row in start
    return pool_items.where(F.col("pool_id") != pool_id).select("pool_id", "item_id", F.col("sort_order").cast("long").alias("sort_order")).unionByName(mine)


def trusted_predictions(predictions: DataFrame, least: float) -> DataFrame:
    """Predictions to keep (OP-142)."""
    return predictions.where(F.col("confidence") >= least)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``key``, 1 for the least of a column and so on, over any number of machines.

    Ranges of the column are dealt to partitions in order; a row's number is its
    place in its partition and the rows of the partitions before it.
    """
    scratch = Scratch(rows.sparkSession, "numbered")
    dealt = scratch.save(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return dealt.withColumn("__place", place).join(before, "__part").withColumn("key", (F.col("__before") + F.col("__place")).cast("long")).drop("__part", "__place", "__before")


def surrogate_keys(names: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, key): new names get keys after the greatest one, in order of name (OP-019, OP-271)."""
    fresh = names.select("name").where("name is not null").distinct()
    if existing is None:
        return numbered(fresh, "name").select("name", "key")
    top = existing.agg(F.coalesce(F.max("key"), F.lit(0)).alias("top"))  # one row
    keyed = numbered(fresh.join(existing, "name", "left_anti"), "name").join(F.broadcast(top), F.lit(True))
    return existing.select("name", F.col("key").cast("long").alias("key")).unionByName(keyed.select("name", (F.col("key") + F.col("top")).alias("key")))


def insert_items(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, outcome) of inserting items with their child rows at once (OP-136).

    tables, new: ``items`` (item_id, md5, filepath, ..), and children keyed by
    item_id.  An item whose md5, path or id is there already, or that comes
    twice, is refused with all its children; so is one whose only sources are
    complementary (``stands_alone`` true).  outcome: (item_id, inserted).
    """
    own, asked = tables["items"], new["items"]
    fresh = asked.dropDuplicates(["item_id"]).dropDuplicates(["md5"]).dropDuplicates(["filepath"])
    for key in ("item_id", "md5", "filepath"):
        fresh = fresh.join(own, key, "left_anti")
    if "stands_alone" in asked.columns:
        fresh = fresh.where("not stands_alone").drop("stands_alone")
    ids = fresh.select("item_id")
    out = {"items": own.unionByName(fresh.select(*own.columns))}
    out |= {k: v.unionByName(new[k].join(ids, "item_id", "left_semi").select(*v.columns)) if k in new else v for k, v in tables.items() if k != "items"}
    done = ids.withColumn("inserted", F.lit(True))
    return out, asked.select("item_id").distinct().join(done, "item_id", "left").select("item_id", F.coalesce("inserted", F.lit(False)).alias("inserted"))


def add_to_pool(pool_items: DataFrame, new: DataFrame) -> DataFrame:
    """The pools with items (pool_id, item_id) put at their ends, in order of id; members stay where they are (OP-107, OP-141)."""
    fresh = new.select("pool_id", "item_id").distinct().join(pool_items, ["pool_id", "item_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("pool_id").orderBy("item_id"))
    ends = pool_items.groupBy("pool_id").agg(F.max("sort_order").alias("top"))
    added = fresh.withColumn("p", place).join(ends, "pool_id", "left").select("pool_id", "item_id", (F.coalesce("top", F.lit(0)) + F.col("p")).cast("long").alias("sort_order"))
    return pool_items.select("pool_id", "item_id", F.col("sort_order").cast("long").alias("sort_order")).unionByName(added)


def remove_pools(pools: DataFrame, pool_items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pools and memberships without some pools (pool_id) (OP-141)."""
    return pools.join(gone, "pool_id", "left_anti"), pool_items.join(gone, "pool_id", "left_anti")
