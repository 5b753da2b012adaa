"""Domain tables derived from the supplied star schema, as DataFrames.

Items are orders; tags are words, types and brands of their parts; pools are
customers; sources are return flags; the change log is the event stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.lineage import MAX_BROADCAST_ROWS, Scratch, hashed, measured_broadcasts, small
from tagloom.operators import coded
from tagloom.sources.kept import forget, kept

T = TypeVar("T")
RATINGS = ("rating:general", "rating:sensitive", "rating:questionable", "rating:explicit")
SOURCE_PRIORITY = ("A", "N", "R")
#: What the tag table is made of.
TAG_TABLES = ("lineitem", "orders", "part")
#: Tags that a line's part gives its item.
TAGS_A_LINE = 6
#: Rows of the tag table that a file of its runs holds at most, repeats counted, so that a task sorts what fits its memory.
ROWS_A_FILE = 1_000_000
EXTENDED_PROXY = ("00_Subject_Count", "01_Body_Physique", "02_Body_Hair", "03_Body_Face")


def grams_of(text: Column, n: int = 3) -> Column:
    """The distinct runs of n characters of a text; none of a shorter one."""
    last = F.char_length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Catalog:
    """The domain tables of one data directory, each built when first asked for (OP-005, OP-159, OP-268).

    The tag table, which nearly every query joins, is written once per session
    as Parquet in the shared folder: as words of 64 items, sorted by tag within
    files, and laid out to a row per item and tag when first asked for as such.
    It and what is made of it is made anew when a file of its tables changes;
    ``refresh`` drops it at once (OP-006).
    """

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        measured_broadcasts(self.spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        o, key = self.raw("orders"), F.col("o_orderkey")
        before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        ext = F.when(F.col("o_orderstatus") == "F", ".png").when(F.col("o_orderstatus") == "O", ".jpg").otherwise(".mp4")
        width, height = 100 + key * 37 % 4000, 100 + key * 53 % 3000
        return o.select(
            key.alias("item_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("/ord_"), key.cast("string"), ext).alias("filepath"), F.md5(key.cast("string")).alias("md5"),
            key.alias("post_id"), F.when(key % 3 == 0, before).alias("parent_id"), F.when(key % 10 != 0, F.floor("o_totalprice")).cast("long").alias("score"), (key % 97).alias("fav_count"),
            F.col("o_orderdate").alias("ingested_at"), width.alias("image_width"), height.alias("image_height"), F.when(key % 4 == 0, width * 2).alias("upscaled_width"), F.when(key % 4 == 0, height * 2).alias("upscaled_height"),
            F.when(key % 11 != 0, F.element_at(F.array(*map(F.lit, SOURCE_PRIORITY)), (key % 3 + 1).cast("int"))).alias("active_source"),
        )

    def kept(self, name: str, make: Callable[[], T], tables: tuple[str, ...] = TAG_TABLES) -> T:
        """What is made once of some tables."""
        return kept(self.spark, self.sf_dir, name, tables, make)

    @property
    def _tag_runs(self) -> DataFrame:
        return self.kept("tag-runs", lambda: Scratch(self.spark, "tag-runs").save(self.derived_tag_runs(), "runs"))

    @property
    def _bridge(self) -> DataFrame:
        rows = lambda: coded.laid_out(self._tag_runs).select("item_id", "tag", "category", "word")
        return self.kept("bridge", lambda: Scratch(self.spark, "item-tags").save(rows(), "bridge"))

    @property
    def item_tags(self) -> DataFrame:
        return self._bridge.select("item_id", "tag", "category")

    @property
    def postings(self) -> DataFrame:
        """(word, item_id): items by tag in lower case, in stretches sorted by word (OP-048)."""
        return self._bridge.select("word", "item_id")

    @property
    def tag_bits(self) -> DataFrame:
        """(word, run, bits): the postings as words of 64 items; a condition on the word reaches the scan, and only words of several tags are aggregated (OP-047)."""
        rows = self._tag_runs.where("word is not null and run is not null")
        several = rows.where("not alone").groupBy("word", "run").agg(F.bit_or("bits").alias("bits"))
        return rows.where("alone").select("word", "run", "bits").unionByName(several)

    @property
    def tag_dictionary(self) -> DataFrame:
        """(word, tag_id): the tags numbered (OP-005)."""
        return self.kept("tag-dictionary", lambda: Scratch(self.spark, "tag-dictionary").save(coded.tag_dictionary(self.item_tags), "words"))

    @property
    def tag_grams(self) -> DataFrame:
        """(gram, word): the tags in which each three characters occur, sorted by these (OP-050)."""
        words = lambda: self.postings.select("word").distinct()
        return self.kept("tag-grams", lambda: Scratch(self.spark, "tag-grams").save(words().select(F.explode(grams_of(F.col("word"))).alias("gram"), "word").sortWithinPartitions("gram"), "grams"))

    @property
    def path_grams(self) -> DataFrame:
        """(gram, item_id): the same of paths."""
        rows = lambda: self.items.select(F.explode(grams_of(F.lower("filepath"))).alias("gram"), "item_id").repartitionByRange("gram").sortWithinPartitions("gram", "item_id")
        return self.kept("path-grams", lambda: Scratch(self.spark, "path-grams").save(rows(), "grams"))

    def refresh(self) -> None:
        """The next query makes the tag table and all that is made of it anew."""
        forget(self.spark, self.sf_dir)

    @cached_property
    def _part_kinds(self) -> DataFrame:
        """(p_partkey, w1, w2, kind, brand): what a part's tags are made of; parts alike in these give the same tags."""
        word = F.split("p_name", " ")
        return self.raw("part").select("p_partkey", word[0].alias("w1"), word[1].alias("w2"), F.lower("p_type").alias("kind"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("brand"))

    def derived_tag_runs(self) -> DataFrame:
        """(word, tag, category, alone, run, bits): each tag's items as words of 64, sorted by tag within files, ratings first.

        A line is dealt once, by the run of its item, with the number of its
        part's kind; there the kind's tags come in, repeats go and the bits come
        together, so that what is moved and written grows with the lines.  Too
        many kinds to broadcast: lines are dealt with the tags' numbers.
        alone: no other tag has the word.
        """
        scratch, made_of = Scratch(self.spark, "derived-tags"), ("w1", "w2", "kind", "brand")
        kinds, seen = scratch.save_counted(self._part_kinds.select(*made_of).distinct().withColumn("kind_id", F.monotonically_increasing_id()), "kinds")
        n_kinds, few_kinds = seen["n"], seen["n"] <= MAX_BROADCAST_ROWS
        tag = lambda name, category: F.struct(name.alias("tag"), F.lit(category).alias("category"))
        w1, w2, kind, brand = map(F.col, made_of)
        made = F.array(
            tag(w1, "general"), tag(w2, "general"), tag(kind, "copyright"), tag(brand, "artist"),
            tag(F.concat(w2, F.lit("_("), kind, F.lit(")")), "character"), tag(F.concat(w2, F.lit("_("), w1, F.lit(")_("), kind, F.lit(")")), "character"),
        )
        kind_tags = kinds.select("kind_id", F.explode(made).alias("t")).select("kind_id", "t.tag", "t.category")
        fixed = self.spark.createDataFrame([(r, "meta", -k) for k, r in enumerate((*RATINGS, None), 1)], "tag string, category string, code long")
        in_order = kind_tags.select("tag", "category").distinct().orderBy(F.lower("tag"), "tag", "category")  # numbers ascend with the words
        named = in_order.withColumn("code", F.monotonically_increasing_id()).unionByName(fixed).withColumn("word", F.lower("tag"))
        names, seen = scratch.save_counted(named.withColumn("alone", F.count("*").over(Window.partitionBy("word")) == 1), "names")
        by_name = kind_tags.tag.eqNullSafe(names.tag) & (kind_tags.category == names.category)
        coded_kinds = kind_tags.join(small(names, seen["n"]), by_name).groupBy("kind_id").agg(F.collect_set("code").alias("codes"))
        ratings = fixed.select(F.col("code").alias("kind_id"), F.array("code").alias("codes"))
        coded_kinds = scratch.save(coded_kinds.unionByName(ratings), "codes")
        alike = reduce(lambda x, y: x & y, (self._part_kinds[k].eqNullSafe(kinds[k]) for k in made_of))
        parts = self._part_kinds.join(small(kinds, n_kinds), alike).select("p_partkey", "kind_id")
        parts = hashed(parts) if few_kinds else parts.join(coded_kinds, "kind_id").select("p_partkey", "codes")
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("item_id"), "l_partkey")
        rows = TAGS_A_LINE * lines.count()
        several = max(-(-rows // ROWS_A_FILE), min(self.spark.sparkContext.defaultParallelism, -(-rows // 50_000)), 1)
        from_parts = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey")
        first = F.substring("o_orderpriority", 1, 1)
        place = F.when(first.isin("1", "2", "3", "4"), first).otherwise("5").cast("long")  # what sorts before 5 and is none of these has a null tag
        given = (-place).alias("kind_id") if few_kinds else F.array(-place).alias("codes")
        rated = self.raw("orders").where(first < "5").select(F.col("o_orderkey").alias("item_id"), given)
        dealt = from_parts.unionByName(rated).withColumn("run", coded.run_of(F.col("item_id"))).repartition(several, "run")
        dealt = dealt.join(F.broadcast(coded_kinds), "kind_id") if few_kinds else dealt
        runs = dealt.select("run", "item_id", F.explode("codes").alias("code")).groupBy("run", "code").agg(F.bit_or(coded.bit_of("item_id")).alias("bits"))
        return runs.join(small(names, seen["n"]), "code").sortWithinPartitions("code", "run").select("word", "tag", "category", "alone", "run", "bits")

    @cached_property
    def tags(self) -> DataFrame:
        extended = F.when(F.col("category").isin("general", "copyright"), F.element_at(F.array(*map(F.lit, EXTENDED_PROXY)), F.length("tag") % 4 + 1))
        return self.item_tags.select("tag", "category").distinct().withColumn("extended_category", extended)

    @cached_property
    def item_sources(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_returnflag").alias("source")).distinct()

    @cached_property
    def pools(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("pool_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))

    @cached_property
    def pool_items(self) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        return self.raw("orders").select(F.col("o_custkey").alias("pool_id"), F.col("o_orderkey").alias("item_id"), place.cast("long").alias("sort_order"))

    @cached_property
    def favourites(self) -> DataFrame:
        return self.raw("orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def predictions(self) -> DataFrame:
        parts = self.raw("part").select("p_partkey", F.split("p_name", " ")[1].alias("tag"))
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("item_id"), "l_partkey", (F.col("l_discount") * 10).alias("c"))
        return lines.join(hashed(parts), F.col("l_partkey") == F.col("p_partkey")).groupBy("item_id", "tag").agg(F.max("c").alias("confidence")).withColumn("category", F.lit("general"))

    @cached_property
    def facts(self) -> DataFrame:
        """The tag table with who gave each tag."""
        given = F.element_at(F.array(*map(F.lit, ("implication", "ai_inference", "user"))), F.least((F.col("item_id") + F.length("tag")) % 10, F.lit(2)).cast("int") + 1)
        return self.item_tags.withColumn("source", F.when((F.col("item_id") + F.length("tag")) % 10 < 3, given).otherwise("original"))

    @cached_property
    def metadata(self) -> DataFrame:
        """(item_id, data): JSON of up to three sources per item, in their four shapes, from the event table."""
        k, user = F.get_json_object("props", "$.k").cast("long"), F.col("user_id")
        code = F.substring(F.lit("gsqe"), (k % 4 + 1).cast("int"), F.lit(1))
        text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
        first = text('"alpha": {"id": ', F.col("event_id"), ', "parent_id": ', user, ', "has_children": true, "rating": "', code, '", "score": ', k, ', "tag_string_character": "hero', k % 7, '", "tag_string_general": "', F.col("event_type"), " shared", k % 5, '"}')
        second = text('"beta": {"id": ', F.col("event_id") + 1_000_000, ', "relationships": {"parent_id": ', k, '}, "rating": "s", "score": {"total": ', k, '}, "tags": {"general": ["', F.col("event_type"), '", "extra"], "species": ["shared', k % 5, '"], "artist": ["u', user, '"]}}')
        third_tags = F.when(F.col("event_id") % 10 == 0, text('["plain", "shared', k % 5, '"]')).otherwise(text('"plain shared', k % 5, '"'))
        third = text('"gamma": {"id": ', F.col("event_id") + 2_000_000, ', "tags": ', third_tags, "}")
        given = F.array_compact(F.array(F.when(F.col("event_id") % 3 > 0, first), F.when(F.col("event_id") % 2 == 0, second), F.when(F.col("event_id") % 5 == 0, third)))
        return self.raw("events").select(F.col("event_id").alias("item_id"), F.concat(F.lit('{"sources": {'), F.array_join(given, ", "), F.lit("}}")).alias("data"))

    @cached_property
    def deltas(self) -> DataFrame:
        op = F.when(F.col("event_type").isin("click", "view", "purchase"), "add").otherwise("remove")
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("md5"), F.col("event_type").alias("tag"), op.alias("op"), "ts")

    @cached_property
    def signatures(self) -> DataFrame:
        """64 sign bits of each vector as two 32-bit words."""
        def word(first: int) -> Column:
            bits = [F.when(F.col("embedding")[first + i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(32)]
            total = bits[0]
            for b in bits[1:]:
                total = total + b
            return total

        return self.raw("embeddings").select(F.col("vec_id").alias("item_id"), word(0).alias("w0"), word(32).alias("w1"))
