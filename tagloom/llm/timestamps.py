"""Times written in many ways and zones as microseconds of UTC, by enumeration of offsets.

A wall time in a zone is tried with each offset that the zone ever has: the
offset is subtracted, and what results is rendered in the zone again.  One
offset renders back, as a rule.  None does if the wall time was skipped, and two
if it was repeated; then the offsets next to that change decide.

Dates with slashes are read day first or month first.  Those that are possible
in one order only vote for it within their source, and the others follow.  All
of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch

#: Votes for an order must be more than so many times those for the other.
MAJORITY = 1
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
BLANKS = " \t\n\x0b\f\r"

_Y, _N = "(20[0-9][0-9])", "([0-9][0-9])"
# groups 1-3 y-m-d, 4-6 ymd, 7-9 d.m.y, 10-12 d b y, 13-15 with slashes, 16-20 hour, minute, second, half of the day, offset
_DATE = "|".join((f"{_Y}-{_N}-{_N}", f"{_Y}{_N}{_N}", f"{_N}[.]{_N}[.]{_Y}", rf"{_N}\x20({'|'.join(MONTHS)})\x20{_Y}", f"{_N}/{_N}/{_Y}"))
PATTERN = rf"\A(?:{_DATE})(?:[T\x20]{_N}:{_N}(?::{_N})?(?:\x20?([AP])M)?(?:\x20?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?\z"
_FIELDS = "$1$4$9$12$15,$2$5$8$11,$3$6$7$10,$13,$14,$16,$17,$18,$19,$20"


def _days(rows: DataFrame, name: str, month: str, day: str) -> DataFrame:
    """rows with the days since 1970 of their year, month and day columns, null if there is no such day; years 2000 to 2099, of which each fourth is a leap year."""
    year, m, d = F.col("year"), F.col(month), F.col(day)
    length = F.when(m == 2, F.when(year % 4 == 0, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    rows = rows.withColumn("there", F.coalesce(F.col("fits") & m.between(1, 12) & (d >= 1) & (d <= length), F.lit(False)))
    known = F.make_date(F.when(F.col("there"), year).otherwise(2000), F.when(F.col("there"), m).otherwise(1), F.when(F.col("there"), d).otherwise(1))
    return rows.withColumn(name, F.when(F.col("there"), F.unix_date(known))).drop("there")


def parse(stamps: DataFrame) -> DataFrame:
    """stamp_id, source and zone with epoch_us, or day_first and month_first (days since 1970, equal for all but dates with slashes, null if impossible), second_of_day and offset (null: as the zone has it).

    Each step's numbers are columns of a projection, so that later steps do not work them out again.
    """
    text = F.btrim("raw", F.lit(BLANKS))
    rows = stamps.select("stamp_id", "source", "zone", text.alias("text"))
    rows = rows.withColumn("f", F.split(F.when(F.col("text").rlike(PATTERN), F.regexp_replace("text", PATTERN, _FIELDS)), ","))
    number = lambda k: F.when(F.col("f")[k] != "", F.col("f")[k]).cast("int")
    second = F.col("f")[1]
    month = F.when(F.length(second) == 3, ((F.instr(F.lit("".join(MONTHS)), second) + 2) / 3).cast("int")).otherwise(number(1))
    named = {"year": number(0), "m": F.coalesce(number(4), month), "d": F.coalesce(number(3), number(2)), "hour": F.coalesce(number(5), F.lit(0)), "minute": F.coalesce(number(6), F.lit(0)), "second": F.coalesce(number(7), F.lit(0))}
    rows = rows.select("stamp_id", "source", "zone", "text", *(c.alias(k) for k, c in named.items()), (F.col("f")[3] != "").alias("slashed"), F.col("f")[8].alias("half"), F.col("f")[9].alias("sign"))
    with_sign = F.length("sign") > 1
    rows = rows.withColumn("off_hour", F.when(with_sign, F.substring("sign", 2, 2)).cast("int")).withColumn("off_minute", F.when(with_sign, F.right("sign", F.lit(2))).cast("int"))
    hour_is = F.when(F.col("half") == "", F.col("hour") <= 23).otherwise(F.col("hour").between(1, 12))
    off_is = ~with_sign | ((F.col("off_hour") <= 14) & (F.col("off_minute") <= 59))
    rows = rows.withColumn("fits", hour_is & (F.col("minute") <= 59) & (F.col("second") <= 59) & off_is)
    rows = _days(rows.withColumn("m2", F.when(F.col("slashed"), F.col("d")).otherwise(F.col("m"))).withColumn("d2", F.when(F.col("slashed"), F.col("m")).otherwise(F.col("d"))), "day_first", "m", "d")
    rows = _days(rows, "month_first", "m2", "d2")
    in_day = F.when(F.col("half") == "", F.col("hour")).otherwise(F.col("hour") % 12 + F.when(F.col("half") == "P", 12).otherwise(0))
    offset = F.when(F.col("sign") == "Z", 0).when(with_sign, F.when(F.col("sign").startswith("-"), -1).otherwise(1) * (F.col("off_hour") * 3600 + F.col("off_minute") * 60))
    digits = F.when(F.col("year").isNull() & F.col("text").rlike(r"\A(?:[0-9]{10}|[0-9]{13})\z"), F.col("text")).cast("long")
    return rows.select(
        "stamp_id", "source", "zone", F.when(F.length("text") == 10, digits * 1_000_000).otherwise(digits * 1000).alias("epoch_us"),
        "day_first", "month_first", (in_day * 3600 + F.col("minute") * 60 + F.col("second")).alias("second_of_day"), offset.alias("offset"),
    )


def zone_offsets(spark: SparkSession, zones: DataFrame) -> DataFrame:
    """(zone, offsets): all offsets in seconds that each known zone of ``zones`` has from 2000 to 2099, looked up once a day.

    At most one row per name of the time zone database, whatever the input.
    """
    known = spark.createDataFrame([(str(z),) for z in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()], "zone string")
    first, last = (F.unix_date(F.lit(day).cast("date")).cast("long") * 86400 for day in ("1999-12-30", "2100-01-03"))
    days = F.explode(F.sequence(first, last, F.lit(86400).cast("long")))
    looked = zones.select("zone").distinct().join(F.broadcast(known), "zone").select("zone", days.alias("t"))
    return looked.select("zone", _offset_at(F.col("t")).alias("offset")).groupBy("zone").agg(F.array_sort(F.collect_set("offset")).alias("offsets"))


def _offset_at(second: Column) -> Column:
    """The offset of ``zone`` at a second of UTC."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(second), F.col("zone"))) - second


def resolve(wall: Column, offsets: Column) -> tuple[Column, Column]:
    """(offset, unsure): the one that renders the wall second back in ``zone``; where none or two do, that after the change."""
    back = F.filter(offsets, lambda o: _offset_at(wall - o) == o)
    # before and after a skip render each other; the change goes to the larger offset
    skip = F.filter(offsets, lambda o: (_offset_at(wall - o) < o) & (_offset_at(wall - _offset_at(wall - o)) == o))
    tried = F.when(F.size(offsets) > 1, back).otherwise(offsets)
    # a repeated time is later by the smaller offset
    return F.when(F.size(tried) > 0, F.array_min(tried)).otherwise(F.array_max(skip)), F.size(tried) != 1


def normalise(stamps: DataFrame, majority: float = MAJORITY) -> DataFrame:
    """(stamp_id, utc_us, rule, ambiguous) of each row of stamps (stamp_id, source, zone, raw; more columns are ignored).

    rule: ``bad`` (null, impossible or of another form, or without an offset in
    a null or unknown zone), ``epoch``, ``votes`` and ``default`` (a date with
    slashes that is possible in two orders), else ``plain``.  Null sources are
    one source.  Null and repeated ids are stamps like any other; an empty table
    gives an empty result.

    Only dates of two orders are joined with their source's votes, both sides by
    shuffles that a skewed source cannot fill one task with.
    """
    spark = stamps.sparkSession
    scratch = Scratch(spark, "timestamps")
    named = stamps.select(F.col("stamp_id").cast("long").alias("stamp_id"), F.col("source").cast("string").alias("source"), F.col("zone").cast("string").alias("zone"), F.col("raw").cast("string").alias("raw"))
    offsets = scratch.save(zone_offsets(spark, named), "zones")
    # one row per name of the time zone database
    placed = parse(named).join(F.broadcast(offsets), "zone", "left")
    placed = placed.withColumn("bad", F.col("epoch_us").isNull() & (F.coalesce("day_first", "month_first").isNull() | (F.col("offset").isNull() & F.col("offsets").isNull())))
    parsed = scratch.save(placed.drop("offsets"), "parsed")
    dated = parsed.where("not bad and epoch_us is null")
    one_way = dated.where("day_first is null or month_first is null")
    count = lambda c: F.count(c).alias(c)
    votes = scratch.save(one_way.groupBy("source").agg(count("day_first"), count("month_first")), "votes")
    two_ways = F.coalesce(~F.col("bad") & (F.col("day_first") != F.col("month_first")), F.lit(False))
    known = votes.select(F.col("source").alias("of"), F.col("day_first").alias("n_day"), F.col("month_first").alias("n_month"))
    asked = parsed.where(two_ways).join(known.hint("merge"), F.col("source").eqNullSafe(F.col("of")), "left")
    n_day, n_month = F.coalesce("n_day", F.lit(0)), F.coalesce("n_month", F.lit(0))
    by_month = n_month > majority * n_day
    told = asked.withColumn("date", F.when(by_month, F.col("month_first")).otherwise(F.col("day_first"))).withColumn("rule", F.when(by_month | (n_day > majority * n_month), "votes").otherwise("default")).drop("of", "n_day", "n_month")
    clear = parsed.where(~two_ways).withColumn("date", F.coalesce("day_first", "month_first")).withColumn("rule", F.when(F.col("bad"), "bad").when(F.col("epoch_us").isNotNull(), "epoch").otherwise("plain"))
    rows = told.unionByName(clear).withColumn("wall", F.when(~F.col("bad"), F.col("date").cast("long") * 86400 + F.col("second_of_day"))).join(F.broadcast(offsets), "zone", "left")
    found, unsure = resolve(F.col("wall"), F.col("offsets"))
    asks = F.col("wall").isNotNull() & F.col("offset").isNull()
    rows = rows.withColumn("found", F.when(asks, F.struct(found.alias("offset"), unsure.alias("unsure"))))
    utc = F.when(F.col("epoch_us").isNotNull(), F.col("epoch_us")).otherwise((F.col("wall") - F.coalesce(F.col("offset"), F.col("found.offset"))) * 1_000_000)
    return rows.select("stamp_id", F.when(~F.col("bad"), utc).alias("utc_us"), "rule", (F.col("rule").isin("votes", "default") | F.coalesce(F.col("found.unsure"), F.lit(False))).alias("ambiguous"))
