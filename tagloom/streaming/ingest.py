"""Streams of change events and arriving files (OP-248 to OP-254, OP-275)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from tagloom.functions.lineage import Scratch


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of a table (OP-248)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """All that the stream gives on the data at hand, as a table written to the shared folder.

    append: each row as it comes; complete: the last state; update: the last
    row of each of ``keys``.  Nothing passes through the driver.
    """
    scratch = Scratch(stream.sparkSession, "stream")
    path, schema = f"{scratch.root}/rows", stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:  # a batch that is written again replaces itself
            batch.write.mode("overwrite").parquet(f"{path}/__batch={number}")

    w = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{scratch.root}/checkpoint")
    w.trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if mode == "complete":
        return spark.read.schema(schema).parquet(path)
    rows = spark.read.schema(StructType([*schema.fields, StructField("__batch", LongType())])).parquet(path)
    if mode == "append":
        return rows.drop("__batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in schema.names if c not in keys)), "__batch").alias("row"))
    return last.select(*keys, "row.*").select(*schema.names)


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> None:
    """Micro-batches into a sink, once over what is there or each interval (OP-251)."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start().awaitTermination()


def debounced(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "2 seconds") -> DataFrame:
    """Repeats of a key within the delay go (OP-249)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def settled(stream: DataFrame, key: str, time: str = "ts", quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """(key, first, last, n): runs of a key's events of which each follows the one before within the quiet time; a run is given once it is over (OP-249).

    A repeat makes the wait longer, and an event after it begins a new run.
    State holds the runs that are not over yet.
    """
    runs = stream.withWatermark(time, late).groupBy(F.session_window(time, quiet).alias("w"), key)
    return runs.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def throttled(stream: DataFrame, key: str, time: str = "ts", seconds: int = 2, late: str = "1 minute") -> DataFrame:
    """(key, time) of events that pass: none of their key has passed in the seconds before them (OP-249).

    Events that do not pass change nothing.  State is one time per key, and goes
    when the watermark is beyond its reach; events of a batch are taken in order
    of time, and one before the last that passed does not.
    """
    span = seconds * 1_000_000

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        passed = []
        for at in sorted(t for part in parts for t in part["at"].tolist()):
            if last is None or at >= last + span:
                last = at
                passed.append(at)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if passed:
            yield pd.DataFrame({key: [name[0]] * len(passed), "at": passed})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(time, late).where(f"{key} is not null and {time} is not null").select(key, time, F.unix_micros(time).alias("at"))
    out = rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("at").alias(time))


def distinct_by(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key, for all time (OP-250).

    State holds every key seen; where the catalog itself knows them,
    ``new_content`` in each batch needs no state.
    """
    return stream.dropDuplicates(keys)


def new_content(batch: DataFrame, known: DataFrame, key: str = "md5") -> DataFrame:
    """A batch's rows whose content the catalog does not hold yet, one for each content (OP-250)."""
    return batch.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def outcomes(batch: DataFrame, known: DataFrame, key: str = "md5", path: str = "path") -> DataFrame:
    """(path, key, outcome) of each arrival: error without a hash, duplicate of the catalog, race with another arrival of its content, else success (OP-251, OP-275).

    Of arrivals of one content the least path succeeds.  Arrivals of one path
    count once.
    """
    once = batch.select(path, key).dropDuplicates([path])
    first = once.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(path).alias("first"))
    rows = once.join(known.select(key).distinct().withColumn("known", F.lit(True)), key, "left").join(first, key, "left")
    outcome = F.when(F.col(key).isNull(), "error").when(F.col("known"), "duplicate").when(F.col(path) != F.col("first"), "race_condition").otherwise("success")
    return rows.select(path, key, outcome.alias("outcome"))


def counters(stream: DataFrame, key: str) -> DataFrame:
    """Running counts per outcome; use with complete output (OP-252, OP-275)."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, time: str, length: str, slide: str | None = None, late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Counts per time window; rows later than the watermark are left out.  An extension."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(span, *([key] if key else [])).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *([key] if key else []), "n")


def session_counts(stream: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Counts per key and session, ended by a gap.  An extension."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_rate(events: DataFrame, key: str, time: str, seconds: int = 30) -> DataFrame:
    """Events of each key in the seconds up to each event (OP-254); a table, since it needs each row's own window.

    A key's rows are cut into spans of time, each with the tail of the one
    before, so that no key's whole history is one group.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    span = 3600 * 1_000_000
    rows = events.select("*", us.alias("__us"), F.floor(us / span).alias("__span"), F.lit(True).alias("__own"))
    tail = rows.where(F.pmod("__us", F.lit(span)) >= span - seconds * 1_000_000).withColumn("__span", F.col("__span") + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy(key, "__span").orderBy("__us").rangeBetween(-seconds * 1_000_000, 0)
    return rows.unionByName(tail).withColumn("rate", F.count("*").over(w)).where("__own").drop("__us", "__span", "__own")


def latest(events: DataFrame, time: str, k: int = 100) -> DataFrame:
    """The newest k events (OP-253)."""
    return events.orderBy(F.desc(time), F.desc("event_id")).limit(k)


LIMITER_OUT = "user_id long, seen long, allowed long, limit int"
LIMITER_STATE = "seen long, allowed long, limit int, last long, stamps array<long>"
#: Seconds without an event after which a user's limiter starts anew.
IDLE_SECONDS = 7 * 86_400


def adaptive_limiter(stream: DataFrame, start: int = 20, least: int = 2, seconds: int = 30, idle: int = IDLE_SECONDS, late: str = "1 minute") -> DataFrame:
    """Per user: events seen, let through, and the limit that adapts: up by one on a quiet window, halved when it is hit (OP-254).

    Events of a user count in order of time; one that is older than what was
    counted before counts at that last time, so only arrivals out of order
    could tell batches apart.  After ``idle`` seconds a user starts anew,
    whether by a timer or by the next event, so timers change no numbers and
    state holds active users alone: the stamps let through in the last window.
    """
    us = 1_000_000

    def step(key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, allowed, limit, last, stamps = state.get if state.exists else (0, 0, start, -(2**62), [])
        window = deque(stamps)
        for t in sorted(t for b in batches for t in b["us"].tolist()):
            if t - last > idle * us:
                seen, allowed, limit = 0, 0, start
                window.clear()
            t = last = max(t, last)
            while window and window[0] <= t - seconds * us:
                window.popleft()
            seen += 1
            if len(window) < limit:
                window.append(t)
                allowed += 1
                if len(window) * 2 < limit:
                    limit = min(limit + 1, start)
            else:
                limit = max(least, limit // 2)
        state.update((seen, allowed, limit, last, list(window)))
        state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "allowed": [allowed], "limit": [limit]})

    timed = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = timed.withColumn("us", F.unix_micros("ts"))
    return rows.groupBy("user_id").applyInPandasWithState(step, LIMITER_OUT, LIMITER_STATE, "update", GroupStateTimeout.EventTimeTimeout)
