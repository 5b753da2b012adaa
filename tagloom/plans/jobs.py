"""Background jobs on one session, and the maintenance jobs (OP-255, OP-256, OP-288).

A job is a function of a session that runs in a thread under a tag of its own,
by which its Spark jobs are counted and cancelled; Spark itself is the pool.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.lineage import Scratch
from tagloom.operators import health, merge, review, stats
from tagloom.sources.proxies import Catalog

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"


@dataclass
class Job:
    name: str
    tag: str
    status: str = PENDING
    result: object = None
    error: str | None = None
    done: threading.Event = field(default_factory=threading.Event)


class Jobs:
    """Jobs of a session by id, and listeners that are told when one has ended."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._jobs: dict[str, Job] = {}
        self._listeners: list[Callable[[str, Job], None]] = []

    def on_end(self, listener: Callable[[str, Job], None]) -> None:
        """Call the listener with (id, job) when a job has ended, such as to refresh a catalog (OP-256)."""
        self._listeners.append(listener)

    def start(self, name: str, work: Callable[[SparkSession], object]) -> str:
        """Run the work in the background; the id under which to ask for it."""
        key = uuid.uuid4().hex[:12]
        job = self._jobs[key] = Job(name, f"job-{key}")

        def run() -> None:
            context = self.spark.sparkContext
            context.addJobTag(job.tag)
            job.status = RUNNING
            try:
                job.result = work(self.spark)
                job.status = COMPLETED if job.status == RUNNING else job.status
            except Exception as fault:  # noqa: BLE001  what a job raises is its result
                if job.status != CANCELLED:
                    job.status, job.error = FAILED, str(fault)
            finally:
                context.removeJobTag(job.tag)
                job.done.set()
                for listener in self._listeners:
                    listener(key, job)

        InheritableThread(target=run, daemon=True).start()
        return key

    def get(self, key: str) -> Job:
        return self._jobs[key]

    def wait(self, key: str, seconds: float | None = None) -> Job:
        self._jobs[key].done.wait(seconds)
        return self._jobs[key]

    def cancel(self, key: str) -> None:
        """Cancel the job's Spark jobs, now and as they come."""
        job = self._jobs[key]
        if not job.done.is_set():
            job.status = CANCELLED
            self.spark.sparkContext.cancelJobsWithTag(job.tag)

    def listed(self) -> list[tuple[str, str, str]]:
        """(id, name, status) of all jobs, in order of start."""
        return [(k, j.name, j.status) for k, j in self._jobs.items()]


def maintenance(c: Catalog) -> dict[str, DataFrame]:
    """What each maintenance job would touch, one row (n) each (OP-288).

    A tag that does not begin with rating is renamed to itself, so only the
    others are compared; rows are counted by item once for all that asks items.
    """
    count = lambda df: df.agg(F.count("*").alias("n"))
    per_item = Scratch(c.spark, "maintenance").save(c.item_tags.groupBy("item_id").agg(F.count("*").alias("rows")), "per-item")
    ratings = c.item_tags.where(F.startswith("tag", F.lit("rating")))
    return {
        "recount": count(stats.tag_counts(c.item_tags)),
        "recategorise": count(merge.rename_ratings(ratings).exceptAll(ratings.select("item_id", "tag", "category"))),
        "duplicates": count(review.exact_duplicates(c.raw("documents"), F.col("text"), "doc_id")),
        "orphans": health.orphans(per_item, c.items, "item_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("n")),
        "without_tags": count(c.items.join(per_item, "item_id", "left_anti")),
        "pivot": count(merge.category_columns(c.item_tags)),
    }


def run_maintenance(c: Catalog) -> DataFrame:
    """(job, n) of all maintenance jobs, one after the other, so that only one has its files in the shuffle."""
    scratch, jobs = Scratch(c.spark, "maintenance-jobs"), maintenance(c)
    for name, df in jobs.items():
        scratch.save(df.select(F.lit(name).alias("job"), "n"), name)
    return scratch.together(*jobs)
