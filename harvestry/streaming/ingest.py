"""Continuous ingestion: each micro-batch is an idempotent keyed upsert into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Merge, Store, deactivate, insert_ignore, upsert_by_key, upsert_jobs
from ..schema import CONTEXT, JOBS, empty


def load(store: Store, spark: SparkSession, jobs: DataFrame, links: DataFrame | None = None, now=None, key: str = "") -> str | None:
    """One load: upsert jobs, add links, deactivate old jobs, publish all together. A key that was published before changes nothing.

    Of jobs and links that are there only the files are rewritten that can hold a job of the load or one that goes
    inactive; the latter are found by three columns of all.
    """
    if key and store.published(key):
        return None
    now = F.current_timestamp() if now is None else now
    old = store.read("jobs")
    if old is None:
        out = {"jobs": deactivate(upsert_jobs(empty(spark, JOBS), jobs, now), now)}
    else:
        old_ones = old.filter("is_active").select("id", "posted_at", "is_active")
        expired = deactivate(old_ones, now).filter("not is_active").select("id")
        out = {"jobs": Merge(jobs.select(F.col("id").cast("long").alias("id")).union(expired), lambda held: deactivate(upsert_jobs(held, jobs, now), now))}
    if links is not None:
        known = store.read("job_skills")
        add = lambda held: insert_ignore(held, links, held.columns)
        out["job_skills"] = links.dropDuplicates() if known is None else Merge(links.select("job_id"), add)
    return store.publish(out, key)


def load_context(store: Store, context: DataFrame, key: str = "") -> str | None:
    """Rows of the context table replace those of their country, year and indicator; the table has a row for each of these, so it is written whole."""
    if key and store.published(key):
        return None
    old = store.read("context")
    rows = context.select("country_code", "year", "indicator", "value")
    return store.publish({"context": upsert_by_key(empty(store.spark, CONTEXT) if old is None else old, rows, ["country_code", "year", "indicator"])}, key)


def follow(spark: SparkSession, path: str, schema: str, store: Store, checkpoint: str, now=None) -> StreamingQuery:
    """Files of jobs as they arrive. A batch is published under its number, so one that runs again after it was published is left out.

    now is the time that the rows are marked with, the clock's if it isn't given.
    """
    name = checkpoint.rstrip("/").rpartition("/")[2]
    stream = spark.readStream.schema(schema).json(path)
    put = lambda df, n: load(store, spark, df, now=now, key=f"{name}-{n}")
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
