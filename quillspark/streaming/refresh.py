"""Incremental refresh: what is due, how states advance, and merges of landed files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.dates import due
from quillspark.operators.relational import top_per_group, upsert


def due_items(items: DataFrame, state: DataFrame, key: str, now: Column, days: int, k: int) -> DataFrame:
    """The ``k`` stalest items whose last attempt is missing or older than ``days``: never tried first, then oldest, then by key."""
    rows = items.join(state.select(key, "last_attempt"), key, "left").filter(due(F.col("last_attempt"), now, days))
    return rows.orderBy(F.col("last_attempt").asc_nulls_first(), F.col(key)).limit(k)


def advance(state: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """States after a run of (key, at, error): success sets last_success and clears the error, failure keeps last_success."""
    new = top_per_group(results, [key], [F.col("at").desc(), F.col("error").asc_nulls_last()]).select(key, F.col("at").alias("last_attempt"), F.when(F.col("error").isNull(), F.col("at")).alias("last_success"), F.col("error").alias("last_error"))
    return upsert(state, new, [key], {"last_attempt": "greatest", "last_success": "greatest", "last_error": "new"})


def run_all(jobs: dict[str, Callable[[], object]]) -> list[tuple[str, str, str | None]]:
    """Run every job; one that fails doesn't stop the rest. (name, status, error) of each."""
    log = []
    for name, job in jobs.items():
        try:
            job()
            log.append((name, "success", None))
        except Exception as e:  # noqa: BLE001  isolation is the feature
            log.append((name, "failed", str(e)[:500]))
    return log


def status_of(log: list[tuple[str, str, str | None]]) -> int:
    """The exit status of a run: 1 if any job failed."""
    return int(any(status != "success" for _, status, _ in log))


def append_log(runs: DataFrame, log: list[tuple[str, str, str | None]], at: str) -> DataFrame:
    """The run log (job, status, error, at) with the rows of one run."""
    new = runs.sparkSession.createDataFrame([(n, s, e, at) for n, s, e in log], "job string, status string, error string, at string")
    return runs.unionByName(new.select("job", "status", "error", F.col("at").cast(runs.schema["at"].dataType).alias("at")))


#: The providers in the order in which a backfill asks them, and those that only run when asked for.
BACKFILL_ORDER = ["crossref", "openalex", "datacite", "semantic", "dblp"]
OPT_IN = ["semantic", "dblp"]


def backfill_jobs(jobs: dict[str, Callable[[], object]], extras: list[str]) -> dict[str, Callable[[], object]]:
    """The providers' jobs in their fixed order, optional ones only where named."""
    return {name: jobs[name] for name in BACKFILL_ORDER if name in jobs and (name not in OPT_IN or name in extras)}


def stamped(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """``new`` rows with updated_at: now where a row is new or any column differs from the old one, else as it was."""
    columns = [c for c in new.columns if c not in (key, "updated_at")]
    both = new.drop("updated_at").join(old.select(key, F.col("updated_at").alias("__at"), F.struct(*columns).alias("__old")), key, "left")
    same = F.col("__at").isNotNull() & F.struct(*columns).eqNullSafe(F.col("__old"))
    return both.withColumn("updated_at", F.when(same, F.col("__at")).otherwise(now)).drop("__at", "__old")


def newest(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key of a batch: the first by ``order``."""
    return top_per_group(batch, keys, order)


def merge_stream(spark: SparkSession, landed: str, schema: str, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], keys: list[str], order: list[Column], policy: dict[str, str], checkpoint: str) -> StreamingQuery:
    """Merge files that land in a folder into a table, each file once; the same rows again change nothing.

    ``load`` reads the present table, ``save`` publishes the new one (as a whole, by a snapshot swap).
    """

    def merge(batch: DataFrame, _: int) -> None:
        save(upsert(load(), newest(batch, keys, order), keys, policy))

    stream = spark.readStream.schema(schema).json(landed)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows with a watermark (an extension: the batch system has no event-time windows)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).count()
