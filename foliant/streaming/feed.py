"""The page feed: files landing in a folder become jobs, first in, first out."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.tables import IMAGE_SUFFIXES

STATES = ("queued", "running", "done", "failed")
LANDED = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def uploads(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """New image files as a stream; files of other kinds are left alone, names without a suffix count as png."""
    read = spark.readStream.format("binaryFile").schema(LANDED).option("maxFilesPerTrigger", per_trigger).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return read.withColumn("suffix", F.when(suffix == "", "png").otherwise(suffix)).filter(F.col("suffix").isin(*IMAGE_SUFFIXES))


def jobs(landed: DataFrame) -> DataFrame:
    return landed.select(
        F.sha2(F.col("path"), 256).substr(1, 16).alias("job_id"), F.lit("queued").alias("status"), F.lit("").alias("message"),
        F.col("path").alias("upload_path"), F.col("modificationTime").alias("queued_at"), "content",
    )


def run_jobs(landed: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Process what has landed and stop: ``work`` maps jobs to (job_id, status, message, tex); results append to ``out``.

    Exactly one result a file: the source's log and the sink's epoch log decide
    what a restart repeats.
    """
    return work(jobs(landed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def positions(table: DataFrame) -> DataFrame:
    """Queue position, from 1, of the jobs that wait."""
    waiting = table.filter("status = 'queued'")
    return waiting.withColumn("position", F.row_number().over(Window.orderBy("queued_at", "job_id")))


def board(changes: DataFrame, patience: float = 300.0, keep: float = 600.0) -> DataFrame:
    """(job_id, status, position) from changes(job_id, seq, at, status), ``at`` in seconds, as of the last change.

    A job is what its latest change says. Work that takes longer than
    ``patience`` is an error; jobs that ended ``keep`` seconds ago are
    forgotten; waiting jobs have a position from 1, first in, first out.
    """
    last = changes.groupBy("job_id").agg(F.max_by("status", F.struct("at", "seq")).alias("status"), F.max("at").alias("at"))
    now = changes.agg(F.max("at").alias("now")).first()["now"]
    age = F.lit(now) - F.col("at")
    alive = last.filter(~(F.col("status").isin("done", "error") & (age > keep)))
    alive = alive.withColumn("status", F.when((F.col("status") == "processing") & (age > patience), "error").otherwise(F.col("status")))
    nth = F.row_number().over(Window.partitionBy("status").orderBy("at", "job_id"))
    return alive.select("job_id", "status", F.when(F.col("status") == "queued", nth.cast("long")).alias("position"))


def job_states(changes: DataFrame, patience: float = 300.0, keep: float = 600.0, late: str = "0 seconds") -> DataFrame:
    """What becomes of each job as a stream: (job_id, status, at), a row for every new status.

    ``changes`` is a stream of (job_id, seq, at, status), ``at`` a timestamp; of
    the changes of a job in one batch the last by (at, seq) counts, earlier ones
    than the known one do not, and what comes later than the watermark is
    dropped. Work that takes longer than ``patience`` seconds becomes an error;
    a job is forgotten, state and all, ``keep`` seconds after its end. Both go
    by event time, so a replay gives the same rows, and the state is one small
    row for each job not yet forgotten.
    """
    limits = {"processing": int(patience * 1000), "done": int(keep * 1000), "error": int(keep * 1000)}

    def step(key, frames, state):
        status, at, seq = before = state.get if state.exists else (None, -1, -1)
        if state.hasTimedOut:
            at += limits[status]
            status = "error" if status == "processing" else "forgotten"
        else:
            for frame in frames:
                for found in zip(frame["ms"], frame["seq"], frame["status"], strict=True):
                    if found[:2] >= (at, seq):
                        at, seq, status = int(found[0]), int(found[1]), found[2]
        if status == "forgotten":
            state.remove()
        else:
            state.update((status, at, seq))
            if status in limits:
                state.setTimeoutTimestamp(max(at + limits[status], state.getCurrentWatermarkMs() + 1))
        if status != before[0]:
            yield pd.DataFrame({"job_id": [key[0]], "status": [status], "at": [pd.Timestamp(at, unit="ms", tz="UTC")]})

    rows = changes.withWatermark("at", late).select("job_id", "seq", "at", "status", F.unix_millis("at").alias("ms"))
    return rows.groupBy("job_id").applyInPandasWithState(
        step, "job_id string, status string, at timestamp", "status string, at long, seq long", "append", GroupStateTimeout.EventTimeTimeout
    )
