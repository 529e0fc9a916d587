"""Current status of task runs, and reports when something changed.

Status and counts write small records per micro-batch that can be merged in any order; reading merges them.
Reports follow the state: each micro-batch takes back what its task runs counted for before, and counts them
anew. Rows that come late, twice or out of order count like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtable.functions.states import task_status
from flowtable.operators.history import fold_events
from flowtable.streaming.epochs import START, each_batch, last_epoch, read_all, read_epoch, start_table, write_epoch
from flowtable.streaming.levels import Levels

# Seconds between reports, by default and at least.
REPORT_SECONDS = 120
MIN_REPORT_SECONDS = 10

STATUS_SCHEMA = "id bigint, task_name string, start_time bigint, completion_status string, completed_time bigint"
COUNTS_SCHEMA = "start timestamp, kind string, n bigint"
REPORT_SCHEMA = "run_id bigint, status string, n bigint"
RECORD_SCHEMA = "id bigint, run_id bigint, start_time bigint, completion_status string, completed_time bigint"


def stream_status(events: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Partial task-run records of a stream of start and finish events. Read with `read_status`."""

    def handle(batch: DataFrame, epoch: int) -> None:
        write_epoch(fold_events(batch), f"{root}/status", epoch)

    return each_batch(events, handle, f"{root}/checkpoint", trigger=trigger, skip_empty=True)


def read_status(spark: SparkSession, root: str, schema: str = STATUS_SCHEMA) -> DataFrame:
    """Task-run records: the partial ones of all micro-batches, merged by id."""
    return read_all(spark, f"{root}/status", schema).groupBy("id").agg(
        F.max("task_name").alias("task_name"),
        F.min("start_time").alias("start_time"),
        F.max_by("completion_status", "completed_time").alias("completion_status"),
        F.max("completed_time").alias("completed_time"),
    )


def report_counts(
    events: DataFrame, root: str, ts: str = "ts", kind: str = "kind", every: int = REPORT_SECONDS, trigger: dict | None = None
) -> StreamingQuery:
    """Count events per kind and report interval in event time. Read with `read_counts`."""
    seconds = max(every, MIN_REPORT_SECONDS)

    def handle(batch: DataFrame, epoch: int) -> None:
        counts = (
            batch.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), F.col(kind).alias("kind"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("start"), "kind", "n")
        )
        write_epoch(counts, f"{root}/counts", epoch)

    return each_batch(events, handle, f"{root}/checkpoint", trigger=trigger, skip_empty=True)


def read_counts(spark: SparkSession, root: str) -> DataFrame:
    """(start, kind, n) over all micro-batches; an interval without events has no row."""
    return read_all(spark, f"{root}/counts", COUNTS_SCHEMA).groupBy("start", "kind").agg(F.sum("n").alias("n"))


def records_table(spark: SparkSession, root: str) -> Levels:
    return Levels(spark, f"{root}/records", RECORD_SCHEMA, "id", latest=True)


def merged_records(rows: DataFrame) -> DataFrame:
    """Partial records of task runs (`RECORD_SCHEMA`), one per id, whatever their order."""
    return rows.groupBy("id").agg(
        F.max("run_id").alias("run_id"),
        F.min("start_time").alias("start_time"),
        # Of several ends the last; of ends at one time the greatest name, so that order does not matter.
        F.max(F.when(F.col("completed_time").isNotNull(), F.struct("completed_time", "completion_status"))).alias("end"),
    ).select("id", "run_id", "start_time", F.col("end.completion_status").alias("completion_status"), F.col("end.completed_time").alias("completed_time"))


def stream_report(
    events: DataFrame, root: str, every: int = REPORT_SECONDS, trigger: dict | None = None
) -> StreamingQuery:
    """Every `every` seconds (10 at least) write what changed in the counts by run and status.

    `events`: id, run_id, kind (`start` or `finish`), t, status (on finish). A task run is in progress from its first
    event of any kind until it has a finish. The change of a report is -1 for a task run's former status and +1 for its
    new one, summed up by run and status; nothing is written where nothing changed. Former records are
    looked up for the micro-batch's task runs only. Read with `read_reports`, `read_report`.
    """
    when = trigger or {"processingTime": f"{max(every, MIN_REPORT_SECONDS)} seconds"}
    start_table(events.sparkSession.createDataFrame([], REPORT_SCHEMA), f"{root}/reports")
    finish = F.col("kind") == "finish"

    def counted(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select("run_id", task_status("completion_status", "completed_time").alias("status"), F.lit(sign).cast("bigint").alias("n"))

    def handle(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        table = records_table(here, root)
        arrived = batch.select(
            "id", "run_id", F.when(F.col("kind") == "start", F.col("t")).alias("start_time"),
            F.when(finish, F.col("status")).alias("completion_status"), F.when(finish, F.col("t")).alias("completed_time"),
        )
        before = table.lookup(arrived.select("id"), epoch).drop("epoch")
        write_epoch(merged_records(arrived.unionByName(before)), f"{root}/now", START)  # one place, written anew each time
        now = read_epoch(here, f"{root}/now", RECORD_SCHEMA, START)
        change = counted(now, 1).unionAll(counted(before, -1)).groupBy("run_id", "status").agg(F.sum("n").alias("n"))
        write_epoch(change.where("n <> 0"), f"{root}/reports", epoch)
        table.append(now, epoch, now.count())

    return each_batch(events, handle, f"{root}/checkpoint", trigger=when, skip_empty=True)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, status, n, epoch): the changes of every report."""
    return read_all(spark, f"{root}/reports", REPORT_SCHEMA).where(F.col("epoch") <= last_epoch(spark, f"{root}/checkpoint"))


def read_report(spark: SparkSession, root: str, epoch: int | None = None) -> DataFrame:
    """(run_id, status, n) as it stood after micro-batch `epoch` (None: now)."""
    rows = read_reports(spark, root).where(F.col("epoch") > START)
    rows = rows if epoch is None else rows.where(F.col("epoch") <= epoch)
    return rows.groupBy("run_id", "status").agg(F.sum("n").alias("n")).where("n <> 0")
