"""Monitoring polled jobs on a stream: the outcome of a job as soon as a poll decides it.

Between micro-batches the number of trailing blank answers (under four) of each open job is kept, and which jobs
are decided. A micro-batch looks up its own jobs only; inside it, the bounded operator does the work, hot
jobs included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtable.functions.states import BLANK_LIMIT, is_blank
from flowtable.operators.joblog import job_outcome
from flowtable.streaming.epochs import each_batch, last_epoch
from flowtable.streaming.levels import Levels

STATE_SCHEMA = "job bigint, blanks int, outcome string, seq bigint"
#: blanks: trailing blank answers of an open job; outcome and seq: of a decided one, else null.


def jobs_table(spark: SparkSession, root: str) -> Levels:
    return Levels(spark, f"{root}/jobs", STATE_SCHEMA, "job", latest=True)


def stream_job_outcome(polls: DataFrame, scheduler: str, root: str, trigger: dict | None = None) -> StreamingQuery:
    """`polls`: job (bigint), seq (bigint, not negative, growing), raw. Read with `read_outcomes`."""

    def handle(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        table = jobs_table(here, root)
        known = table.lookup(batch.select("job"), epoch)
        decided = known.where("outcome is not null").select("job")
        # Earlier blank answers come back as blank polls before the new ones.
        earlier = known.where("outcome is null and blanks > 0").select(
            "job",
            F.explode(F.sequence(-F.col("blanks").cast("bigint"), F.lit(-1).cast("bigint"))).alias("seq"),
            F.lit("").alias("raw"),
        )
        polls_now = batch.select("job", "seq", "raw").join(decided, "job", "left_anti").unionByName(earlier)
        latest = Window.partitionBy("job").orderBy(F.col("seq").desc())
        # Only the last few polls of a job count, and Spark cuts to them before the shuffle.
        tail = (
            polls_now.withColumn("__n", F.row_number().over(latest))
            .where(F.col("__n") < BLANK_LIMIT)
            .groupBy("job")
            .agg(
                F.coalesce(F.min(F.when(~is_blank("raw"), F.col("__n"))) - 1, F.max("__n")).cast("int").alias("blanks")
            )
        )
        outcome = job_outcome(polls_now, scheduler).where(F.col("outcome") != "RUNNING")
        changed = tail.join(outcome, "job", "left").select("job", "blanks", "outcome", F.col("seq").cast("bigint").alias("seq"))
        table.append(changed, epoch)

    return each_batch(polls, handle, f"{root}/checkpoint", trigger=trigger, skip_empty=True)


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """(job, outcome, seq) of decided jobs, and RUNNING for the open ones."""
    rows = jobs_table(spark, root).read(last_epoch(spark, f"{root}/checkpoint") + 1)
    return rows.select("job", F.coalesce("outcome", F.lit("RUNNING")).alias("outcome"), "seq")
