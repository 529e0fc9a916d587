"""Logs of batch-scheduler jobs: submissions, polled states, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtable.functions.states import BLANK_LIMIT, clean_state, is_blank, state_category
from flowtable.operators.position import trailing_count

# Where a scheduler's submit response carries the job id.
JOB_ID_PATTERNS = {"slurm": r"(\d+)$", "lsf": r"Job <(\d+)>"}


def job_id(response, scheduler: str):
    """Job id in a submit response; null when there is none."""
    found = F.regexp_extract(response, JOB_ID_PATTERNS[scheduler], 1)
    return F.when(found != "", found).try_cast("bigint")


def submit_log(submits: DataFrame, polls: DataFrame) -> DataFrame:
    """Submissions tied to their polls, counted by outcome.

    `submits`: response, scheduler; `polls`: job, one row per poll. Outcomes: `unparsable`
    (no id in the response), `polled`, `never polled`, `unknown job` (polled, not submitted).
    """
    ids = F.coalesce(
        *[F.when(F.col("scheduler") == s, job_id(F.col("response"), s)) for s in JOB_ID_PATTERNS]
    )
    # Both sides are counted per job before they meet; all unparsable ones become one row.
    submitted = submits.groupBy(ids.alias("job")).agg(F.count(F.lit(1)).alias("__submits"))
    polled = polls.groupBy("job").agg(F.count(F.lit(1)).alias("__polls"))
    outcome = (
        F.when(F.col("__submits").isNull(), "unknown job")
        .when(F.col("job").isNull(), "unparsable")
        .when(F.col("__polls").isNull(), "never polled")
        .otherwise("polled")
    )
    return (
        submitted.join(polled, "job", "full")
        .groupBy(outcome.alias("outcome"))
        .agg(
            F.sum(F.coalesce("__submits", F.lit(1))).alias("jobs"),
            F.coalesce(F.sum("__polls"), F.lit(0)).alias("polls"),
        )
    )


def state_counts(polls: DataFrame, scheduler: str = "scheduler", raw: str = "raw") -> DataFrame:
    """Polled answers by scheduler (a column), cleaned state and category; blank answers are BLANK."""
    state = clean_state(raw)
    blank = is_blank(raw)
    return polls.groupBy(
        F.col(scheduler).alias("scheduler"),
        F.when(blank, "").otherwise(state).alias("state"),
        F.when(blank, "BLANK").otherwise(state_category(state, F.col(scheduler))).alias("category"),
    ).agg(F.count(F.lit(1)).alias("polls"))


def job_outcome(
    polls: DataFrame, scheduler: str, job="job", seq="seq", raw="raw", blank_limit: int = BLANK_LIMIT
) -> DataFrame:
    """How each job ended: (job, outcome, seq of the deciding poll, polls up to there).

    SUCCEEDED, FAILED, UNKNOWN (a state the scheduler does not have) or NO_ANSWER (the
    fourth blank answer in a row), whichever comes first; RUNNING if none did.
    """
    blank = is_blank(raw)
    category = state_category(clean_state(raw), scheduler)
    marked = trailing_count(
        polls.select(F.col(job).alias("job"), F.col(seq).alias("seq"), F.when(blank, "BLANK").otherwise(category).alias("__c")),
        "job", "seq", F.col("__c") == "BLANK", blank_limit, "__blanks",
    )
    ending = (
        F.when(F.col("__blanks") == blank_limit, "NO_ANSWER")
        .when(F.col("__c").isin("SUCCEEDED", "FAILED", "UNKNOWN"), F.col("__c"))
    )
    return (
        marked.withColumn("__end", ending)
        .groupBy("job")
        .agg(
            F.min_by("__end", F.when(F.col("__end").isNotNull(), F.col("seq"))).alias("outcome"),
            F.min(F.when(F.col("__end").isNotNull(), F.col("seq"))).alias("seq"),
        )
        .withColumn("outcome", F.coalesce("outcome", F.lit("RUNNING")))
    )
