"""Status values of runs, and the job states two batch schedulers report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtable.functions.common import col

COMPLETED = "completed"
PARTIAL = "partially completed"
FAILED = "failed"

# Job states by scheduler and the category each belongs to.
SLURM_STATES = {
    "BOOT_FAIL": "FAILED",
    "CANCELLED": "FAILED",
    "COMPLETED": "SUCCEEDED",
    "DEADLINE": "FAILED",
    "FAILED": "FAILED",
    "NODE_FAIL": "FAILED",
    "OUT_OF_MEMORY": "FAILED",
    "PENDING": "INCOMPLETE",
    "PREEMPTED": "FAILED",
    "RUNNING": "INCOMPLETE",
    "REQUEUED": "INCOMPLETE",
    "RESIZING": "INCOMPLETE",
    "REVOKED": "FAILED",
    "SUSPENDED": "INCOMPLETE",
    "TIMEOUT": "FAILED",
}
LSF_STATES = {
    "EXIT": "FAILED",
    "DONE": "SUCCEEDED",
    "PEND": "INCOMPLETE",
    "RUN": "INCOMPLETE",
    "PSUSP": "INCOMPLETE",
    "USUSP": "INCOMPLETE",
    "SSUSP": "INCOMPLETE",
    "UNKWN": "FAILED",
}
SCHEDULER_STATES = {"slurm": SLURM_STATES, "lsf": LSF_STATES}
# A job is given up at this many blank answers in a row.
BLANK_LIMIT = 4


def task_status(status, completed_time) -> Column:
    s = col(status)
    return (
        F.when(col(completed_time).isNull(), "IN_PROGRESS")
        .when(s == COMPLETED, "SUCCEEDED")
        .when(s == PARTIAL, "PARTIALLY_SUCCEEDED")
        .otherwise("FAILED")
    )


def workflow_status(succeeded, completed_time) -> Column:
    return (
        F.when(col(completed_time).isNull(), "IN_PROGRESS").when(col(succeeded), "SUCCEEDED").otherwise("FAILED")
    )


def is_blank(raw) -> Column:
    """No answer (null) is a blank one."""
    return F.coalesce(col(raw), F.lit("")).rlike(r"^\s*$")


def clean_state(raw) -> Column:
    """First line of an answer, trimmed, without trailing plus signs."""
    first_line = F.substring_index(col(raw), "\n", 1)
    return F.regexp_replace(F.regexp_replace(first_line, r"^\s+|\s+$", ""), r"\++$", "")


def state_category(state, scheduler) -> Column:
    """INCOMPLETE, SUCCEEDED or FAILED; UNKNOWN for a state the scheduler does not have.

    `scheduler` is `slurm` or `lsf`, or a column that tells which.
    """
    s, category = col(state), F.lit("UNKNOWN")
    for name, table in SCHEDULER_STATES.items():
        if isinstance(scheduler, str) and scheduler != name:
            continue
        here = F.lit(True) if isinstance(scheduler, str) else scheduler == name
        for value in ("INCOMPLETE", "SUCCEEDED", "FAILED"):
            members = [k for k, v in table.items() if v == value]
            category = F.when(here & s.isin(members), value).otherwise(category)
    return category
