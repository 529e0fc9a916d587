"""Queries: run history and scheduler job logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtable.operators import history as h
from flowtable.operators import joblog as j
from flowtable.operators.batches import batch
from flowtable.plans import model as m
from flowtable.plans.registry import query

AS_OF = 1706745600000  # 2024-02-01 00:00:00 UTC, after the last event

_STATUS_SQL = """CASE WHEN completed_time IS NULL THEN 'IN_PROGRESS' WHEN completion_status = 'completed' THEN 'SUCCEEDED'
    WHEN completion_status = 'partially completed' THEN 'PARTIALLY_SUCCEEDED' ELSE 'FAILED' END"""
_RUN_STATUS_SQL = "CASE WHEN completed_time IS NULL THEN 'IN_PROGRESS' WHEN completed_successfully THEN 'SUCCEEDED' ELSE 'FAILED' END"


@query("task_status", f"WITH {m.TASK_RUNS_SQL} SELECT id, task_name, {_STATUS_SQL} AS status FROM task_runs")
def task_status(spark, sf):
    return h.with_task_status(m.task_runs(m.table(spark, sf, "events"))).select("id", "task_name", "status")


@query(
    "workflow_status",
    f"WITH {m.TASK_RUNS_SQL}, {m.RUNS_SQL} SELECT run_id, workflow_name, start_time, {_RUN_STATUS_SQL} AS status FROM runs",
)
def workflow_status(spark, sf):
    runs = m.runs(m.task_runs(m.table(spark, sf, "events")))
    return h.with_workflow_status(runs).select("run_id", "workflow_name", "start_time", "status")


@query(
    "run_report",
    f"""WITH {m.TASK_RUNS_SQL}, {m.RUNS_SQL}, s AS (SELECT run_id, workflow_name, {_RUN_STATUS_SQL} AS run_status FROM runs),
d AS (SELECT *, {_STATUS_SQL} AS status, coalesce(completed_time, {AS_OF}) - start_time AS ms FROM task_runs)
SELECT run_id, workflow_name, run_status, task_name, id, status, start_time,
  strftime(make_timestamp(start_time * 1000), '%Y-%m-%d %H:%M:%S') AS started, ms AS duration_ms,
  CASE WHEN ms // 3600000 > 0 THEN (ms // 3600000) || 'h' ELSE '' END
  || CASE WHEN ms % 3600000 // 60000 > 0 THEN (ms % 3600000 // 60000) || 'm' ELSE '' END
  || CASE WHEN ms % 1000 > 0 THEN (ms % 60000 // 1000) || '.' || rtrim(lpad(CAST(ms % 1000 AS VARCHAR), 3, '0'), '0') || 's'
      WHEN ms % 60000 > 0 OR ms = 0 THEN (ms % 60000 // 1000) || 's' ELSE '' END AS duration
FROM d JOIN s USING (run_id)""",
)
def run_report(spark, sf):
    tasks = m.task_runs(m.table(spark, sf, "events"))
    return h.run_report(m.runs(tasks), tasks, AS_OF)


@query(
    "exec_explode",
    """WITH l AS (SELECT o_orderkey, l_orderkey, l_returnflag, l_partkey FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey)
SELECT coalesce(o_orderkey, l_orderkey) AS run, l_returnflag AS image, 'pack ' || l_partkey AS command, count(*) AS n FROM l GROUP BY ALL""",
)
def exec_explode(spark, sf):
    # Task runs of up to 20 lines each, with their executions stored as JSON.
    orders = m.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"))
    lines = m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), "l_returnflag", "l_partkey", "l_suppkey", "l_linenumber"
    )
    # Lines may repeat as a whole; repeats are told apart by their number.
    keys = ["run", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    lines = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    order = [*keys[1:], "copy"]
    part = F.col("l_partkey").cast("string")
    execution = F.struct(
        F.col("l_returnflag").alias("image"),
        F.concat(F.lit("pack "), part).alias("command"),
        F.concat(F.lit("in/"), part).alias("input"),
        F.concat(F.lit("out/"), part).alias("output"),
    )
    stored = batch(lines, "run", order, 20).groupBy("run", "batch_id").agg(
        F.to_json(F.collect_list(execution)).alias("executions_json")
    )
    idle = orders.join(lines.select("run").distinct(), "run", "left_anti")
    task_runs = stored.select("run", "executions_json").unionByName(idle.withColumn("executions_json", F.lit("[]")))
    return h.executions(task_runs).groupBy("run", "image", "command").agg(F.count(F.lit(1)).alias("n"))


@query(
    "record_upsert",
    f"WITH {m.TASK_RUNS_SQL} SELECT id, task_name, start_time, completion_status, completed_time FROM task_runs",
)
def record_upsert(spark, sf):
    return h.fold_events(event_log(m.task_runs(m.table(spark, sf, "events"))))


def event_log(task_runs, *more):
    """Start and finish events of task runs, as a tracker would log them."""
    name = F.col("task_name")
    entry = lambda kind, t, status: F.struct(
        F.lit(kind).alias("kind"), t.alias("t"), name.alias("task_name"), status.alias("status")
    )
    started = entry("start", F.col("start_time"), F.lit(None).cast("string"))
    finished = F.when(
        F.col("completed_time").isNotNull(), entry("finish", F.col("completed_time"), F.col("completion_status"))
    )
    return task_runs.select("id", *more, F.inline(F.array_compact(F.array(started, finished))))


@query(
    "changed_since",
    f"""WITH {m.TASK_RUNS_SQL}, l AS (SELECT run_id, min(start_time) + 43200000 AS reported_at FROM task_runs WHERE run_id % 5 <> 0 GROUP BY 1)
SELECT DISTINCT t.run_id FROM task_runs t LEFT JOIN l ON t.run_id = l.run_id
WHERE reported_at IS NULL OR greatest(start_time, coalesce(completed_time, start_time)) > reported_at""",
)
def changed_since(spark, sf):
    tasks = m.task_runs(m.table(spark, sf, "events"))
    reports = tasks.where("run_id % 5 <> 0").groupBy("run_id").agg((F.min("start_time") + 43200000).alias("reported_at"))
    return h.changed_since(tasks, reports)


@query(
    "submit_log",
    f"""WITH {m.POLLS_SQL}, s AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 8 <> 3),
r AS (SELECT CASE WHEN u % 10 <> 7 THEN u END AS job FROM s),
p AS (SELECT job, count(*) AS polls FROM polls WHERE job % 9 <> 0 GROUP BY job),
x AS (SELECT CASE WHEN NOT coalesce(submitted, false) THEN 'unknown job' WHEN r.job IS NULL THEN 'unparsable'
    WHEN polls IS NULL THEN 'never polled' ELSE 'polled' END AS outcome, polls
  FROM (SELECT job, true AS submitted FROM r) r FULL OUTER JOIN p ON r.job = p.job)
SELECT outcome, count(*) AS jobs, CAST(coalesce(sum(polls), 0) AS BIGINT) AS polls FROM x GROUP BY outcome""",
)
def submit_log(spark, sf):
    events = m.table(spark, sf, "events")
    u = F.col("u")
    text = u.cast("string")
    submits = events.where("user_id % 8 <> 3").select(F.col("user_id").alias("u")).distinct().select(
        F.when(u % 10 == 7, "error")
        .when(u % 2 == 0, F.concat(F.lit("Submitted batch job "), text))
        .otherwise(F.concat(F.lit("Job <"), text, F.lit("> is submitted")))
        .alias("response"),
        F.when(u % 2 == 0, "slurm").otherwise("lsf").alias("scheduler"),
    )
    return j.submit_log(submits, m.polls(events).where("job % 9 <> 0"))


_STATE_SQL = f"""WITH {m.POLLS_SQL}, c AS (SELECT *, rtrim(trim(split_part(raw, chr(10), 1)), '+') AS state, trim(raw) = '' AS blank FROM polls),
g AS (SELECT *, CASE WHEN blank THEN 'BLANK'
    WHEN state IN ('PENDING', 'RUNNING', 'REQUEUED', 'RESIZING', 'SUSPENDED') THEN 'INCOMPLETE'
    WHEN state = 'COMPLETED' THEN 'SUCCEEDED'
    WHEN state IN ('BOOT_FAIL', 'CANCELLED', 'DEADLINE', 'FAILED', 'NODE_FAIL', 'OUT_OF_MEMORY', 'PREEMPTED', 'REVOKED', 'TIMEOUT') THEN 'FAILED'
    ELSE 'UNKNOWN' END AS category FROM c)"""


_LSF_SQL = f"""WITH {m.POLLS_SQL}, s AS (
  SELECT CASE WHEN job % 2 = 0 THEN 'slurm' ELSE 'lsf' END AS scheduler, rtrim(trim(split_part(raw, chr(10), 1)), '+') AS state, trim(raw) = '' AS blank FROM polls),
c AS (SELECT scheduler, blank, CASE WHEN scheduler = 'slurm' THEN state WHEN state = 'RUNNING' THEN 'RUN' WHEN state = 'PENDING' THEN 'PEND'
    WHEN state = 'COMPLETED' THEN 'DONE' WHEN state = 'FAILED' THEN 'EXIT' ELSE state END AS state FROM s)
SELECT scheduler, CASE WHEN blank THEN '' ELSE state END AS state,
  CASE WHEN blank THEN 'BLANK' WHEN state IN ('RUN', 'PEND', 'RUNNING', 'PENDING') THEN 'INCOMPLETE'
    WHEN state IN ('DONE', 'COMPLETED') THEN 'SUCCEEDED' WHEN state IN ('EXIT', 'FAILED') THEN 'FAILED' ELSE 'UNKNOWN' END AS category,
  count(*) AS polls FROM c GROUP BY ALL"""


@query("state_category", _LSF_SQL)
def state_category(spark, sf):
    # Odd jobs belong to the other scheduler, which has its own words.
    words = {"RUNNING": "RUN", "PENDING": "PEND", "COMPLETED": "DONE", "FAILED": "EXIT"}
    raw = F.col("raw")
    for slurm, lsf in words.items():
        raw = F.regexp_replace(raw, slurm, lsf)
    polls = m.polls(m.table(spark, sf, "events"))
    even = F.col("job") % 2 == 0
    both = polls.select(F.when(even, "slurm").otherwise("lsf").alias("scheduler"), F.when(even, F.col("raw")).otherwise(raw).alias("raw"))
    return j.state_counts(both)


OUTCOME_SQL = (
    _STATE_SQL
    + """, b AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY seq ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS blanks FROM g),
t AS (SELECT job, seq, CASE WHEN blanks = 4 THEN 'NO_ANSWER' WHEN category IN ('SUCCEEDED', 'FAILED', 'UNKNOWN') THEN category END AS ending FROM b)
SELECT job, coalesce(arg_min(ending, CASE WHEN ending IS NOT NULL THEN seq END), 'RUNNING') AS outcome,
  min(CASE WHEN ending IS NOT NULL THEN seq END) AS seq FROM t GROUP BY job"""
)


@query("job_outcome", OUTCOME_SQL)
def job_outcome(spark, sf):
    return j.job_outcome(m.polls(m.table(spark, sf, "events")), "slurm")


@query(
    "duration_sketch",
    f"""WITH {m.TASK_RUNS_SQL} SELECT task_name, count(completed_time) AS n, true AS p50_near, true AS p90_near, true AS p99_near
FROM task_runs GROUP BY 1 HAVING count(completed_time) > 0""",
)
def duration_sketch(spark, sf):
    # Sketches per part of the history, merged: the share of durations up to a percentile is off by 2 % at most, ties aside.
    tasks = m.task_runs(m.table(spark, sf, "events")).withColumn("part", F.col("start_time") % 7)
    found = h.sketched_stats(h.merge_sketches(h.duration_sketches(tasks, ["task_name", "part"])))
    timed = tasks.select("task_name", h.duration_ms().alias("ms")).where("ms is not null").join(found, "task_name")

    def near(name, share):
        below, upto = F.avg((F.col("ms") < F.col(name)).cast("int")), F.avg((F.col("ms") <= F.col(name)).cast("int"))
        return ((below <= share + 0.02) & (upto >= share - 0.02)).alias(f"{name}_near")

    return timed.groupBy("task_name").agg(F.max("n").alias("n"), near("p50", 0.5), near("p90", 0.9), near("p99", 0.99))
