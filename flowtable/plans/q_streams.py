"""Queries: the streaming operators, each drained over a table read as a file stream.

The oracles say the same over the bounded table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtable.operators.content import base64_text
from flowtable.plans import model as m
from flowtable.plans import q_items
from flowtable.plans.q_batches import _POS_SQL
from flowtable.plans.q_history import OUTCOME_SQL, event_log
from flowtable.plans.registry import ORACLES, query
from flowtable.plans.workflow import Workflow
from flowtable.session import new_path
from flowtable.streaming.buffer import read_buffers, stream_buffer
from flowtable.streaming.dedup import read_paths, stream_dedup
from flowtable.streaming.epochs import START, drain, finish, read_all
from flowtable.streaming.incremental import STORE_SCHEMA, stream_incremental
from flowtable.streaming.jobs import read_outcomes, stream_job_outcome
from flowtable.streaming.status import read_counts, read_report, read_status, report_counts, stream_report, stream_status


@query("stream_task", ORACLES["task_map"])
def stream_task(spark, sf):
    wf = Workflow("stream")
    arriving = m.documents(m.split_stream(spark, sf, "documents", "task-in")).drop("text")
    out = wf.task("base64", arriving, q_items.base64_task)
    return drain(out.select("item_id", "task", "image", "output", "command"), "stream-task")


@query(
    "stream_skip",
    f"""WITH {m.DECLARED_SQL}, {m.MANIFEST_SQL}, done AS (
  SELECT item_id, bool_and(path IN (SELECT path FROM manifest)
    OR (optional AND path || '.none' IN (SELECT path FROM manifest))) AS done FROM declared GROUP BY item_id)
SELECT 'base64/' || doc_id || '.b64' AS path, CAST(length(base64(encode(text))) AS BIGINT) AS length
FROM documents LEFT JOIN done ON doc_id = item_id WHERE NOT coalesce(done, false)""",
)
def stream_skip(spark, sf):
    root = new_path(spark, "stream-skip")
    run = lambda todo: todo.select(
        F.concat(F.lit("base64/"), F.col("item_id").cast("string"), F.lit(".b64")).alias("path"),
        base64_text("text").alias("content"),
    )
    before = m.manifest(m.documents(m.table(spark, sf, "documents")))
    arriving = m.documents(m.split_stream(spark, sf, "documents", "skip-in"))
    finish(stream_incremental(arriving, root, m.declared, run, before))
    stored = read_all(spark, f"{root}/store", STORE_SCHEMA).where(F.col("epoch") > START)
    return stored.select("path", F.length("content").cast("bigint").alias("length"))


@query(
    "stream_buffer",
    f"""WITH {_POS_SQL} SELECT event_type, (pos - 1) // 3 AS buffer_id, string_agg(event_id, ',' ORDER BY pos) AS items
FROM p GROUP BY 1, 2""",
)
def stream_buffer_query(spark, sf):
    root = new_path(spark, "stream-buffer")
    events = m.table(spark, sf, "events").select("event_type", "ts", "event_id", F.col("event_id").alias("item"), m.event_ms().alias("ms"))
    arriving = m.timed_stream(events, "ms", "buffer-in").drop("ms")
    finish(stream_buffer(arriving, "event_type", ["ts", "event_id"], "item", 3, root))
    buffers = read_buffers(spark, arriving, "event_type", ["ts", "event_id"], "item", root)
    text = F.concat_ws(",", F.transform("values", lambda v: v.cast("string")))
    return buffers.select("event_type", "buffer_id", text.alias("items"))


@query("stream_status", ORACLES["record_upsert"])
def stream_status_query(spark, sf):
    root = new_path(spark, "stream-status")
    finish(stream_status(event_log(m.task_runs(m.split_stream(spark, sf, "events", "status-in"))), root))
    return read_status(spark, root)


@query(
    "stream_counts",
    """SELECT epoch_ms(time_bucket(INTERVAL '120 seconds', ts, TIMESTAMP '1970-01-01')) AS start_ms, event_type AS kind, count(*) AS n
FROM events GROUP BY 1, 2""",
)
def stream_counts(spark, sf):
    root = new_path(spark, "stream-counts")
    arriving = m.split_stream(spark, sf, "events", "counts-in").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")
    )
    finish(report_counts(arriving, root))
    return read_counts(spark, root).select(F.unix_millis("start").alias("start_ms"), "kind", "n")


@query(
    "stream_report",
    f"""WITH {m.TASK_RUNS_SQL} SELECT run_id, CASE WHEN completed_time IS NULL THEN 'IN_PROGRESS'
    WHEN completion_status = 'completed' THEN 'SUCCEEDED' WHEN completion_status = 'partially completed' THEN 'PARTIALLY_SUCCEEDED'
    ELSE 'FAILED' END AS status, count(*) AS n FROM task_runs GROUP BY ALL""",
)
def stream_report_query(spark, sf):
    root = new_path(spark, "stream-report")
    # Starts and ends are dealt apart, so that statuses change from micro-batch to micro-batch, and ends come first.
    changes = m.dealt_stream(event_log(m.task_runs(m.table(spark, sf, "events")), "run_id"), "report-in")
    for _ in range(2):  # the second time nothing has changed, and nothing is reported
        finish(stream_report(changes, root, trigger={"availableNow": True}))
    return read_report(spark, root)


@query("stream_job_outcome", OUTCOME_SQL)
def stream_job_outcome_query(spark, sf):
    root = new_path(spark, "stream-jobs")
    polls = m.polls(m.table(spark, sf, "events"))
    finish(stream_job_outcome(m.timed_stream(polls, "seq", "jobs-in"), "slurm", root))
    return read_outcomes(spark, root)


@query("stream_dedup", "SELECT DISTINCT 'out/' || user_id || '/' || event_type AS path FROM events WHERE user_id % 9 <> 4")
def stream_dedup_query(spark, sf):
    root = new_path(spark, "stream-dedup")
    path = F.concat_ws("/", F.lit("out"), F.col("user_id").cast("string"), "event_type").alias("path")
    there = m.table(spark, sf, "events").where("user_id % 9 = 4").select(path).distinct()
    finish(stream_dedup(m.split_stream(spark, sf, "events", "dedup-in").select(path), root, there))
    return read_paths(spark, root)
