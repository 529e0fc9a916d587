"""Queries: batches, resources, outcomes, concurrency, failures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowtable.operators import batches as b
from flowtable.operators import errors as e
from flowtable.operators import history as h
from flowtable.operators import incremental as inc
from flowtable.operators.position import with_position
from flowtable.plans import model as m
from flowtable.plans.registry import query

_POS_SQL = "p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events)"


@query(
    "batch_group",
    f"""WITH {_POS_SQL}, g AS (SELECT *, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 1 END AS size FROM p)
SELECT event_type AS task, (pos - 1) // size AS batch_id, count(*) AS n, min(event_id) AS first_id,
  string_agg(event_id, ',' ORDER BY pos) AS items FROM g GROUP BY 1, 2""",
)
def batch_group(spark, sf):
    events = m.table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("task"))
    size = F.when(F.col("task") == "click", 5).when(F.col("task") == "view", 3)
    numbered = b.batch(events, "task", ["ts", "event_id"], size)
    ids = F.sort_array(F.collect_list(F.struct("pos", "event_id")))
    return numbered.groupBy("task", "batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("event_id").alias("first_id"),
        F.concat_ws(",", F.transform(ids, lambda x: x["event_id"].cast("string"))).alias("items"),
    )


@query(
    "flux_buffer",
    f"""WITH {_POS_SQL} SELECT event_type, (pos - 1) // 3 AS buffer_id, string_agg(event_id, ',' ORDER BY pos) AS items
FROM p GROUP BY 1, 2""",
)
def flux_buffer(spark, sf):
    events = m.table(spark, sf, "events").select("event_id", "ts", "event_type")
    lists = b.buffer(events, "event_type", ["ts", "event_id"], 3, "event_id")
    text = F.concat_ws(",", F.transform("values", lambda v: v.cast("string")))
    return lists.select("event_type", "buffer_id", text.alias("items"))


_RESOURCES_SQL = """WITH i AS (SELECT l_orderkey AS batch, CASE WHEN l_linenumber <> 1 THEN CAST(floor(l_quantity) AS INTEGER) END AS cpus,
    CAST(floor(l_extendedprice) AS BIGINT) AS memory, CASE WHEN l_linenumber <> 2 THEN CAST(l_suppkey AS BIGINT) END AS disk FROM lineitem),
t AS (SELECT batch, max(cpus) AS cpus, max(memory) AS memory, max(disk) AS disk FROM i GROUP BY batch),
s AS (SELECT o_orderkey AS batch, CASE WHEN o_orderkey % 3 = 0 THEN 4 END AS cfg_cpus,
    CASE WHEN o_orderkey % 4 = 0 THEN 1000 END AS cfg_memory, CASE WHEN o_orderkey % 5 = 0 THEN 77 END AS cfg_disk FROM orders)"""


@query(
    "group_resources",
    _RESOURCES_SQL
    + """ SELECT batch, 'config' AS precedence, coalesce(cfg_cpus, cpus) AS cpus, CAST(coalesce(cfg_memory, memory) AS BIGINT) AS memory,
  CAST(coalesce(cfg_disk, disk) AS BIGINT) AS disk FROM t LEFT JOIN s USING (batch)
UNION ALL SELECT batch, 'runtime', coalesce(cpus, cfg_cpus), coalesce(memory, cfg_memory), coalesce(disk, cfg_disk) FROM t LEFT JOIN s USING (batch)""",
)
def group_resources(spark, sf):
    line = F.col("l_linenumber")
    lines = m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch"),
        F.when(line != 1, F.floor("l_quantity").cast("int")).alias("cpus"),
        F.floor("l_extendedprice").cast("bigint").alias("memory"),
        F.when(line != 2, F.col("l_suppkey").cast("bigint")).alias("disk"),
    )
    key = F.col("o_orderkey")
    settings = m.table(spark, sf, "orders").select(
        key.alias("batch"),
        F.when(key % 3 == 0, 4).alias("cfg_cpus"),
        F.when(key % 4 == 0, F.lit(1000).cast("bigint")).alias("cfg_memory"),
        F.when(key % 5 == 0, F.lit(77).cast("bigint")).alias("cfg_disk"),
    )
    # Aggregated and joined once; both orders of precedence are picked from the same row.
    both = b.batch_resources(lines, "batch").join(settings, "batch", "left")
    sides = [F.struct(F.lit(p).alias("precedence"), *[b.pick_resource(f, p) for f in b.RESOURCES]) for p in ("config", "runtime")]
    return both.select("batch", F.inline(F.array(*sides)))


@query(
    "group_time",
    "SELECT l_orderkey AS batch, CAST(max(CASE WHEN l_linenumber > 1 THEN l_linenumber END) * count(*) AS BIGINT) AS minutes FROM lineitem GROUP BY 1",
)
def group_time(spark, sf):
    lines = m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("batch"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).cast("bigint").alias("minutes"),
    )
    return b.batch_time(lines, "batch", "minutes")


def _line_path():
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("/", F.lit("out"), *parts)


_LINE_PATH_SQL = "'out/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey"
_OUTCOME_SQL = f"""WITH o AS (SELECT l_orderkey AS batch, {_LINE_PATH_SQL} AS path, l_returnflag = 'N' AS optional, l_linestatus, l_returnflag FROM lineitem),
f AS (SELECT path, bool_or(l_linestatus = 'F') AS is_file, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS is_none FROM o GROUP BY path),
w AS (SELECT batch, bool_and(is_file OR (optional AND is_none)) AS whole FROM o JOIN f USING (path) GROUP BY batch)
SELECT o_orderkey AS batch, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 10 = 0 THEN 'failed'
  WHEN coalesce(whole, true) THEN 'completed' ELSE 'partially completed' END AS status
FROM orders LEFT JOIN w ON batch = o_orderkey"""


@query("run_outcome", _OUTCOME_SQL)
def run_outcome(spark, sf):
    orders = m.table(spark, sf, "orders")
    lines = m.table(spark, sf, "lineitem").withColumn("path", _line_path())
    outputs = lines.select(F.col("l_orderkey").alias("batch"), "path", (F.col("l_returnflag") == "N").alias("optional"))
    found = F.when(F.col("l_linestatus") == "F", F.col("path")).when(
        F.col("l_returnflag") == "N", F.concat("path", F.lit(".none"))
    )
    manifest = lines.select(found.alias("path")).where(F.col("path").isNotNull())
    return inc.run_outcome(orders.select(F.col("o_orderkey").alias("batch")), outputs, manifest, _raised(orders))


def _raised(orders):
    bad = orders.where((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 10 == 0))
    return bad.select(F.col("o_orderkey").alias("batch"), F.concat(F.lit("job failed: "), "o_orderpriority").alias("error"))


@query(
    "batch_error",
    """SELECT l_orderkey AS batch, l_partkey AS item, 'job failed: ' || o_orderpriority AS error
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 10 = 0) ON l_orderkey = o_orderkey""",
)
def batch_error(spark, sf):
    items = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("item"))
    return e.spread_batch_errors(items, _raised(m.table(spark, sf, "orders")))


@query(
    "failed_count",
    f"WITH {m.TASK_RUNS_SQL} SELECT task_name, count(*) AS failed FROM task_runs WHERE completion_status <> 'completed' GROUP BY 1",
)
def failed_count(spark, sf):
    return h.failed_count(m.task_runs(m.table(spark, sf, "events")), "task_name")


@query(
    "run_success",
    f"WITH {m.TASK_RUNS_SQL}, {m.RUNS_SQL} SELECT run_id, completed_successfully AS ok FROM runs",
)
def run_success(spark, sf):
    tasks = m.task_runs(m.table(spark, sf, "events"))
    return h.run_success(tasks.select("run_id").distinct(), tasks)


@query(
    "status_rollup",
    f"""WITH {m.TASK_RUNS_SQL} SELECT task_name, CAST(grouping(task_name) AS INTEGER) AS level,
  count(CASE WHEN completed_time IS NULL THEN 1 END) AS in_progress,
  count(CASE WHEN completion_status = 'completed' THEN 1 END) AS succeeded,
  count(CASE WHEN completion_status = 'partially completed' THEN 1 END) AS partially_succeeded,
  count(CASE WHEN completion_status = 'failed' THEN 1 END) AS failed, count(*) AS total
FROM task_runs GROUP BY ROLLUP (task_name)""",
)
def status_rollup(spark, sf):
    return h.status_rollup(m.task_runs(m.table(spark, sf, "events")))


_PCT = "CAST(max(CASE WHEN rn = greatest(1, ceil(n * {p})) THEN ms END) AS BIGINT) AS {name}"


@query(
    "duration_stats",
    f"""WITH {m.TASK_RUNS_SQL}, d AS (SELECT task_name, completed_time - start_time AS ms FROM task_runs WHERE completed_time IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY ms) AS rn, count(*) OVER (PARTITION BY task_name) AS n FROM d)
SELECT task_name, count(*) AS n, round(avg(ms), 3) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms,
  {_PCT.format(p="0.5::DOUBLE", name="p50")}, {_PCT.format(p="0.9::DOUBLE", name="p90")}, {_PCT.format(p="0.99::DOUBLE", name="p99")}
FROM r GROUP BY 1""",
)
def duration_stats(spark, sf):
    stats = h.duration_stats(m.task_runs(m.table(spark, sf, "events")))
    return stats.withColumn("avg_ms", F.round("avg_ms", 3))


@query(
    "concurrency_profile",
    f"""WITH {m.TASK_RUNS_SQL}, e AS (
  SELECT task_name, start_time AS t, 1 AS d FROM task_runs WHERE completed_time IS NOT NULL
  UNION ALL SELECT task_name, completed_time, -1 FROM task_runs WHERE completed_time IS NOT NULL),
n AS (SELECT task_name, t, sum(d) AS d FROM e GROUP BY task_name, t UNION ALL SELECT 'ALL', t, sum(d) FROM e GROUP BY t),
r AS (SELECT task_name, sum(d) OVER (PARTITION BY task_name ORDER BY t) AS c FROM n)
SELECT task_name, CAST(max(c) AS BIGINT) AS peak, max(c) > CASE WHEN task_name = 'ALL' THEN 262144 ELSE 2 END AS over_limit FROM r GROUP BY 1""",
)
def concurrency_profile(spark, sf):
    # One pass for both levels: every run counts for its task and for the workflow.
    tasks = m.task_runs(m.table(spark, sf, "events"))
    levels = tasks.withColumn("task_name", F.explode(F.array(F.col("task_name"), F.lit("ALL"))))
    slots = F.when(F.col("task_name") == "ALL", 262144).otherwise(2)
    return h.concurrency(levels, "task_name", slots)


@query("keep_order", f"WITH {_POS_SQL} SELECT event_type, pos, event_id FROM p")
def keep_order(spark, sf):
    # Always the way for large inputs, so that the oracle sees it too.
    events = m.table(spark, sf, "events").select("event_type", "ts", "event_id")
    return with_position(events, "event_type", ["ts", "event_id"]).select("event_type", "pos", "event_id")


@query(
    "depth_progress",
    """WITH k AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS j FROM events),
l AS (SELECT CASE WHEN j IN (1, 2, 3) THEN j ELSE 4 END AS lost FROM k)
SELECT step, CAST(count(CASE WHEN lost >= step THEN 1 END) AS BIGINT) AS reached,
  CAST(count(CASE WHEN lost > step THEN 1 END) AS BIGINT) AS completed
FROM l, (VALUES (1), (2), (3)) s(step) GROUP BY step""",
)
def depth_progress(spark, sf):
    steps = m.table(spark, sf, "events").select(
        F.col("event_id").alias("item"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step"), m.event_k().alias("k")
    )
    return e.depth_progress(steps.withColumn("failed", F.col("k") % 7 == F.col("step")), 3)


@query(
    "error_isolate",
    """WITH r AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE json_extract_string(props, '$.k') END AS raw FROM events),
t AS (SELECT event_id, raw, TRY_CAST(raw AS INTEGER) AS k FROM r)
SELECT event_id, CAST(CASE WHEN k <> 0 THEN 1000 // k END AS BIGINT) AS result,
  CASE WHEN k IS NULL THEN 'not a number: ' || raw WHEN k = 0 THEN 'division by zero' END AS error FROM t""",
)
def error_isolate(spark, sf):
    raw = F.when(F.col("event_id") % 13 == 0, "bad").otherwise(F.get_json_object("props", "$.k"))
    items = m.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    k = F.col("raw").try_cast("int")
    error = F.when(k.isNull(), F.concat(F.lit("not a number: "), "raw")).when(k == 0, "division by zero")
    return e.tried(items, {"result": F.floor(F.lit(1000) / F.when(k != 0, k))}, error).select("event_id", "result", "error")


@query(
    "retry_outcome",
    """WITH a AS (SELECT user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
    event_type = 'purchase' AS ok, event_type <> 'error' AS retryable, event_type || ' ' || event_id AS error FROM events),
b AS (SELECT * FROM a WHERE attempt <= 3),
e AS (SELECT item, coalesce(min(CASE WHEN ok OR NOT retryable THEN attempt END), max(attempt)) AS attempt FROM b GROUP BY item)
SELECT b.item, ok, b.attempt, CASE WHEN NOT ok THEN error END AS error FROM b JOIN e ON b.item = e.item AND b.attempt = e.attempt""",
)
def retry_outcome(spark, sf):
    kind = F.col("event_type")
    # Only the first three attempts count, and Spark cuts to them before the shuffle.
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    attempts = (
        m.table(spark, sf, "events")
        .withColumn("attempt", F.row_number().over(w))
        .where("attempt <= 3")
        .select(
            F.col("user_id").alias("item"),
            F.col("attempt").cast("bigint").alias("attempt"),
            (kind == "purchase").alias("ok"),
            (kind != "error").alias("retryable"),
            F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("error"),
        )
    )
    return e.retry_outcome(attempts)
