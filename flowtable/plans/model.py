"""The driver's tables seen as items, files, task runs, polls and settings.

Everything is derived row by row from the given tables, so it grows with them. The SQL
twins (`*_SQL`) are the same tables for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtable.session import new_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def split_stream(spark: SparkSession, sf: str, name: str, label: str, batches: int = 4) -> DataFrame:
    """The table as a stream of several micro-batches, its rows dealt over them without regard to their order."""
    return dealt_stream(table(spark, sf, name), label, batches)


def dealt_stream(rows: DataFrame, label: str, batches: int = 4) -> DataFrame:
    """Rows as a stream of several micro-batches, dealt without regard to their order. A micro-batch has as many files as
    its share of the partitions of `rows`, so no task reads more than a partition holds."""
    path = new_path(rows.sparkSession, label)
    files = max(1, -(-rows.rdd.getNumPartitions() // batches))
    rows.repartition(batches * files).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def timed_stream(rows: DataFrame, by: str, label: str, batches: int = 4) -> DataFrame:
    """Rows as a stream of several micro-batches in the order of the number `by`."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, label)
    cuts = rows.approxQuantile(by, [i / batches for i in range(1, batches)], 0.01)
    place = sum([(F.col(by) > c).cast("int") for c in cuts], F.lit(0))
    for i in range(batches):  # one file after another, so that their times tell the order
        rows.where(place == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


# --- documents -> items, outputs, manifest ------------------------------------------------

def documents(df: DataFrame) -> DataFrame:
    """Items: one text file per document."""
    path = F.concat_ws("/", F.lit("docs"), "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang", F.lit("txt")))
    return df.select(F.col("doc_id").alias("item_id"), path.alias("path"), "text")


DOCUMENTS_SQL = "docs AS (SELECT doc_id AS item_id, 'docs/' || source || '/' || doc_id || '.' || lang || '.txt' AS path, text FROM documents)"


def declared(df: DataFrame) -> DataFrame:
    """Outputs of the items: one required and one optional; every 11th item declares none."""
    i = F.col("item_id")
    out = lambda p, optional: F.struct(p.alias("path"), F.lit(optional).alias("optional"))
    return df.where(i % 11 != 0).select(
        "item_id",
        F.inline(
            F.array(
                out(F.concat(F.lit("base64/"), i.cast("string"), F.lit(".b64")), False),
                out(F.concat(F.lit("gzip/"), i.cast("string"), F.lit(".fake")), True),
            )
        ),
    )


def manifest(df: DataFrame) -> DataFrame:
    """What exists already, by document number."""
    i = F.col("item_id")
    text = i.cast("string")
    paths = F.array(
        F.when(i % 3 != 0, F.concat(F.lit("base64/"), text, F.lit(".b64"))),
        F.when(i % 5 == 0, F.concat(F.lit("gzip/"), text, F.lit(".fake"))),
        F.when((i % 5).isin(1, 2, 3), F.concat(F.lit("gzip/"), text, F.lit(".fake.none"))),
    )
    return df.select(F.explode(F.array_compact(paths)).alias("path"))


DECLARED_SQL = """declared AS (
  SELECT doc_id AS item_id, 'base64/' || doc_id || '.b64' AS path, false AS optional FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 'gzip/' || doc_id || '.fake', true FROM documents WHERE doc_id % 11 <> 0)"""
MANIFEST_SQL = """manifest AS (
  SELECT 'base64/' || doc_id || '.b64' AS path FROM documents WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'gzip/' || doc_id || '.fake' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT 'gzip/' || doc_id || '.fake.none' FROM documents WHERE doc_id % 5 IN (1, 2, 3))"""


# --- events -> run history, polls, attempts -----------------------------------------------

DAYS = 100_000  # a run is known by its user, then its day since 1970


def event_ms() -> Column:
    return F.expr("unix_micros(cast(ts as timestamp)) div 1000")


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def task_runs(df: DataFrame) -> DataFrame:
    """One task run per event; a run is a user's day."""
    k, ms = F.col("__k"), F.col("start_time")
    base = df.withColumns({"__k": event_k(), "start_time": event_ms()})
    status = F.when(k < 80, "completed").when(k < 90, "partially completed").when(k < 97, "failed")
    return base.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") * DAYS + F.unix_date(F.col("ts").cast("date"))).alias("run_id"),
        F.col("event_type").alias("task_name"),
        "start_time",
        status.alias("completion_status"),
        F.when(k < 97, ms + F.round(F.col("value") * 1000).cast("bigint")).alias("completed_time"),
        "props",
    )


TASK_RUNS_SQL = """k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms FROM events),
task_runs AS (
  SELECT event_id AS id, user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS run_id, event_type AS task_name, ms AS start_time,
    CASE WHEN k < 80 THEN 'completed' WHEN k < 90 THEN 'partially completed' WHEN k < 97 THEN 'failed' END AS completion_status,
    CASE WHEN k < 97 THEN ms + CAST(round(value * 1000) AS BIGINT) END AS completed_time, props
  FROM k)"""


def runs(tasks: DataFrame) -> DataFrame:
    bad = F.count(F.when(F.col("completion_status") != "completed", 1))
    waiting = F.count(F.when(F.col("completed_time").isNull(), 1))
    return tasks.groupBy("run_id").agg(
        F.concat(F.lit("user-"), F.floor(F.col("run_id") / DAYS).cast("string")).alias("workflow_name"),
        F.min("start_time").alias("start_time"),
        (bad == 0).alias("completed_successfully"),
        F.when(waiting == 0, F.max("completed_time")).alias("completed_time"),
    )


RUNS_SQL = """runs AS (
  SELECT run_id, 'user-' || (run_id // 100000) AS workflow_name, min(start_time) AS start_time,
    count(CASE WHEN completion_status <> 'completed' THEN 1 END) = 0 AS completed_successfully,
    CASE WHEN count(CASE WHEN completed_time IS NULL THEN 1 END) = 0 THEN max(completed_time) END AS completed_time
  FROM task_runs GROUP BY run_id)"""


def polls(df: DataFrame) -> DataFrame:
    k = event_k()
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", "")
        .when(kind == "signup", "PENDING")
        .when(kind == "view", "RUNNING+")
        .when((kind == "purchase") & (k < 10), "COMPLETED\nCOMPLETED")
        .when((kind == "error") & (k < 10), " FAILED ")
        .when((kind == "error") & (k > 97), "LOST")
        .otherwise("RUNNING")
    )
    return df.select(F.col("user_id").alias("job"), F.expr("unix_micros(cast(ts as timestamp))").alias("seq"), raw.alias("raw"))


POLLS_SQL = """polls AS (
  SELECT user_id AS job, epoch_us(ts) AS seq,
    CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'signup' THEN 'PENDING' WHEN event_type = 'view' THEN 'RUNNING+'
      WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN 'COMPLETED' || chr(10) || 'COMPLETED'
      WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 10 THEN ' FAILED '
      WHEN event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 97 THEN 'LOST'
      ELSE 'RUNNING' END AS raw
  FROM events)"""


def settings(customers: DataFrame) -> DataFrame:
    """Settings leaves: constant defaults, a layer per segment and per nation group, some by name."""
    spark = customers.sparkSession
    defaults = spark.range(1).select(
        F.lit("default").alias("key"),
        F.inline(
            F.array(
                _leaf("google.machine-type", F.lit("n1-standard-2")),
                _leaf("google.disk-size", F.lit("10GB")),
                _leaf("grouping", F.lit("3")),
            )
        ),
        F.lit(0).cast("bigint").alias("layer_seq"),
    )
    seg = F.lower("c_mktsegment")
    by_segment = customers.select("c_mktsegment").distinct().select(
        seg.alias("key"),
        F.inline(
            F.array(
                _leaf("google.disk-size", F.concat(F.length("c_mktsegment").cast("string"), F.lit("GB"))),
                F.when(F.length("c_mktsegment") % 2 == 0, _leaf("params", F.concat(F.lit("flat-"), seg))).otherwise(
                    _leaf("google.zone.name", seg)
                ),
            )
        ),
        F.length("c_mktsegment").cast("bigint").alias("layer_seq"),
    )
    # group-2 and group-3 hold the same content.
    by_group = customers.select((F.col("c_nationkey") % 4).alias("g")).distinct().select(
        F.concat(F.lit("group-"), F.col("g").cast("string")).alias("key"),
        F.inline(F.array(_leaf("grouping", F.least("g", F.lit(2)).cast("string")))),
        (F.col("g") + 20).cast("bigint").alias("layer_seq"),
    )
    own = customers.where("c_acctbal < 0").select(
        F.lower(F.regexp_replace("c_name", "#", "-")).alias("key"),
        F.inline(
            F.array(
                _leaf("params.db.user", F.col("c_name")),
                F.when(F.col("c_custkey") % 3 == 0, _leaf("google", F.lit("none"))).otherwise(
                    _leaf("grouping.per-node", F.lit("1"))
                ),
            )
        ),
        (F.col("c_custkey") + 100).alias("layer_seq"),
    )
    stray = customers.agg(F.lit("no-such-task").alias("key")).select(
        "key", F.lit("grouping").alias("path"), F.lit("9").alias("value"), F.lit(7).cast("bigint").alias("layer_seq")
    )
    return defaults.unionByName(by_segment).unionByName(by_group).unionByName(own).unionByName(stray)


def _leaf(path: str, value) -> Column:
    return F.struct(F.lit(path).alias("path"), value.alias("value"))


def entities(customers: DataFrame) -> DataFrame:
    group = F.concat(F.lit("Group "), (F.col("c_nationkey") % 4).cast("string"))
    twin = F.concat(F.lit("group_"), ((F.col("c_nationkey") + 1) % 4).cast("string"))
    return customers.select(F.col("c_name").alias("name"), F.array("c_mktsegment", group, twin).alias("labels"))


SETTINGS_SQL = """settings AS (
  SELECT 'default' AS key, p AS path, v AS value, 0 AS layer_seq
    FROM (VALUES ('google.machine-type', 'n1-standard-2'), ('google.disk-size', '10GB'), ('grouping', '3')) t(p, v)
  UNION ALL SELECT DISTINCT lower(c_mktsegment), 'google.disk-size', length(c_mktsegment) || 'GB', length(c_mktsegment) FROM customer
  UNION ALL SELECT DISTINCT lower(c_mktsegment), CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'params' ELSE 'google.zone.name' END,
    CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'flat-' || lower(c_mktsegment) ELSE lower(c_mktsegment) END, length(c_mktsegment) FROM customer
  UNION ALL SELECT DISTINCT 'group-' || (c_nationkey % 4), 'grouping', CAST(least(c_nationkey % 4, 2) AS VARCHAR), (c_nationkey % 4) + 20 FROM customer
  UNION ALL SELECT replace(lower(c_name), '#', '-'), 'params.db.user', c_name, c_custkey + 100 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT replace(lower(c_name), '#', '-'), CASE WHEN c_custkey % 3 = 0 THEN 'google' ELSE 'grouping.per-node' END,
    CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE '1' END, c_custkey + 100 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'no-such-task', 'grouping', '9', 7),
entity_keys AS (
  SELECT name, key, min(rank) AS rank FROM (
    SELECT c_name AS name, 'default' AS key, 0 AS rank FROM customer
    UNION ALL SELECT c_name, regexp_replace(lower(c_name), '[^a-z0-9]', '-', 'g'), 1 FROM customer
    UNION ALL SELECT c_name, regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '-', 'g'), 2 FROM customer
    UNION ALL SELECT c_name, 'group-' || (c_nationkey % 4), 2 FROM customer
    UNION ALL SELECT c_name, 'group-' || ((c_nationkey + 1) % 4), 2 FROM customer) GROUP BY name, key),
layers AS (SELECT key, min(layer_seq) AS seq, string_agg(path || '=' || value, ';' ORDER BY path) AS content FROM settings GROUP BY key),
matched AS (
  SELECT name, key, rank, seq FROM (
    SELECT e.name, e.key, e.rank, l.seq,
      row_number() OVER (PARTITION BY e.name, e.rank, l.content, CASE WHEN e.rank < 2 THEN e.key END ORDER BY l.seq, e.key) AS rn
    FROM entity_keys e JOIN layers l ON e.key = l.key) WHERE rn = 1)"""
