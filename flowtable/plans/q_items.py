"""Queries: sources, sinks, per-item steps, combining streams."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from flowtable.functions.common import render
from flowtable.functions.paths import file_name, mount_path, none_marker, stem
from flowtable.operators import incremental as inc
from flowtable.operators.batches import zip_streams
from flowtable.operators.content import base64_text, content_pipeline, content_stages
from flowtable.operators.history import status_doc, status_entries, with_workflow_status
from flowtable.operators.tasks import flat_items, lookup_strict, merge_as_json, task_map, validate_requests
from flowtable.plans import model as m
from flowtable.plans.registry import query
from flowtable.operators.incremental import downstream
from flowtable.plans.run import ChainStep, GraphStep, run_chain, run_graph, run_step
from flowtable.plans.workflow import Workflow
from flowtable.session import new_path
from flowtable.sources.items import items
from flowtable.sources.listing import list_files
from flowtable.sources.files import output_files, write_output_files
from flowtable.sources.outputs import write_outputs, write_status
from flowtable.sources.store import Store


@query("src_items", "SELECT doc_id AS item, lang, source, n_chars FROM documents")
def src_items(spark, sf):
    return items(spark, f"{sf}/documents.parquet").select(F.col("doc_id").alias("item"), "lang", "source", "n_chars")


@query(
    "src_listing",
    """SELECT 'status=' || o_orderstatus AS folder, count(*) AS items, 0::BIGINT AS unlisted, 0::BIGINT AS surplus,
  0::BIGINT AS differing FROM orders GROUP BY 1""",
)
def src_listing(spark, sf):
    # Outputs of a step, written per status, against their listing: every file that holds rows is listed
    # with its length and time, and no other data file is.
    root = new_path(spark, "orders")
    m.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")).write.partitionBy(
        "status"
    ).parquet(root)
    rows = spark.read.schema("o_orderkey bigint, status string").parquet(root)
    known = rows.select(
        _bare("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.unix_millis("_metadata.file_modification_time").alias("ms"),
    )
    per_file = known.groupBy("file", "size", "ms").agg(F.count(F.lit(1)).alias("n"))
    data = list_files(spark, root).where(F.col("path").endswith(".parquet") & ~F.col("path").rlike(r"/\.[^/]*$"))
    listing = data.select(_bare("path").alias("file"), "length", F.unix_millis("modified").alias("listed_ms"))
    both = per_file.join(listing, "file", "full")
    count = lambda cond: F.count(F.when(cond, 1))
    return both.groupBy(F.regexp_extract("file", "/(status=[^/]*)/", 1).alias("folder")).agg(
        F.sum("n").alias("items"),
        count(F.col("length").isNull()).alias("unlisted"),
        count(F.col("n").isNull()).alias("surplus"),
        count((F.col("length") != F.col("size")) | (F.col("listed_ms") != F.col("ms"))).alias("differing"),
    )


def _bare(path):
    """A file URI without its scheme, which Spark writes with one or three slashes."""
    return F.regexp_replace(path, "^[a-z0-9]+:/+", "/")


_DIRS_SQL = f"""WITH {m.DOCUMENTS_SQL}, dirs AS (SELECT DISTINCT 'extra/' || source AS dir FROM documents WHERE source <> 'src1'),
listing AS (
  SELECT 'extra/' || source || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 4 <> 0
  UNION ALL SELECT 'extra/' || source || '/' || lang || '/' || doc_id || '.log' FROM documents)
SELECT d.dir, l.path FROM dirs d JOIN listing l ON starts_with(l.path, d.dir || '/')"""


@query("src_dir_outputs", _DIRS_SQL)
def src_dir_outputs(spark, sf):
    docs = m.table(spark, sf, "documents").select("doc_id", "source", "lang")
    i = F.col("doc_id").cast("string")
    found = F.array(
        F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("extra/"), "source", F.lit("/"), i, F.lit(".txt"))),
        F.concat(F.lit("extra/"), "source", F.lit("/"), "lang", F.lit("/"), i, F.lit(".log")),
    )
    listing = docs.select(F.explode(F.array_compact(found)).alias("path"))
    dirs = docs.where("source <> 'src1'").select(F.concat(F.lit("extra/"), "source").alias("dir"))
    return inc.directory_files(dirs, listing)


@query(
    "src_file_exists",
    f"WITH {m.DECLARED_SQL}, {m.MANIFEST_SQL} SELECT item_id, path FROM declared WHERE path IN (SELECT path FROM manifest)",
)
def src_file_exists(spark, sf):
    docs = m.documents(m.table(spark, sf, "documents"))
    return inc.existing(m.declared(docs), m.manifest(docs)).select("item_id", "path")


_STORED_SQL = """WITH docs AS (SELECT doc_id, text, base64(encode(text)) AS b64 FROM documents)
SELECT 'base64' AS task, doc_id AS item_id, 'base64/' || doc_id || '.b64' AS path,
  CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'file' END AS status,
  CAST(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE length(b64) END AS BIGINT) AS length FROM docs WHERE doc_id % 11 <> 0
UNION ALL
SELECT 'base64', doc_id, 'gzip/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.fake' ELSE '.fake.none' END,
  CASE WHEN doc_id % 5 = 0 THEN 'file' ELSE 'none' END, CAST(CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 0 END AS BIGINT)
FROM docs WHERE doc_id % 11 <> 0"""


@query("snk_outputs", _STORED_SQL)
def snk_outputs(spark, sf):
    docs = m.documents(m.table(spark, sf, "documents"))
    return write_outputs(_produced(docs), m.declared(docs), new_path(spark, "outputs"), "base64")


@query("snk_files", _STORED_SQL)
def snk_files(spark, sf):
    # The same outputs as files at their paths; what the manifest says of them is read from the files that are there.
    docs, root = m.documents(m.table(spark, sf, "documents")), new_path(spark, "files")
    manifest = write_output_files(_produced(docs), m.declared(docs), root, "base64")
    there = output_files(spark, root).select("path", F.col("length").alias("found"))
    both = manifest.join(there, "path", "full")
    status = F.when((F.col("found").isNotNull()) == (F.col("status") != "missing"), F.col("status")).otherwise("differs")
    return both.select("task", "item_id", "path", status.alias("status"), F.coalesce("found", F.lit(0).cast("bigint")).alias("length"))


def _produced(docs):
    """What a step makes of the documents: some files are missing, one is not declared."""
    i = F.col("item_id")
    file = lambda p, c: F.struct(p.alias("path"), c.alias("content"))
    return docs.select(
        "item_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(i % 13 != 0, file(render("base64/{i}.b64", i=i), base64_text("text"))),
                    F.when(i % 5 == 0, file(render("gzip/{i}.fake", i=i), F.lit("fake"))),
                    file(render("tmp/{i}.undeclared", i=i), F.lit("not kept")),
                )
            )
        ),
    )


@query(
    "step_rerun",
    """SELECT doc_id AS item_id, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'run' ELSE 'skip' END AS action,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'lost' ELSE 'done' END AS outcome FROM documents""",
)
def step_rerun(spark, sf):
    # The same step twice: the second time only what is missing or undeclared runs.
    docs = m.documents(m.table(spark, sf, "documents"))
    store = Store(spark, new_path(spark, "store"))
    run_step(store, "base64", docs, m.declared, _produced, run_id=1, grouping=100)
    again = run_step(store, "base64", docs, m.declared, _produced, run_id=2, grouping=100)
    lost = again.lost.select("item_id", F.lit("lost").alias("outcome"))
    return again.planned.join(lost, "item_id", "left").select(
        "item_id", "action", F.coalesce("outcome", F.lit("done")).alias("outcome")
    )


_DOC_SQL = f"""WITH {m.TASK_RUNS_SQL}, {m.RUNS_SQL}, entries AS (
  SELECT t.run_id, t.id,
    json_object('taskName', task_name, 'startTime', start_time, 'completionStatus',
      CASE WHEN completed_time IS NULL THEN 'IN_PROGRESS' WHEN completion_status = 'completed' THEN 'SUCCEEDED'
        WHEN completion_status = 'partially completed' THEN 'PARTIALLY_SUCCEEDED' ELSE 'FAILED' END,
      'completedTime', completed_time, 'executions',
      json_array(json_object('image', task_name, 'command', props, 'input', 'events/' || id, 'output', 'out/' || id)))::VARCHAR AS entry
  FROM task_runs t),
docs AS (
  SELECT r.run_id,
    '{{"workflowRunStatus":' || json_object('workflowName', any_value(workflow_name), 'startTime', any_value(start_time),
       'completedSuccessfully', any_value(completed_successfully), 'completedTime', min(completed_time))::VARCHAR
    || ',"taskRunStatuses":[' || string_agg(entry, ',' ORDER BY e.id) || ']}}' AS doc
  FROM runs r JOIN entries e ON r.run_id = e.run_id GROUP BY r.run_id)"""


def _executed(spark, sf):
    tasks = m.task_runs(m.table(spark, sf, "events"))
    text = F.col("id").cast("string")
    execution = F.struct(
        F.col("task_name").alias("image"),
        F.col("props").alias("command"),
        F.concat(F.lit("events/"), text).alias("input"),
        F.concat(F.lit("out/"), text).alias("output"),
    )
    return tasks.withColumn("executions", F.array(execution))


@query("status_doc", _DOC_SQL + " SELECT run_id, doc FROM docs")
def status_docs(spark, sf):
    tasks = _executed(spark, sf)
    return status_doc(m.runs(tasks), tasks)


@query("status_entries", _DOC_SQL + " SELECT run_id, id, entry FROM entries")
def status_rows(spark, sf):
    entries = status_entries(_executed(spark, sf))
    return entries.select("run_id", "id", F.to_json("entry", {"ignoreNullFields": "false"}).alias("entry"))


@query(
    "snk_status_json",
    _DOC_SQL
    + """ SELECT json_extract_string(doc, '$.workflowRunStatus.workflowName') AS workflow,
  CAST(count(*) AS BIGINT) AS documents, CAST(sum(json_array_length(doc, '$.taskRunStatuses')) AS BIGINT) AS tasks,
  CAST(sum(len(string_split(doc, '"completionStatus":"FAILED"')) - 1) AS BIGINT) AS failed FROM docs GROUP BY 1""",
)
def snk_status_json(spark, sf):
    path, tasks = new_path(spark, "status"), _executed(spark, sf)
    write_status(status_doc(m.runs(tasks), tasks), path)
    schema = (
        "workflowRunStatus struct<workflowName:string,startTime:bigint,completedSuccessfully:boolean,completedTime:bigint>,"
        "taskRunStatuses array<struct<taskName:string,completionStatus:string>>"
    )
    docs = spark.read.schema(schema).json(path)
    failed = F.size(F.filter("taskRunStatuses", lambda t: t["completionStatus"] == "FAILED"))
    return docs.groupBy(F.col("workflowRunStatus.workflowName").alias("workflow")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.size("taskRunStatuses")).alias("tasks"),
        F.sum(failed).alias("failed"),
    )


@query(
    "snk_unused",
    f"""WITH {m.DECLARED_SQL}, {m.MANIFEST_SQL}
SELECT DISTINCT path FROM manifest WHERE path NOT IN (
  SELECT path FROM declared UNION ALL SELECT path || '.none' FROM declared WHERE optional)""",
)
def snk_unused(spark, sf):
    docs = m.documents(m.table(spark, sf, "documents"))
    marked = F.when(F.col("optional"), F.array(F.col("path"), none_marker("path"))).otherwise(F.array("path"))
    referenced = m.declared(docs).select(F.explode(marked).alias("path"))
    return inc.unused_files(m.manifest(docs), referenced)


_TASK_SQL = f"""WITH {m.DOCUMENTS_SQL}, s AS (SELECT *, split_part(split_part(path, '/', -1), '.', 1) AS stem FROM docs)
SELECT item_id, 'base64' AS task, 'alpine:3.8' AS image, 'base64/' || stem || '.b64' AS output,
  'base64 /inputs/' || path || ' > /outputs/base64/' || stem || '.b64' AS command FROM s"""


def base64_task(df):
    """The first step of the sample workflow: one request per text file."""
    output = render("base64/{stem}.b64", stem=stem("path"))
    command = render(
        "base64 {src} > {dst}", src=mount_path(F.lit("local"), "path"), dst=mount_path(F.lit("output"), output)
    )
    return task_map(df, "base64", image="alpine:3.8", outputs={"output": output}, command=command)


@query("task_map", _TASK_SQL)
def task_map_query(spark, sf):
    done = base64_task(m.documents(m.table(spark, sf, "documents")).drop("text"))
    return done.select("item_id", "task", "image", "output", "command")


@query(
    "task_validate",
    """WITH p AS (SELECT p_partkey AS item,
    coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_type END, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END) AS image,
    CASE WHEN p_partkey % 9 <> 0 THEN 'out/' || p_partkey END AS output,
    CASE WHEN p_partkey % 8 = 0 THEN '/outputs' ELSE '/inputs' END AS inputs_dir FROM part)
SELECT item, image, concat_ws('; ', CASE WHEN image IS NULL THEN 'image is missing' END,
  CASE WHEN output IS NULL THEN 'output is missing' END,
  CASE WHEN inputs_dir = '/outputs' THEN 'inputs and outputs share a folder' END) AS violations FROM p""",
)
def task_validate(spark, sf):
    i = F.col("p_partkey")
    requests = m.table(spark, sf, "part").select(
        i.alias("item"),
        F.when(i % 7 != 0, F.col("p_brand")).alias("image"),
        F.when(i % 5 == 0, F.col("p_type")).alias("image_setting"),
        F.when(i % 9 != 0, F.concat(F.lit("out/"), i.cast("string"))).alias("output"),
        F.when(i % 8 == 0, "/outputs").otherwise("/inputs").alias("inputs_dir"),
        F.lit("/outputs").alias("outputs_dir"),
    )
    checked = validate_requests(requests, image_override="image_setting")
    return checked.select("item", "image", F.concat_ws("; ", "violations").alias("violations"))


@query(
    "task_chain",
    f"""WITH {m.DOCUMENTS_SQL}, s AS (SELECT *, split_part(split_part(path, '/', -1), '.', 1) AS stem FROM docs)
SELECT 'base64' AS task, item_id, 'base64/' || stem || '.b64' AS path FROM s
UNION ALL SELECT 'gzip', item_id, 'gzip/' || stem || '.b64.gz' FROM s
UNION ALL SELECT 'gzip-extra', item_id, 'gzip/' || x || '.txt.gz' FROM s, (VALUES ('one'), ('two')) t(x)""",
)
def task_chain(spark, sf):
    wf = Workflow("sample")
    docs = m.documents(m.table(spark, sf, "documents")).drop("text")
    first = wf.task("base64", docs, lambda df: base64_task(df).select("item_id", F.col("output").alias("path")), ["small"])
    squeeze = lambda df: df.select("item_id", render("gzip/{f}.gz", f=file_name("path")).alias("path"))
    wf.task("gzip", first, squeeze)
    # The folder output of the first step holds two files per item.
    extra = flat_items(first.drop("path"), F.array(F.lit("extra/one.txt"), F.lit("extra/two.txt")), "path")
    wf.task("gzip-extra", extra, squeeze)
    return wf.merged().select("task", "item_id", "path")


@query(
    "flux_map",
    "SELECT doc_id AS item_id, upper(lang) || '-' || source AS label, n_chars // 100 AS hundreds FROM documents",
)
def flux_map(spark, sf):
    reshape = lambda df: df.select(
        F.col("doc_id").alias("item_id"),
        F.concat(F.upper("lang"), F.lit("-"), "source").alias("label"),
        F.expr("n_chars div 100").alias("hundreds"),
    )
    return m.table(spark, sf, "documents").transform(reshape)


@query(
    "flux_flatmap",
    """SELECT doc_id AS item_id, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line FROM (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
    SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
)
def flux_flatmap(spark, sf):
    lines = flat_items(m.table(spark, sf, "documents"), F.split("text", "\n"), "line", "line_no")
    return lines.select(F.col("doc_id").alias("item_id"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(
    "content_stages",
    f"""WITH {m.DOCUMENTS_SQL}, s AS (
  SELECT item_id, split_part(split_part(path, '/', -1), '.', 1) AS stem, base64(encode(text)) AS b64 FROM docs)
SELECT item_id, stem, 'base64/' || stem || '.b64' AS b64_path, 'gzip/' || stem || '.b64.gz' AS gz_path,
  'gzip/' || stem || '.b64.fake' AS extra_path, b64, CAST(length(b64) AS BIGINT) AS b64_length FROM s""",
)
def content(spark, sf):
    return content_stages(m.documents(m.table(spark, sf, "documents"))).select(
        "item_id", "stem", "b64_path", "gz_path", "extra_path", "b64", "b64_length"
    )


@query(
    "content_pipeline",
    f"""WITH {m.DOCUMENTS_SQL}, s AS (
  SELECT item_id, split_part(split_part(path, '/', -1), '.', 1) AS stem, base64(encode(text)) AS b64 FROM docs)
SELECT 'base64' AS task, item_id, 'base64/' || stem || '.b64' AS path, 'file' AS status, CAST(length(b64) AS BIGINT) AS length, b64 AS content FROM s
UNION ALL SELECT 'gzip', item_id, 'gzip/' || stem || '.b64.gz', 'file', CAST(length(b64) AS BIGINT), b64 FROM s
UNION ALL SELECT 'gzip', item_id, 'gzip/' || stem || '.b64.fake' || CASE WHEN item_id % 5 = 0 THEN '' ELSE '.none' END,
  CASE WHEN item_id % 5 = 0 THEN 'file' ELSE 'none' END, CASE WHEN item_id % 5 = 0 THEN 4 ELSE 0 END,
  CASE WHEN item_id % 5 = 0 THEN 'fake' END FROM s""",
)
def content_pipeline_query(spark, sf):
    root = new_path(spark, "content")
    docs = m.documents(m.table(spark, sf, "documents"))
    manifest = content_pipeline(docs, root, F.when(F.col("item_id") % 5 == 0, "fake"))
    made = spark.read.schema("item_id bigint, path string, content string").parquet(f"{root}/content")
    return manifest.join(made.select("path", "content"), "path", "left").select(
        "task", "item_id", "path", "status", "length", "content"
    )


@query(
    "chain_rerun",
    """WITH s AS (SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) t(step, task)), r AS (SELECT unnest([1, 2]) AS run_id),
p AS (SELECT run_id, step, task, doc_id FROM documents, s, r WHERE doc_id % 7 >= step OR doc_id % 7 = 0)
SELECT run_id, task, CASE WHEN run_id = 1 OR doc_id % 7 = step THEN 'run' ELSE 'skip' END AS action,
  CASE WHEN doc_id % 7 = step THEN 'lost' ELSE 'done' END AS outcome, count(*) AS n, 'FAILED' AS run_status FROM p GROUP BY ALL""",
)
def chain_rerun(spark, sf):
    # Three chained steps, each losing some items, run twice: what is there is skipped and flows on, what was
    # lost is tried again, and the store knows how the runs ended.
    store = Store(spark, new_path(spark, "chain"))
    docs = m.documents(m.table(spark, sf, "documents")).select("item_id", F.md5("text").alias("text"))
    out = lambda task: render(task + "/{i}.txt", i=F.col("item_id"))
    steps = [
        ChainStep(
            task,
            lambda df, task=task: df.select("item_id", out(task).alias("path"), F.lit(False).alias("optional")),
            lambda df, task=task, n=n: df.where(F.col("item_id") % 7 != n).select("item_id", out(task).alias("path"), F.upper("text").alias("content")),
            grouping=100,
        )
        for n, task in enumerate(("one", "two", "three"), 1)
    ]
    found = None
    for run_id in (1, 2):
        for task, result in run_chain(store, "chain", docs, steps, run_id).items():
            lost = result.lost.select("item_id", F.lit("lost").alias("outcome"))
            rows = result.planned.join(lost, "item_id", "left").groupBy(
                F.lit(run_id).alias("run_id"), F.lit(task).alias("task"), "action", F.coalesce("outcome", F.lit("done")).alias("outcome")
            ).agg(F.count(F.lit(1)).alias("n"))
            found = rows if found is None else found.unionByName(rows)
    status = with_workflow_status(store.workflow_runs()).select(F.col("run_id").cast("int"), F.col("status").alias("run_status"))
    return found.join(status, "run_id")


@query(
    "graph_run",
    """WITH s(task, lost) AS (VALUES ('source', 1), ('left', 2), ('right', 3), ('join', 4), ('aside', 5)), p AS (
  SELECT task, doc_id, doc_id % 7 = lost AS lost FROM documents, s
  WHERE task IN ('source', 'aside') OR (doc_id % 7 <> 1 AND (task <> 'join' OR doc_id % 7 NOT IN (2, 3))))
SELECT task, CASE WHEN lost THEN 'lost' ELSE 'done' END AS outcome, count(*) AS n, 'FAILED' AS run_status FROM p GROUP BY ALL""",
)
def graph_run(spark, sf):
    # A diamond and a step aside, two at once: an item reaches the last step if both branches let it through.
    store = Store(spark, new_path(spark, "graph"))
    docs = m.documents(m.table(spark, sf, "documents")).select("item_id", F.md5("text").alias("text"))

    def step(task, lost, after=()):
        out = render(task + "/{i}.txt", i=F.col("item_id"))
        items = lambda flow: functools.reduce(lambda a, b: a.join(b.select("item_id"), "item_id", "left_semi"), flow.values()) if flow else docs
        declare = lambda df: df.select("item_id", out.alias("path"), F.lit(False).alias("optional"))
        run = lambda df: df.where(F.col("item_id") % 7 != lost).select("item_id", out.alias("path"), F.col("text").alias("content"))
        return GraphStep(task, items, declare, run, after, grouping=100)

    steps = [
        step("join", 4, ("left", "right")), step("left", 2, ("source",)), step("right", 3, ("source",)), step("source", 1), step("aside", 5),
    ]
    found = None
    for task, result in sorted(run_graph(store, "diamond", steps, 1, parallel=2).items()):
        lost = result.lost.select("item_id", F.lit("lost").alias("outcome"))
        rows = result.planned.join(lost, "item_id", "left").groupBy(F.lit(task).alias("task"), F.coalesce("outcome", F.lit("done")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
        found = rows if found is None else found.unionByName(rows)
    status = with_workflow_status(store.workflow_runs()).select(F.col("status").alias("run_status"))
    return found.withColumn("run_status", F.lit(status.first().run_status))


@query(
    "downstream_loss",
    """WITH RECURSIVE e AS (
  SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem WHERE l_linenumber = 1
  UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem WHERE l_linenumber = 2
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT 'c' || c_custkey, 's' || (c_custkey % 100) FROM customer WHERE c_nationkey = 0
), r AS (
  SELECT 's' || s_suppkey AS item, 0 AS depth FROM supplier WHERE s_suppkey % 5 = 1
  UNION SELECT b, depth + 1 FROM r JOIN e ON a = item WHERE depth < 24
)
SELECT item, min(depth)::int AS depth FROM r GROUP BY item""",
)
def downstream_loss(spark, sf):
    # Suppliers lead to parts, parts to orders, orders to customers, and some of those to suppliers again.
    lines, orders, customers = (m.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("producer"), F.concat(F.lit(b), y).alias("consumer"))
    edges = edge(lines.where("l_linenumber = 1"), "s", "l_suppkey", "p", "l_partkey")
    edges = edges.unionAll(edge(lines.where("l_linenumber = 2"), "p", "l_partkey", "o", "l_orderkey"))
    edges = edges.unionAll(edge(orders.where("o_orderstatus = 'F'"), "o", "o_orderkey", "c", "o_custkey"))
    edges = edges.unionAll(edge(customers.where("c_nationkey = 0"), "c", "c_custkey", "s", F.col("c_custkey") % 100))
    seeds = m.table(spark, sf, "supplier").where("s_suppkey % 5 = 1").select(F.concat(F.lit("s"), "s_suppkey").alias("item"))
    return downstream(edges, seeds)


@query(
    "flux_merge",
    """SELECT 'events' AS task, json_object('event_id', event_id, 'event_type', event_type)::VARCHAR AS output FROM events
UNION ALL SELECT 'orders', json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus)::VARCHAR FROM orders""",
)
def flux_merge(spark, sf):
    return merge_as_json(
        {
            "events": m.table(spark, sf, "events").select("event_id", "event_type"),
            "orders": m.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"),
        }
    )


@query(
    "flux_zip",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events)
SELECT a.pos, a.event_id AS click_id, b.event_id AS view_id
FROM p a JOIN p b ON a.pos = b.pos WHERE a.event_type = 'click' AND b.event_type = 'view'""",
)
def flux_zip(spark, sf):
    events = m.table(spark, sf, "events")
    side = lambda kind: events.where(F.col("event_type") == kind).select(
        F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_ts")
    )
    pairs = zip_streams(side("click"), side("view"), ["click_ts", "click_id"], ["view_ts", "view_id"])
    return pairs.select("pos", "click_id", "view_id")


@query(
    "lookup_strict",
    """SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) GROUP BY 1""",
)
def lookup_strict_query(spark, sf):
    lines = m.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    orders = m.table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("orderkey"))
    return lookup_strict(lines, orders, "orderkey", report=True)


@query(
    "skip_existing",
    f"""WITH {m.DECLARED_SQL}, {m.MANIFEST_SQL}, done AS (
  SELECT item_id, bool_and(path IN (SELECT path FROM manifest)
    OR (optional AND path || '.none' IN (SELECT path FROM manifest))) AS done FROM declared GROUP BY item_id)
SELECT doc_id AS item_id, CASE WHEN done THEN 'skip' ELSE 'run' END AS action
FROM documents LEFT JOIN done ON doc_id = item_id""",
)
def skip_existing(spark, sf):
    docs = m.documents(m.table(spark, sf, "documents"))
    return inc.plan_skips(docs.select("item_id"), m.declared(docs), m.manifest(docs))


_LINEAGE_SQL = """WITH consumers AS (SELECT DISTINCT 'part/' || l_partkey AS consumer, 'orders/' || l_orderkey AS path FROM lineitem),
producers AS (SELECT o_orderkey AS producer, 'orders/' || o_orderkey AS path FROM orders WHERE o_orderkey % 7 <> 0)"""


def _producers(spark, sf):
    key = F.col("o_orderkey")
    return m.table(spark, sf, "orders").where(key % 7 != 0).select(
        key.alias("producer"), F.concat(F.lit("orders/"), key.cast("string")).alias("path")
    )


def _consumers(spark, sf):
    return m.table(spark, sf, "lineitem").select(
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("consumer"),
        F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string")).alias("path"),
    )


@query("lineage_edges", _LINEAGE_SQL + " SELECT producer, consumer, path FROM consumers JOIN producers USING (path)")
def lineage_edges(spark, sf):
    return inc.lineage(_producers(spark, sf), _consumers(spark, sf))


@query(
    "lineage_dangling",
    _LINEAGE_SQL + " SELECT consumer, path FROM consumers WHERE path NOT IN (SELECT path FROM producers)",
)
def lineage_dangling(spark, sf):
    return inc.dangling(_consumers(spark, sf), _producers(spark, sf))


@query(
    "stage_inputs",
    """SELECT DISTINCT l_orderkey AS "group", 'part/' || l_partkey AS file, CAST(l_partkey AS VARCHAR) AS name,
  CASE WHEN l_suppkey % 2 = 0 THEN '/data' ELSE '/inputs' END || '/part/' || l_partkey AS mount_path
FROM lineitem WHERE l_partkey % 4 <> 0""",
)
def stage_inputs(spark, sf):
    part = F.col("l_partkey")
    files = m.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("group"),
        F.when(part % 4 == 0, "local").otherwise("http").alias("kind"),
        F.concat(F.lit("part/"), part.cast("string")).alias("path"),
        F.when(F.col("l_suppkey") % 2 == 0, "/data").otherwise("/inputs").alias("inputs_dir"),
    )
    return inc.staging_plan(files)
