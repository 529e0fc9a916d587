"""Skip-existing on arriving items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtable.functions.common import names
from flowtable.functions.paths import none_marker
from flowtable.operators.incremental import plan_skips
from flowtable.streaming.epochs import START, each_batch, read_epoch, write_epoch
from flowtable.streaming.levels import Levels

STORE_SCHEMA = "path string, content string"


def manifest_table(spark: SparkSession, root: str) -> Levels:
    return Levels(spark, f"{root}/manifest", "path string", "path")


def stream_incremental(
    sdf: DataFrame,
    root: str,
    declare: Callable[[DataFrame], DataFrame],
    run: Callable[[DataFrame], DataFrame],
    manifest: DataFrame | None = None,
    item="item_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run each arriving item whose outputs are not all there yet, and store what it produced.

    `declare` maps items to (item, path, optional), `run` maps the items to run to
    (path, content). `manifest` (path) is what exists beforehand. Produced files are stored
    per micro-batch below `root`/store; their paths join the manifest, of which a micro-batch opens
    only the buckets that may hold a path it asks for.
    """
    spark, keys, store = sdf.sparkSession, names(item), f"{root}/store"
    before = manifest_table(spark, root)
    if not before.runs():
        known = spark.createDataFrame([], "path string") if manifest is None else manifest.select("path").distinct()
        before.append(known, START)

    def handle(batch: DataFrame, epoch: int) -> None:
        table = manifest_table(batch.sparkSession, root)
        items = batch.dropDuplicates(keys)
        outputs = declare(items)
        asked = outputs.select(F.explode(F.array("path", none_marker("path"))).alias("path"))
        plan = plan_skips(items.select(*keys), outputs, table.lookup(asked, epoch).select("path"), keys)
        produced = run(items.join(plan.where(F.col("action") == "run").select(*keys), keys, "left_semi"))
        write_epoch(produced.select("path", "content"), store, epoch)
        made = read_epoch(batch.sparkSession, store, STORE_SCHEMA, epoch).select("path").distinct()
        table.append(made.join(table.lookup(made, epoch), "path", "left_anti"), epoch)

    return each_batch(sdf, handle, f"{root}/checkpoint", trigger=trigger)
