"""Each output path once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtable.streaming.epochs import START, each_batch, last_epoch
from flowtable.streaming.levels import Levels

PATHS_SCHEMA = "path string"


def paths_table(spark: SparkSession, root: str) -> Levels:
    return Levels(spark, f"{root}/paths", PATHS_SCHEMA, "path")


def stream_dedup(sdf: DataFrame, root: str, manifest: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Pass on each `path` the first time it arrives, however late. Read with `read_paths`.

    What was seen is the manifest: the paths there beforehand, and those of earlier micro-batches. A micro-batch
    opens only the buckets of it that may hold one of its paths. Paths are made distinct on the map side
    first, so a path that makes up much of a batch is one row.
    """
    seen = paths_table(sdf.sparkSession, root)
    if manifest is not None and not seen.runs():
        seen.append(manifest.select("path").distinct(), START)

    def handle(batch: DataFrame, epoch: int) -> None:
        table = paths_table(batch.sparkSession, root)
        arrived = batch.select("path").distinct()
        table.append(arrived.join(table.lookup(arrived, epoch), "path", "left_anti"), epoch)

    return each_batch(sdf, handle, f"{root}/checkpoint", trigger=trigger, skip_empty=True)


def read_paths(spark: SparkSession, root: str) -> DataFrame:
    """The paths that the stream passed on."""
    rows = paths_table(spark, root).read(last_epoch(spark, f"{root}/checkpoint") + 1)
    return rows.where(F.col("epoch") > START).select("path")
