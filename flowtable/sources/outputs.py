"""The outputs store: produced content by task, and the manifest of what exists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import names
from flowtable.functions.paths import none_marker


def write_outputs(
    produced: DataFrame,
    declared: DataFrame,
    root: str,
    task: str,
    item="item_id",
    strict: bool = False,
    run: str | None = None,
    epoch: int = 0,
) -> DataFrame:
    """Keep the declared outputs of a task under `root` and return their manifest rows.

    `produced`: item, path, content; `declared`: item, path, optional. Content goes where its task makes
    it, to `root`/content, compressed and without a shuffle; the manifest, in `root`/files, is joined from
    keys and lengths alone. A missing optional file leaves its `.none` marker; a missing required one gets
    status `missing`, which raises if `strict`. A file that nobody declared is in no manifest. `run` names the
    folder of this call, `epoch` is kept in every row.
    """
    spark, keys, folder = produced.sparkSession, [*names(item), "path"], f"run={run or task}"
    content = produced.select(
        *keys, "content", F.octet_length("content").cast("bigint").alias("length"), F.lit(epoch).cast("bigint").alias("epoch")
    )
    content.write.option("compression", "gzip").parquet(f"{root}/content/{folder}")
    made = spark.read.schema(content.schema).parquet(f"{root}/content/{folder}").select(*keys, "length")
    there = F.col("length").isNotNull()
    manifest = declared.join(made, keys, "left").select(
        F.lit(task).alias("task"),
        *names(item),
        F.when(there | ~F.col("optional"), F.col("path")).otherwise(none_marker("path")).alias("path"),
        F.when(there, "file").when(F.col("optional"), "none").otherwise("missing").alias("status"),
        F.coalesce("length", F.lit(0).cast("bigint")).alias("length"),
        F.lit(epoch).cast("bigint").alias("epoch"),
    )
    manifest.write.parquet(f"{root}/files/{folder}")
    written = spark.read.schema(manifest.schema).parquet(f"{root}/files/{folder}")
    if strict and not written.where(F.col("status") == "missing").isEmpty():
        raise RuntimeError(f"required outputs of task {task} were not created")
    return written.drop("epoch")


def write_status(docs: DataFrame, path: str) -> None:
    """Write status documents as JSON lines, one line per document."""
    docs.select("doc").write.mode("errorifexists").text(path)
