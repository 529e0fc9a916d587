"""Tables written one folder per micro-batch, so that a replayed batch overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowtable.session import new_path

START = -1  # the epoch that holds what was there before the stream began


def write_epoch(df: DataFrame, root: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")


def start_table(df: DataFrame, root: str) -> None:
    """Write what the table holds before the first batch; a restarted stream keeps the first."""
    df.write.mode("ignore").parquet(f"{root}/epoch={START}")


def read_before(spark: SparkSession, root: str, schema, epoch: int) -> DataFrame:
    """Rows of all epochs before `epoch`; a replay does not see its own earlier attempt."""
    return read_all(spark, root, schema).where(F.col("epoch") < epoch).drop("epoch")


def read_epoch(spark: SparkSession, root: str, schema, epoch: int) -> DataFrame:
    """Rows of one epoch, without listing the others."""
    return spark.read.schema(schema).parquet(f"{root}/epoch={epoch}")


def read_all(spark: SparkSession, root: str, schema) -> DataFrame:
    return spark.read.schema(_with_epoch(schema)).option("basePath", root).parquet(root)


def last_epoch(spark: SparkSession, checkpoint: str) -> int:
    """The last micro-batch that ended, from the query's commit log (of bounded length, unlike the data)."""
    try:
        log = spark.read.format("binaryFile").load(f"{checkpoint}/commits").select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return START
    newest = log.select(F.max(F.regexp_extract("path", r"/(\d+)$", 1).try_cast("bigint"))).first()[0]
    return START if newest is None else newest


def _with_epoch(schema):
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])


def each_batch(
    sdf: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
    skip_empty: bool = False,
) -> StreamingQuery:
    """Start a query that hands every micro-batch to `handle`, which may read it repeatedly.

    Micro-batches are numbered without gaps, so the state `handle` left last is that of the
    epoch before. `checkpoint` belongs in the shared folder. The default trigger drains what
    is there; bound a micro-batch at the source (`maxFilesPerTrigger`).
    """

    def guarded(batch: DataFrame, epoch: int) -> None:
        if not skip_empty or not batch.isEmpty():
            handle(batch, epoch)

    return _start(sdf, guarded, checkpoint, "append", trigger)


def _start(sdf, handle, checkpoint: str, output_mode: str, trigger: dict | None) -> StreamingQuery:
    return (
        sdf.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(handle)
        .start()
    )


def finish(query: StreamingQuery) -> None:
    """Wait for a draining query; its failure is raised here."""
    query.awaitTermination()


def drain(sdf: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is there into a parquet sink, and read the sink."""
    spark = sdf.sparkSession
    root = new_path(spark, label)
    query = (
        sdf.writeStream.format("parquet")
        .option("path", f"{root}/data")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    finish(query)
    return spark.read.schema(sdf.schema).parquet(f"{root}/data")
