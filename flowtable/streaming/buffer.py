"""Count-N buffers per key over a stream; the remainder is flushed when a key falls silent, or at the end of input.

The pending items of a key (fewer than N) are kept in a keyed table of which a micro-batch opens only what its own
keys need, and a batch is cut into buffers by the same distributed positions as a bounded table, so a key that
holds most of the stream is not pulled through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtable.functions.common import names
from flowtable.operators.batches import batch as number_batches
from flowtable.streaming.epochs import START, each_batch, last_epoch, read_all, read_epoch, start_table, write_epoch
from flowtable.streaming.levels import Levels


def _schemas(sdf: DataFrame, by: str, order: list[str], value: str) -> tuple[str, str]:
    kind = lambda c: sdf.schema[c].dataType.simpleString()
    entry = ",".join(["arrived:bigint", *[f"{c}:{kind(c)}" for c in order], f"value:{kind(value)}"])
    lists = f"{by} {kind(by)}, buffer_id bigint, entries array<struct<{entry}>>"
    state = f"{by} {kind(by)}, done bigint, pending array<struct<{entry}>>"
    return lists, state


def _state(spark: SparkSession, root: str, schema: str, by: str) -> Levels:
    return Levels(spark, f"{root}/state", schema, by, latest=True)


def stream_buffer(
    sdf: DataFrame, by: str, order, value: str, n: int, root: str, trigger: dict | None = None, silent: int | None = None
) -> StreamingQuery:
    """Cut each key's items, in order of arrival, into buffers of `n`.

    Items of one micro-batch are taken in the order of the unique columns `order`. With `silent`, the short buffer of a
    key that got no item in so many further micro-batches is passed on as it is, and a new one begins after it.
    A micro-batch works on its own keys, and on those of the one micro-batch that lies `silent` back. A null
    key is a key like any other. Read the result with `read_buffers`.
    """
    order = names(order)
    lists_schema, state_schema = _schemas(sdf, by, order, value)
    entry = F.struct("arrived", *order, "value")
    start_table(sdf.sparkSession.createDataFrame([], lists_schema), f"{root}/lists")

    def handle(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        table = _state(here, root, state_schema, by)
        keys = batch.select(by).distinct()
        if silent is not None and epoch >= silent:
            # Who was last heard of in that micro-batch, and not in this one.
            then = read_epoch(here, f"{root}/changes", state_schema, epoch - silent).where(F.size("pending") > 0).select(by)
            keys = keys.unionAll(then).distinct()
        previous = table.lookup(keys, epoch)
        fresh = batch.select(by, F.lit(epoch).cast("bigint").alias("arrived"), *order, F.col(value).alias("value"))
        now = keys_of(previous, batch, by)
        rows = now.select(by, F.inline("pending")).unionByName(fresh)
        cut = number_batches(rows, by, ["arrived", *order], n, "buffer_id").groupBy(by, "buffer_id").agg(
            F.sort_array(F.collect_list(entry)).alias("entries")
        )
        named = now.select(F.col(by).alias("__by"), "done")
        shifted = cut.join(named, F.col(by).eqNullSafe(F.col("__by")), "left").select(
            by, (F.col("buffer_id") + F.coalesce("done", F.lit(0))).alias("buffer_id"), "entries"
        )
        full = F.size("entries") == n
        still = previous.join(batch.select(F.col(by).alias("__by")).distinct(), F.col(by).eqNullSafe(F.col("__by")), "left_anti")
        still = still.where((F.col("epoch") == epoch - (silent or 0)) & (F.size("pending") > 0))
        flushed = still.select(by, F.col("done").alias("buffer_id"), F.col("pending").alias("entries"))
        write_epoch(shifted.withColumn("__full", full).unionByName(flushed.withColumn("__full", F.lit(True))), f"{root}/cut", START)
        made = read_epoch(here, f"{root}/cut", f"{lists_schema}, __full boolean", START)
        write_epoch(made.where("__full").drop("__full"), f"{root}/lists", epoch)
        state = made.groupBy(by).agg(
            F.max(F.col("buffer_id") + F.col("__full").cast("bigint")).alias("done"),
            F.max(F.when(~F.col("__full"), F.col("entries"))).alias("pending"),
        )
        none = F.array().cast(state.schema["pending"].dataType)
        write_epoch(state.withColumn("pending", F.coalesce("pending", none)), f"{root}/changes", epoch)
        table.append(read_epoch(here, f"{root}/changes", state_schema, epoch), epoch)

    return each_batch(sdf, handle, f"{root}/checkpoint", trigger=trigger)


def keys_of(rows: DataFrame, batch: DataFrame, by: str) -> DataFrame:
    """The rows whose key is one of the batch's."""
    mine = batch.select(F.col(by).alias("__by")).distinct()
    return rows.join(mine, F.col(by).eqNullSafe(F.col("__by")), "left_semi")


def read_buffers(spark: SparkSession, sdf: DataFrame, by: str, order, value: str, root: str, flush: bool = True) -> DataFrame:
    """(by, buffer_id, values) so far; with `flush` the short last buffers too (end of input)."""
    lists_schema, state_schema = _schemas(sdf, by, names(order), value)
    values = F.transform("entries", lambda e: e["value"]).alias("values")
    newest = last_epoch(spark, f"{root}/checkpoint")
    if newest == START:
        return spark.createDataFrame([], lists_schema).select(by, "buffer_id", values)
    full = read_all(spark, f"{root}/lists", lists_schema).where(F.col("epoch") <= newest).select(by, "buffer_id", values)
    if not flush:
        return full
    waiting = _state(spark, root, state_schema, by).read(newest + 1).where(F.size("pending") > 0)
    return full.unionByName(waiting.select(by, F.col("done").alias("buffer_id"), F.col("pending").alias("entries")).select(by, "buffer_id", values))
