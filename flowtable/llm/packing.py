"""Packing by concatenate and cut.

All documents are one long run of ids, cut every `length` ids. Pass one encodes each input partition
and stores ids with their place inside the partition; the partitions' totals (one row each) are
summed up to partition bases; pass two adds base and place and cuts at the window borders. No shuffle
of texts or ids: only the totals move.

Null text: only the end id. Empty table: no rows. Repeated rows are packed as often as they occur.
Only the named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtable.llm.common import stored
from flowtable.llm.near_dedup import portions
from flowtable.llm.tokens import encoder

SCHEMA = "part int, place long, doc_id long, doc_tokens long, ids binary"
FIELDS = pa.schema(
    [("part", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
)


def encoded(docs: DataFrame, path: str, kind: str, end_id: int) -> DataFrame:
    """Pass one: ids of each document with the end id, and the ids before it in its partition."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, encode = TaskContext.get().partitionId(), 0, encoder(path, kind)
        for some, text in portions(batches, "text"):  # bounded memory, however long the texts are
            ids = [x + end for x in encode(text)]
            sizes = np.array([len(x) // 4 for x in ids], "i8")
            before = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            yield pa.record_batch(
                [pa.array(np.full(len(ids), part, "i4")), pa.array(before), some.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(ids, pa.binary())],
                schema=FIELDS,
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, SCHEMA)


def pack(docs: DataFrame, path: str, kind: str = "byte", end_id: int = 0, length: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it), length, ids (binary),
    doc_tokens, sequence_id, offset, padded_to (`length`, or the ids of a shorter last sequence
    where their number is a power of two)."""
    rows = stored(encoded(docs, path, kind, end_id), "packing")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("doc_tokens").alias("ids_here"))
    bases = bases.select(  # one row per input partition: small whatever the texts hold
        "part",
        F.coalesce(F.sum("ids_here").over(before), F.lit(0)).alias("base"),
        F.sum("ids_here").over(Window.partitionBy()).alias("total"),
    )
    first = F.col("base") + F.col("place")
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id", "doc_tokens", "ids", "total", first.alias("first"),
        F.explode(F.sequence(F.expr(f"(base + place) div {length}"), F.expr(f"(base + place + doc_tokens - 1) div {length}"))).alias("sequence_id"),
    )
    opens = F.greatest("first", F.col("sequence_id") * length)
    ends = F.least(F.col("first") + F.col("doc_tokens"), (F.col("sequence_id") + 1) * length)
    filled = F.least(F.lit(length), F.col("total") - F.col("sequence_id") * length)
    return placed.select(
        "doc_id",
        (opens - F.col("first")).alias("start"),
        (ends - opens).alias("length"),
        F.expr(f"substring(ids, cast(4 * (greatest(first, sequence_id * {length}) - first) + 1 as int), cast(4 * (least(first + doc_tokens, (sequence_id + 1) * {length}) - greatest(first, sequence_id * {length})) as int))").alias("ids"),
        "doc_tokens",
        "sequence_id",
        (opens - F.col("sequence_id") * length).alias("offset"),
        F.when(F.bit_count(filled) == 1, filled).otherwise(F.lit(length)).cast("long").alias("padded_to"),
    )
