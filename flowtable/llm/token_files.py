"""Token files: flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by id; each task sorts, encodes and streams its partition to files
of its own in the shared folder, and answers with one manifest row. The manifest is written through
Spark, so a task that ran twice leaves at most an unlisted file. Per shard:

* `.ids`: the ids one after another, little-endian, 16 bits where the vocabulary allows, else 32;
* `.offsets`: documents + 1 64-bit numbers, the place of each document's first id, then the end;
* `.docs`: 64-bit document ids (ids that are null come first; the manifest has their number).

The global place of a shard is the sum of the ids of the shards before it.
Null text: the end id alone. Empty table: no shard. Equal ids are ordered by their text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtable.llm.common import stored
from flowtable.llm.tokens import encoder
from flowtable.session import new_path

MANIFEST = "shard int, stem string, bits int, docs long, null_docs long, ids long"


def file_system(uri: str):
    """The file system and path of a folder of the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def numbers(uri: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it lies on a local or mounted path."""
    from pyarrow import fs

    store, path = file_system(uri)
    if isinstance(store, fs.LocalFileSystem):
        with store.open_input_stream(path) as file:
            empty = not file.read(1)
        return np.empty(0, kind) if empty else np.memmap(path, kind, "r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def write_token_files(docs: DataFrame, path: str, kind: str = "whole", end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode all of `docs` to files below `folder` (a new one in the shared folder); returns the manifest."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, kind)
        size = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        flat = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4"
        end, shard = np.array([end_id], flat).tobytes(), TaskContext.get().partitionId()
        stem, out, offsets, names, null_docs = f"{folder}/{shard:06d}-{uuid.uuid4().hex}", None, [np.zeros(1, "<i8")], [], 0
        store, base = file_system(stem)
        for batch in batches:
            if out is None:
                store.create_dir(base.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(f"{base}.ids")
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                ids = encode(some.column("text").to_pylist())
                out.write(b"".join(np.frombuffer(x, "<u4").astype(flat).tobytes() + end for x in ids))
                offsets.append(offsets[-1][-1] + np.cumsum([len(x) // 4 + 1 for x in ids], dtype="<i8"))
                doc_id = some.column("doc_id")
                null_docs += doc_id.null_count
                names.append(np.asarray(doc_id.fill_null(0)).astype("<i8"))
        if out is None:
            return
        out.close()
        for ending, arrays in (("offsets", offsets), ("docs", names)):
            with store.open_output_stream(f"{base}.{ending}") as file:
                for x in arrays:
                    file.write(x.tobytes())
        row = {"shard": [shard], "stem": [stem], "bits": [8 * np.dtype(flat).itemsize], "docs": [sum(map(len, names))], "null_docs": [null_docs], "ids": [int(offsets[-1][-1])]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int32()), ("stem", pa.string()), ("bits", pa.int32()), ("docs", pa.int64()), ("null_docs", pa.int64()), ("ids", pa.int64())]))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids = numbers(f"{shard['stem']}.ids", f"<u{shard['bits'] // 8}")
                offsets, names = numbers(f"{shard['stem']}.offsets", "<i8"), numbers(f"{shard['stem']}.docs", "<i8")
                for a in range(0, len(names), 10_000):
                    b = min(a + 10_000, len(names))
                    places = offsets[a : b + 1]
                    crcs = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(places, places[1:], strict=False)]
                    yield pa.record_batch(
                        [pa.array(np.asarray(names[a:b]), mask=np.arange(a, b) < shard["null_docs"]), pa.array(places[:-1] + shard["base"]), pa.array(np.diff(places)), pa.array(crcs, pa.int64())],
                        schema=out,
                    )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # one row per shard
    spread = based.repartition(max(1, spark.sparkContext.defaultParallelism), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
