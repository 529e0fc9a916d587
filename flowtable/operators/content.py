"""The sample workflow as one job: text -> base64 -> compressed, with an optional extra per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import col, render
from flowtable.functions.paths import file_name, stem
from flowtable.sources.outputs import write_outputs


def base64_text(text) -> Column:
    """Base64 of the UTF-8 bytes on one line (Spark itself breaks it every 76 characters)."""
    return F.replace(F.base64(F.encode(col(text), "utf-8")), F.lit("\r\n"), F.lit(""))


def content_stages(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Every stage's output per item, as columns: base64 file, compressed file, and the optional extra."""
    b64_path = render("base64/{stem}.b64", stem=stem(path))
    encoded = docs.withColumns({"stem": stem(path), "b64_path": b64_path, "b64": base64_text(text)})
    return encoded.withColumns(
        {
            "gz_path": render("gzip/{name}.gz", name=file_name("b64_path")),
            "extra_path": render("gzip/{name}.fake", name=file_name("b64_path")),
            "b64_length": F.length("b64").cast("bigint"),
        }
    )


def content_pipeline(docs: DataFrame, root: str, extra: Column | None = None, path: str = "path", text: str = "text") -> DataFrame:
    """Run the stages over `docs` (item_id, `path`, `text`) and store what they make below `root`.

    The first stage stores the base64 text; the second takes it from there and stores it compressed (by the
    sink's codec), with the optional extra where `extra` (a text per document) is not null and its `.none`
    marker where it is. Returns the manifest rows of both stages: task, item_id, path, status, length.
    """
    stages = content_stages(docs, path, text)
    output = lambda p, optional: F.struct(F.col(p).alias("path"), F.lit(optional).alias("optional"))
    listed = lambda *outs: stages.select("item_id", F.inline(F.array(*outs)))
    first = write_outputs(
        stages.select("item_id", F.col("b64_path").alias("path"), F.col("b64").alias("content")),
        listed(output("b64_path", False)), root, "base64",
    )
    stored = docs.sparkSession.read.parquet(f"{root}/content/run=base64").select("item_id", F.col("path").alias("b64_path"), "content")
    squeezed = stored.select("item_id", render("gzip/{name}.gz", name=file_name("b64_path")).alias("path"), "content")
    extras = stages.select("item_id", F.col("extra_path").alias("path"), (F.lit(None) if extra is None else extra).cast("string").alias("content"))
    second = write_outputs(
        squeezed.unionByName(extras.where(F.col("content").isNotNull())),
        listed(output("gz_path", False), output("extra_path", True)), root, "gzip",
    )
    return first.unionByName(second)
