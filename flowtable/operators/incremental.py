"""What exists, what must run, how a run ended, and which files link which items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import names
from flowtable.functions.nested import explode_refs
from flowtable.session import materialise
from flowtable.functions.paths import NONE_SUFFIX, ancestor_dirs, file_name, mount_path, relative_to
from flowtable.operators.skew import ROWS_PER_SLICE, split_join


def declared_outputs(requests: DataFrame, output: str, *keys: str) -> DataFrame:
    """(keys, path, optional) of every output file anywhere inside the `output` column."""
    return explode_refs(requests, output, *keys).where(F.col("class") == "output").select(*keys, "path", "optional")


def known_paths(manifest: DataFrame) -> DataFrame:
    """One row per path: `is_file` if it exists, `is_none` if its `.none` marker does."""
    marker = f".{NONE_SUFFIX}"
    p = F.col("path")
    base = p.substr(F.lit(1), F.length(p) - len(marker))
    seen = F.struct(p.alias("path"), F.lit(True).alias("f"), F.lit(False).alias("n"))
    marked = F.struct(base.alias("path"), F.lit(False).alias("f"), F.lit(True).alias("n"))
    facts = manifest.select(F.explode(F.when(p.endswith(marker), F.array(seen, marked)).otherwise(F.array(seen))))
    return facts.groupBy(F.col("col.path").alias("path")).agg(
        F.bool_or("col.f").alias("is_file"), F.bool_or("col.n").alias("is_none")
    )


def output_presence(outputs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add `present` to rows of (path, optional): the file is there, or is optional and marked absent."""
    present = F.coalesce(F.col("is_file") | (F.col("optional") & F.col("is_none")), F.lit(False))
    return outputs.join(known_paths(manifest), "path", "left").withColumn("present", present).drop("is_file", "is_none")


def plan_skips(items: DataFrame, outputs: DataFrame, manifest: DataFrame, item="item_id", force: bool = False) -> DataFrame:
    """`action` per item: `skip` when it declares outputs and all are present, else `run`.

    `items` has one row per item, `outputs` one row per (item, path, optional).
    """
    keys = names(item)
    if force:
        return items.withColumn("action", F.lit("run"))
    # Nothing to probe for an item without outputs, so the inner side only holds the rest.
    done = output_presence(outputs, manifest).groupBy(*keys).agg(F.bool_and("present").alias("__done"))
    return (
        items.join(done, keys, "left")
        .withColumn("action", F.when(F.col("__done"), "skip").otherwise("run"))
        .drop("__done")
    )


def existing(df: DataFrame, manifest: DataFrame, path_col: str = "path", negate: bool = False) -> DataFrame:
    """Rows whose path exists (or does not, with `negate`)."""
    files = manifest.select(F.col("path").alias("__path")).distinct()
    return df.join(files, df[path_col] == files["__path"], "left_anti" if negate else "left_semi")


def directory_files(
    dirs: DataFrame, manifest: DataFrame, dir_col: str = "dir", rows: int = ROWS_PER_SLICE
) -> DataFrame:
    """(dir, path) for every manifest file below one of the directories, at any depth.

    A directory with more than `rows` files below it is joined in slices.
    """
    wanted = dirs.select(F.rtrim(F.col(dir_col), F.lit("/")).alias("dir")).distinct()
    # Distinct before the join: afterwards all files of a folder would share one task.
    files = manifest.select("path").distinct()
    below = files.select("path", F.explode(ancestor_dirs("path")).alias("dir"))
    return split_join(below, wanted, "dir", rows).select("dir", "path")


def unused_files(listing: DataFrame, referenced: DataFrame) -> DataFrame:
    """Files nothing refers to. Only found here; deleting them is the caller's decision."""
    return listing.select("path").distinct().join(
        referenced.select("path").distinct(), "path", "left_anti"
    )


def to_manifest(listing: DataFrame, root: str) -> DataFrame:
    """Distinct paths below `root`, relative to it; folders (trailing `/`) are left out."""
    return (
        listing.select(relative_to("path", root).alias("path"))
        .where(F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").endswith("/"))
        .distinct()
    )


def run_outcome(batches: DataFrame, outputs: DataFrame, manifest: DataFrame, errors: DataFrame, batch="batch") -> DataFrame:
    """Status per batch: `failed` if it raised, `completed` if all outputs of all items are present,
    else `partially completed`. A batch without outputs has nothing missing."""
    keys = names(batch)
    whole = output_presence(outputs, manifest).groupBy(*keys).agg(F.bool_and("present").alias("__whole"))
    raised = errors.select(*keys, F.lit(True).alias("__raised")).distinct()
    status = (
        F.when(F.col("__raised"), "failed")
        .when(F.coalesce("__whole", F.lit(True)), "completed")
        .otherwise("partially completed")
    )
    return (
        batches.select(*keys)
        .distinct()
        .join(raised, keys, "left")
        .join(whole, keys, "left")
        .select(*keys, status.alias("status"))
    )


def item_outcome(outputs: DataFrame, manifest: DataFrame, keys) -> DataFrame:
    """`ok` per item: every declared output is present."""
    return output_presence(outputs, manifest).groupBy(*names(keys)).agg(F.bool_and("present").alias("ok"))


def lineage(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(producer, consumer, path) for every file one item wrote and another one reads."""
    wrote = producers.select("producer", "path").distinct()
    read = consumers.select("consumer", "path").distinct()
    return read.join(wrote, "path").select("producer", "consumer", "path")


def downstream(edges: DataFrame, lost: DataFrame) -> DataFrame:
    """(item, depth): every item that is lost, or that a lost one leads to over any path of `edges`; `depth` is the
    length of the shortest one, 0 for the items of `lost` (item). `edges`: producer, consumer.

    One join per depth, of the items that the last one reached first; cycles and diamonds are met once. Each depth
    is written, so lineage stays short and a lost executor repeats one depth.
    """
    steps = materialise(edges.where("producer is not null and consumer is not null").select("producer", "consumer").distinct(), "edges")
    reached = seen = materialise(lost.where("item is not null").select("item", F.lit(0).alias("depth")).distinct(), "downstream")
    depth = 1
    while True:
        onward = steps.join(reached.select(F.col("item").alias("producer")), "producer").select(F.col("consumer").alias("item")).distinct()
        reached = materialise(onward.join(seen, "item", "left_anti").select("item", F.lit(depth).alias("depth")), "downstream")
        if reached.isEmpty():
            return seen
        seen, depth = seen.unionAll(reached), depth + 1


def dangling(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """Distinct (consumer, path) whose file nobody produced."""
    known = producers.select("path").distinct()
    wanted = consumers.select("consumer", "path").distinct()
    return wanted.join(known, "path", "left_anti").select("consumer", "path")


def staging_plan(files: DataFrame, group="group") -> DataFrame:
    """The distinct files to fetch per group, with where they are mounted; local files need no fetch.

    `files` has one row per (group, item's file): kind, path and inputs_dir.
    """
    keys = names(group)
    return (
        files.where(F.col("kind") != "local")
        .select(
            *keys,
            F.col("path").alias("file"),
            file_name("path").alias("name"),
            mount_path("kind", "path", inputs_dir="inputs_dir").alias("mount_path"),
        )
        .distinct()
    )
