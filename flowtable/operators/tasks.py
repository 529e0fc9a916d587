"""Per-item steps: building requests from items, validating them, reshaping, merging."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtable.functions.common import col, names
from flowtable.functions.paths import DEFAULT_INPUTS_DIR, DEFAULT_OUTPUTS_DIR


def task_map(
    df: DataFrame,
    name: str,
    *,
    image,
    outputs: Mapping[str, Column],
    command=None,
    inputs_dir=None,
    outputs_dir=None,
    image_override=None,
    resources: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One request per item: image, folders, command, and the named outputs.

    Keeps the item's own columns. `image_override` (a setting) wins over `image`; `resources`
    adds what else the step asks for (cpus, memory, disk, time, env).
    """
    chosen = col(image) if isinstance(image, Column) else F.lit(image)
    if image_override is not None:
        chosen = F.coalesce(col(image_override), chosen)
    added = {
        "task": F.lit(name),
        "image": chosen,
        "inputs_dir": F.lit(DEFAULT_INPUTS_DIR) if inputs_dir is None else col(inputs_dir),
        "outputs_dir": F.lit(DEFAULT_OUTPUTS_DIR) if outputs_dir is None else col(outputs_dir),
        "command": F.lit(None).cast("string") if command is None else col(command),
    }
    return df.withColumns({**added, **(resources or {}), **outputs})


def validate_requests(df: DataFrame, image="image", output="output", inputs_dir="inputs_dir",
                      outputs_dir="outputs_dir", image_override=None) -> DataFrame:
    """Resolve the image and list what is wrong with each request in `violations`."""
    chosen = col(image) if image_override is None else F.coalesce(col(image_override), col(image))
    checks = F.array(
        F.when(chosen.isNull(), "image is missing"),
        F.when(col(output).isNull(), "output is missing"),
        F.when(col(inputs_dir) == col(outputs_dir), "inputs and outputs share a folder"),
    )
    return df.withColumns({"image": chosen, "violations": F.array_compact(checks)})


def flat_items(df: DataFrame, array_col, item: str = "item", pos: str | None = None) -> DataFrame:
    """One row per array element; rows without elements vanish. `pos` adds the 0-based index."""
    if pos is None:
        return df.withColumn(item, F.explode(col(array_col)))
    return df.select("*", F.posexplode(col(array_col)).alias(pos, item))


def merge_outputs(outputs: Mapping[str, DataFrame]) -> DataFrame:
    """All step outputs as one table: `task`, and the columns of every step (null where absent)."""
    merged = None
    for name, df in outputs.items():
        tagged = df.withColumn("task", F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return merged


def merge_as_json(outputs: Mapping[str, DataFrame]) -> DataFrame:
    """The same for steps of unlike shape: `task` and the row as JSON in `output`."""
    return merge_outputs(
        {
            name: df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("output"))
            for name, df in outputs.items()
        }
    ).select("task", "output")


def lookup_strict(df: DataFrame, dim: DataFrame, on, report: bool = False) -> DataFrame:
    """Join every row to its `dim` row, failing the job on a missing key.

    With `report`, return instead the missing keys and how many rows ask for each.
    """
    keys = names(on)
    if report:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(dim, keys, "left_anti")
    joined = df.join(dim.withColumn("__found", F.lit(True)), keys, "left")
    message = F.concat(F.lit("no entry for "), F.to_json(F.struct(*keys)))
    # The check sits in a key column, so column pruning cannot drop it.
    first = keys[0]
    checked = F.when(F.col("__found"), F.col(first)).otherwise(
        F.raise_error(message).cast(df.schema[first].dataType)
    )
    return joined.withColumn(first, checked).drop("__found")


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    """Names used by more than one row."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def import_merge(base: DataFrame, imported: DataFrame, name: str) -> DataFrame:
    """Union by name in which an imported row replaces the base row of the same name."""
    return imported.unionByName(base.join(imported.select(name).distinct(), name, "left_anti"))
