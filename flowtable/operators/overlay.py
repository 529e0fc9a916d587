"""Layered settings: default < name < labels, merged leaf by leaf for every entity.

`entities`: a unique `name` and an array `labels`. `settings`: one row per leaf with
`key` (the layer), dotted `path`, `value` and `layer_seq` (order of the layers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtable.functions.paths import kebab
from flowtable.operators.skew import ROWS_PER_SLICE, split_join
from flowtable.session import materialise

DEFAULT_KEY = "default"
_RANKS = {0: "default", 1: "name", 2: "label"}


def _entity_keys(entities: DataFrame) -> DataFrame:
    """(name, key, rank): the keys besides the default one that an entity answers to, each once.

    A key that is both the entity's name and one of its labels counts as the name.
    """
    own = kebab("name")
    labels = F.array_distinct(F.transform(F.coalesce("labels", F.array().cast("array<string>")), kebab))
    others = F.filter(labels, lambda k: (k != own) & (k != DEFAULT_KEY))
    key = lambda k, rank: F.struct(k.alias("key"), F.lit(rank).alias("rank"))
    none = F.array().cast("array<struct<key:string,rank:int>>")
    keys = F.concat(F.when(own != DEFAULT_KEY, F.array(key(own, 1))).otherwise(none), F.transform(others, lambda k: key(k, 2)))
    return entities.select("name", F.inline(keys))


def _layers(settings: DataFrame) -> DataFrame:
    """One row per settings key: its place in the order, and the digest of its distinct leaves."""
    leaves = F.sort_array(F.collect_set(F.struct("path", "value")))  # of one layer
    return settings.groupBy("key").agg(
        F.min("layer_seq").alias("seq"), F.sha2(F.to_json(leaves, {"ignoreNullFields": "false"}), 256).alias("content")
    )


def match_layers(entities: DataFrame, settings: DataFrame, rows: int = ROWS_PER_SLICE) -> DataFrame:
    """(name, key, layer, seq): the settings layers that apply to each entity.

    A key that more than `rows` entities answer to is joined in slices.

    A key that matches an entity's name counts as its name layer even if a label matches
    too. Label layers with the same content collapse into the first of them.
    """
    layers = _layers(settings)
    # Every entity has the default key: its layer is one row, so it travels to the entities.
    default = F.broadcast(layers.where(F.col("key") == DEFAULT_KEY))
    # (Exploded, for Catalyst would turn a join on a plain constant into a nested loop.)
    own_default = F.explode(F.array(F.lit(DEFAULT_KEY))).alias("key")
    shared = entities.select("name", own_default, F.lit(0).alias("rank")).join(default, "key")
    rest = split_join(_entity_keys(entities), layers.where(F.col("key") != DEFAULT_KEY), "key", rows)
    layer = F.when(F.col("rank") == 0, _RANKS[0]).when(F.col("rank") == 1, _RANKS[1]).otherwise(_RANKS[2])
    matched = shared.unionByName(rest).withColumn("layer", layer)
    return (
        # Label layers of equal content share a group; the others stand alone by their key.
        matched.groupBy("name", "layer", "content", F.when(F.col("rank") < 2, F.col("key")).alias("__alone"))
        .agg(F.min(F.struct("seq", "key")).alias("__first"))
        .select("name", F.col("__first.key").alias("key"), "layer", F.col("__first.seq").alias("seq"))
    )


def unmatched_settings(entities: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings keys that apply to no entity (an error in the settings)."""
    used = _entity_keys(entities).select("key").distinct()
    # The default key needs some entity to apply to; one row tells.
    default = entities.limit(1).select(F.lit(DEFAULT_KEY).alias("key"))
    return settings.select("key").distinct().join(used.unionByName(default), "key", "left_anti")


def overlay(entities: DataFrame, settings: DataFrame) -> DataFrame:
    """(name, path, value): the effective leaves of every entity.

    Later layers win leaf by leaf; a scalar replaces a whole subtree and a subtree replaces
    a scalar. Entities with the same layers share one result, so the merge runs once per
    distinct combination of layers rather than once per entity.
    """
    rank = F.when(F.col("layer") == "default", 0).when(F.col("layer") == "name", 1).otherwise(2)
    # Used twice below: written once, so that the matching does not run again.
    chosen = materialise(
        match_layers(entities, settings)
        .groupBy("name")  # at most the entity's labels plus two
        .agg(F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "seq", "key"))).alias("__l"))
        .select("name", F.transform("__l", lambda x: x["key"]).alias("stack")),
        "stacks",
    )
    stacks = chosen.select("stack").distinct()
    effective = _merge(stacks, settings)
    return chosen.join(effective, "stack").select("name", "path", "value")


def _merge(stacks: DataFrame, settings: DataFrame) -> DataFrame:
    """Effective (stack, path, value) of each stack of keys, lowest layer first."""
    leaves = (
        stacks.select("stack", F.posexplode("stack").alias("prio", "key"))
        .join(settings.select("key", "path", "value"), "key")
        .drop("key")
    )
    # Every node above or at a leaf: the highest layer with a leaf at it, and at or below it.
    parts = F.split("path", r"\.")
    node = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    own = F.col("node") == F.col("path")
    nodes = materialise(
        leaves.withColumn("node", F.explode(node))
        .groupBy("stack", "node")
        .agg(
            F.max(F.when(own, F.col("prio"))).alias("at"),
            F.max("prio").alias("below"),
            F.max_by(F.when(own, F.col("value")), F.when(own, F.col("prio"))).alias("value"),
        ),
        "nodes",
    )
    top = nodes.where(F.col("at") >= F.col("below")).select("stack", F.col("node").alias("path"), "value", "at")
    # A leaf is hidden by a scalar of a higher layer at one of the nodes above it.
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), ".")
    )
    covers = nodes.where(F.col("at").isNotNull()).select("stack", "node", F.col("at").alias("over"))
    hidden = (
        top.where(F.size(parts) > 1)
        .select("stack", "path", "at", F.explode(above).alias("node"))
        .join(covers, ["stack", "node"])
        .where(F.col("over") > F.col("at"))
        .select("stack", "path")
        .distinct()
    )
    return top.join(hidden, ["stack", "path"], "left_anti").select("stack", "path", "value")
