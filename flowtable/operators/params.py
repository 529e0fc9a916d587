"""Typed parameters from JSON: kebab-case names, defaults, required fields, variants."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.functions.common import col

_CORRUPT = "__malformed"


def kebab_name(name: str) -> str:
    """`someVal` and `some_val` -> `some-val`."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).replace("_", "-").lower()


def _kebab_type(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(kebab_name(f.name), _kebab_type(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_kebab_type(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _kebab_type(dtype.valueType))
    return dtype


def _nullable(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_nullable(dtype.elementType))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _nullable(dtype.valueType))
    return dtype


def read_params(json, schema: T.StructType) -> Column:
    """The JSON read by kebab-case names, with the text of a malformed document beside the fields."""
    wire = _kebab_type(schema)
    read = T.StructType([*wire.fields, T.StructField(_CORRUPT, T.StringType())])
    return F.from_json(col(json), read, {"columnNameOfCorruptRecord": _CORRUPT, "mode": "PERMISSIVE"})


def parsed_params(parsed: Column, schema: T.StructType) -> tuple[Column, Column]:
    """(value under `schema`'s own names, whether the document is malformed) of what `read_params` gave."""
    bad = parsed.isNull() | parsed[_CORRUPT].isNotNull()
    wire = _kebab_type(schema)
    return F.struct(*[parsed[f.name].alias(f.name) for f in wire.fields]).cast(_nullable(schema)), bad


def parse_params(json, schema: T.StructType) -> Column:
    """struct(value, malformed): the JSON read by kebab-case names into `schema`'s own names."""
    value, bad = parsed_params(read_params(json, schema), schema)
    return F.struct(value.alias("value"), bad.alias("malformed"))


def _fold(value: Column, allowed: Sequence[str]) -> Column:
    """The allowed spelling of a value, whatever its case; null if there is none."""
    found = F.lit(None).cast("string")
    for spelling in allowed:
        found = F.when(F.lower(value) == spelling.lower(), spelling).otherwise(found)
    return found


def _fill(value: Column, dtype: T.StructType, defaults: Mapping[str, Any], enums: Mapping[str, Sequence[str]], prefix: str = "") -> Column:
    """Put defaults into absent fields and allowed spellings into enums, inside nested structs that are
    present too."""
    fields = []
    for f in dtype.fields:
        path, field = prefix + f.name, value[f.name]
        if isinstance(f.dataType, T.StructType) and any(d.startswith(path + ".") for d in (*defaults, *enums)):
            field = F.when(field.isNotNull(), _fill(field, f.dataType, defaults, enums, path + "."))
        if path in enums:
            field = _fold(field, enums[path])
        if path in defaults:
            field = F.coalesce(field, F.lit(defaults[path]).cast(f.dataType))
        fields.append(field.alias(f.name))
    return F.struct(*fields)


def _missing(value: Column, required: Sequence[str]) -> list[Column]:
    """A text per required field that is absent although the struct around it is there."""
    checks = []
    for path in required:
        *outer, name = path.split(".")
        holder = value
        for part in outer:
            holder = holder[part]
        checks.append(F.when(holder.isNotNull() & holder[name].isNull(), f"{path} is missing"))
    return checks


def _strangers(value: Column, enums: Mapping[str, Sequence[str]]) -> list[Column]:
    """A text per enum field whose value is not allowed in any case."""
    checks = []
    for path, allowed in enums.items():
        field = value
        for part in path.split("."):
            field = field[part]
        checks.append(F.when(field.isNotNull() & _fold(field, allowed).isNull(), f"{path} is none of {', '.join(allowed)}"))
    return checks


def bound_params(
    df: DataFrame,
    json: str,
    schema: T.StructType,
    defaults: Mapping[str, Any] | None = None,
    required: Sequence[str] = (),
    override: str | None = None,
    out: str = "params",
    enums: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Bind a JSON column to `schema`: add the struct `out` and an array of `violations`.

    Dotted names reach nested fields. `enums` lists the allowed values of text fields, which match in any
    case and come out as listed. Where the `override` column (a struct of the same schema) is not null it is
    taken as a whole instead of the JSON.
    """
    schema, enums = _nullable(schema), enums or {}
    # Through a one-element array, so that the document is read once and not once per use.
    parsed = df.withColumn("__p", F.explode(F.array(read_params(json, schema))))
    raw, malformed = parsed_params(F.col("__p"), schema)
    value = _fill(raw, schema, defaults or {}, enums)
    missing = F.array_compact(F.array(F.lit(None).cast("string"), *_missing(F.col(out), required), *_strangers(raw, enums)))
    checks = F.when(malformed, F.array(F.lit("malformed"))).otherwise(missing)
    if override is not None:
        value = F.coalesce(col(override), value)
        checks = F.when(col(override).isNotNull(), F.array().cast("array<string>")).otherwise(checks)
    return parsed.withColumn(out, value).withColumn("violations", checks).drop("__p")


def bind_params(
    df: DataFrame,
    json: str,
    schema: T.StructType,
    defaults: Mapping[str, Any] | None = None,
    required: Sequence[str] = (),
    override: str | None = None,
    out: str = "params",
    enums: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`bound_params` as (rows that bind, rows with `violations`).

    Each side parses the JSON again; to use both, split the result of `bound_params` after
    writing it, or keep it whole.
    """
    bound = bound_params(df, json, schema, defaults, required, override, out, enums)
    good = F.size("violations") == 0
    return bound.where(good).drop("violations"), bound.where(~good).drop(out)


def bind_variant(df: DataFrame, json: str, shapes: Mapping[str, T.StructType], out: str = "params") -> DataFrame:
    """Bind each row to the shape its `-type` property names.

    `out` holds `type` and one struct per shape, null but for the named one; `violation`
    tells an unknown or missing type, or a document that does not fit.
    """
    kind = F.get_json_object(col(json), "$['-type']")
    tagged = df.withColumn("__kind", kind).withColumns(
        {f"__{name}": F.when(F.col("__kind") == name, parse_params(json, shape)) for name, shape in shapes.items()}
    )
    bad = F.lit(False)
    for name in shapes:
        bad = bad | F.coalesce(F.col(f"__{name}.malformed"), F.lit(False))
    violation = (
        F.when(F.col("__kind").isNull(), "no type")
        .when(~F.col("__kind").isin(list(shapes)), "unknown type")
        .when(bad, "malformed")
    )
    bound = F.struct(
        F.col("__kind").alias("type"), *[F.col(f"__{name}.value").alias(name) for name in shapes]
    )
    return tagged.withColumns({out: bound, "violation": violation}).drop("__kind", *[f"__{n}" for n in shapes])
