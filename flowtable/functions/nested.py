"""File references inside nested values, found by walking the schema.

A file reference is any struct with string fields `kind` and `path` (and optionally a
boolean `optional`). `kind` is `output`, `directory`, or one of the input kinds
(`local`, `gs`, `http`, `sra`). The walk happens once, on the schema; what runs on the
rows is a plain Catalyst expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtable.functions.common import col

REF_TYPE = "array<struct<kind:string,path:string,optional:boolean>>"


def _is_ref(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and {"kind", "path"} <= set(dtype.fieldNames())


def _holds_refs(dtype: T.DataType) -> bool:
    if _is_ref(dtype):
        return True
    if isinstance(dtype, T.StructType):
        return any(_holds_refs(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _holds_refs(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _holds_refs(dtype.valueType)
    return False


def _empty() -> Column:
    return F.array().cast(REF_TYPE)


def _as_ref(value: Column, dtype: T.StructType) -> Column:
    optional = value["optional"] if "optional" in dtype.fieldNames() else F.lit(False)
    return F.struct(
        value["kind"].alias("kind"),
        value["path"].alias("path"),
        F.coalesce(optional, F.lit(False)).alias("optional"),
    )


def _refs(value: Column, dtype: T.DataType) -> Column:
    """All references in a value as one array (null entries included); empty for null."""
    if _is_ref(dtype):
        return F.when(value.isNull(), _empty()).otherwise(F.array(_as_ref(value, dtype)).cast(REF_TYPE))
    if isinstance(dtype, T.StructType):
        return F.concat(*[_refs(value[f.name], f.dataType) for f in dtype.fields if _holds_refs(f.dataType)])
    if isinstance(dtype, T.MapType):
        return _refs_in_array(F.map_values(value), dtype.valueType)
    return _refs_in_array(value, dtype.elementType)


def _refs_in_array(values: Column, dtype: T.DataType) -> Column:
    """The same for an array, a field of all its structs at a time: that needs no lambda."""
    if _is_ref(dtype):
        if dtype.fieldNames() == ["kind", "path", "optional"]:
            return F.coalesce(values.cast(REF_TYPE), _empty())
        return F.coalesce(F.transform(values, lambda v: _as_ref(v, dtype)), _empty())
    if isinstance(dtype, T.StructType):
        return F.concat(*[_refs_in_array(values[f.name], f.dataType) for f in dtype.fields if _holds_refs(f.dataType)])
    if isinstance(dtype, T.MapType):
        return _refs_in_array(F.transform(values, F.map_values), T.ArrayType(dtype.valueType))
    return _refs_in_array(F.flatten(F.array_compact(values)), dtype.elementType)


def _dtype_of(schema: T.StructType, name: str) -> T.DataType:
    dtype: T.DataType = schema
    for part in name.split("."):
        dtype = dtype[part].dataType
    return dtype


def collect_refs(df: DataFrame, column: str, kind: str) -> Column:
    """Distinct references of `kind` (`output`, `directory` or `input`) anywhere in a column.

    Struct fields, array elements and map values are searched, map keys are not.
    """
    dtype = _dtype_of(df.schema, column)
    if not _holds_refs(dtype):
        return _empty()
    return F.array_distinct(F.filter(_refs(F.col(column), dtype), lambda r: ref_class(r["kind"]) == kind))


def ref_class(kind: Column) -> Column:
    """`output`, `directory`, or `input` for every input kind; null stays null."""
    return F.when(kind.isin("output", "directory"), kind).when(kind.isNotNull(), "input")


def explode_refs(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per distinct reference in a column: `keep` columns, class, kind, path, optional."""
    dtype = _dtype_of(df.schema, column)
    refs = _refs(F.col(column), dtype) if _holds_refs(dtype) else _empty()
    return (
        df.select(*keep, F.inline(F.array_distinct(refs)))
        .where(F.col("path").isNotNull())
        .select(*keep, ref_class(F.col("kind")).alias("class"), "kind", "path", "optional")
    )


def input_files(df: DataFrame, input_col: str, params_col: str) -> Column:
    """An item's input files: those of its input and those of its parameters."""
    return F.array_union(collect_refs(df, input_col, "input"), collect_refs(df, params_col, "input"))


def file_ref(kind: str, path, optional: bool = False) -> Column:
    """A file reference struct, for building inputs and outputs."""
    return F.struct(F.lit(kind).alias("kind"), col(path).alias("path"), F.lit(optional).alias("optional"))
