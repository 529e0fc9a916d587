"""Column expressions over file paths and object URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtable.functions.common import col

# Default folders inside a container, and the marker suffix of an
# optional output that was not produced.
DEFAULT_INPUTS_DIR = "/inputs"
DEFAULT_OUTPUTS_DIR = "/outputs"
NONE_SUFFIX = "none"


def parent_dir(path) -> Column:
    """`a/b/c.txt` -> `a/b`; empty when there is no folder."""
    return F.regexp_extract(col(path), r"(?s)^(.*)/[^/]*$", 1)


def file_name(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path) -> Column:
    """File name up to its first dot: `x/file.txt.gz` -> `file`, `.bashrc` -> ``."""
    return F.substring_index(file_name(path), ".", 1)


def extension(path) -> Column:
    """Everything after the first dot of the file name, empty when there is none."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring(name, F.length(stem(path)) + 2, F.length(name))).otherwise("")


def ancestor_dirs(path) -> Column:
    """All folders above a path: `a/b/c.txt` -> [`a`, `a/b`]."""
    parts = F.split(col(path), "/")
    depth = F.size(parts) - 1
    return F.when(
        depth > 0,
        F.transform(F.sequence(F.lit(1), depth), lambda n: F.array_join(F.slice(parts, 1, n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def none_marker(path) -> Column:
    return F.concat(col(path), F.lit(f".{NONE_SUFFIX}"))


def url_parts(url, scheme: str = "gs") -> Column:
    """`gs://bucket/a/b.txt` -> struct(bucket, object, file); null when it is no such URL."""
    u, pattern = col(url), f"{scheme}://(.*?)/(.*)"
    obj = F.regexp_extract(u, pattern, 2)
    return F.when(
        u.rlike(pattern),
        F.struct(
            F.regexp_extract(u, pattern, 1).alias("bucket"),
            obj.alias("object"),
            F.substring_index(obj, "/", -1).alias("file"),
        ),
    )


def object_path(*parts) -> Column:
    """Join the non-null parts with `/`; empty parts stay."""
    return F.concat_ws("/", *[col(p) for p in parts])


def url_join(bucket, *parts, scheme: str = "gs") -> Column:
    """Build an object URL, adding `/` only before parts that lack it."""
    pieces = [F.lit(f"{scheme}://"), col(bucket)]
    for part in parts:
        p = col(part)
        pieces.append(F.when(p.isNull(), "").when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    return F.concat(*pieces)


def relative_to(path, root: str) -> Column:
    """Path below `root` (prefix only), null when it lies elsewhere."""
    prefix = root if root.endswith("/") else root + "/"
    p = col(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 2147483647))


def kebab(text) -> Column:
    """Lower case, every character outside [a-z0-9] becomes a dash."""
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]", "-")


def mount_path(kind, path, in_paths=None, inputs_dir=None, outputs_dir=None) -> Column:
    """Where a file appears inside the container of the step that uses it.

    Inputs, and outputs of an earlier step that arrived in the item's input, sit under
    the inputs folder; outputs of this step under the outputs folder.
    """
    k, p = col(kind), col(path)
    into = F.lit(DEFAULT_INPUTS_DIR) if inputs_dir is None else col(inputs_dir)
    out = F.lit(DEFAULT_OUTPUTS_DIR) if outputs_dir is None else col(outputs_dir)
    incoming = ~k.isin("output", "directory")
    if in_paths is not None:
        incoming = incoming | ((k == "output") & F.array_contains(col(in_paths), p))
    return F.concat(F.when(incoming, into).otherwise(out), F.lit("/"), p)
