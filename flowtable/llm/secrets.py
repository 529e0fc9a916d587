"""Secret scans over an incremental blob ledger.

Every version of every text is addressed by the SHA-256 of its content. The ledger, a folder of
Parquet files in the shared store with one row per (blob, rule version) that was ever scanned, says
which blobs are still unseen under the rules at hand; only those are scanned, each once whatever the
number of its copies, and findings are joined back to every path by the address.

DataFrame and SQL functions only. Spans are code points, end exclusive: splitting a text at a pattern
gives the pieces between the matches, so a running sum of lengths gives the places.

A web token starts where no character of its alphabet stands before, so a long run is read once.

Null text: the empty text. No finding: zero counts, empty strings. Repeated rows: each gets its own
result. Empty table: no rows. Only the key and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtable.llm.common import stored
from flowtable.session import new_path


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has at least `least` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


# A private key from BEGIN to END. A text without five dashes lies between; where no END follows, the key is
# the header lines and base64 runs (a shorter last line included). Possessive groups: the regex engine loops, it does not recurse.
_LABEL = r"[A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
_BREAK = r"(?:[ \t\n\x0B\f\r]|\\[nr])++"
PEM = (
    rf"-----BEGIN {_LABEL}(?:[^-]*+(?:-{{1,4}}[^-]++)*+-----END {_LABEL}"
    rf"|(?:{_BREAK}(?:[A-Z][A-Za-z-]*+: [^\r\n\\]*+|[A-Za-z0-9+/=]{{16,}}+))++(?:[ \t\n\x0B\f\r]*[\r\n][A-Za-z0-9+/=]++(?=[ \t]*(?:[\r\n]|$)))?+)?+"
)
# The base patterns. A greedy run with a least length equals the run filtered by length;
# for `assign`, whose failing matches use up text, the filter stays apart.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", PEM, base=False),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", base=False),
)
VERSION = "1.2"
FOUND = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,base:boolean>>"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, found: its spans by start, then in the order of the rules. `blobs` has each blob once."""
    text = F.col("content")

    def of(rank: int, rule: Rule) -> Column:
        p = F.lit(rule.pattern)
        return F.when(
            text.rlike(rule.pattern),
            F.struct(
                F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base"), F.lit(rule.least).alias("least"),
                F.split(text, rule.pattern, -1).alias("between"),
                F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
                F.regexp_extract_all(text, p, F.lit(rule.group)).alias("value"),
            ),
        )

    hits = blobs.select("blob", F.explode_outer(F.filter(F.array(*[of(i, r) for i, r in enumerate(rules)]), lambda x: x.isNotNull())).alias("r"))
    each = hits.select(
        "blob", "r.rank", "r.kind", "r.base", "r.least",
        F.posexplode_outer(F.arrays_zip("r.between", "r.whole", "r.value")).alias("i", "m"),
    ).select(
        "blob", "rank", "kind", "base", "i", F.length("m.between").alias("gap"), F.length("m.whole").alias("size"),
        (F.length("m.value") >= F.col("least")).alias("counts"),
    )
    upto = Window.partitionBy("blob", "rank").orderBy("i")
    stop = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(upto)
    span = F.struct(
        (F.col("stop") - F.col("size")).alias("start"), "rank", F.col("stop").alias("stop"), "kind", "base"
    )
    return each.withColumn("stop", stop).groupBy("blob").agg(  # spans of one text
        F.sort_array(F.collect_list(F.when(F.col("counts"), span))).cast(FOUND).alias("found")
    )


def update_ledger(versions: DataFrame, ledger: str, content: str = "text", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scan the blobs of `versions` that `ledger` lacks under `version`; returns the ledger's rows of that
    version (blob, found). Each call adds a folder of its own, so two calls at once do not collide;
    a blob that both scanned has one row in the result."""
    spark = versions.sparkSession
    schema = f"blob string, rule_version string, found {FOUND}"
    text = F.coalesce(F.col(content), F.lit(""))
    blobs = versions.select(address(F.col(content)).alias("blob"), text.alias("content")).dropDuplicates(["blob"])
    earlier = _read(spark, ledger, schema)
    if earlier is not None:
        seen = earlier.where(F.col("rule_version") == version).select("blob")
        blobs = blobs.join(seen, "blob", "left_anti")
    scanned = scan_blobs(blobs, rules).select("blob", F.lit(version).alias("rule_version"), "found")
    scanned.write.parquet(f"{ledger}/run={uuid.uuid4().hex}")
    rows = _read(spark, ledger, schema).where(F.col("rule_version") == version).select("blob", "found")
    return rows if earlier is None else rows.dropDuplicates(["blob"])


def _read(spark, ledger: str, schema: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start, x.stop)), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x.kind == kind)).cast("long")


def findings(docs: DataFrame, ledger: str | None = None, key: str = "doc_id", rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """key, blob, found, n_<kind> of each base rule, base_sha256, spans."""
    ledger = ledger or new_path(docs.sparkSession, "secret-ledger")
    paths = docs.select(F.col(key).alias("__key"), address(F.col("text")).alias("blob"))
    rows = paths.join(update_ledger(docs, ledger, "text", rules, version), "blob", "left")
    base = F.filter("found", lambda x: x.base)
    return rows.select(
        F.col("__key").alias(key), "blob", "found",
        *[_count(r.kind).alias(f"n_{r.kind}") for r in rules if r.base],
        F.sha2(_text(base), 256).alias("base_sha256"),
        _text(F.col("found")).alias("spans"),
    )


def drafts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """An earlier version of `docs`, made up from it: of every other row (by a hash of its key) the first half
    of the text, of the rest the text as it is. All rows and columns stay."""
    shorter = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 2 == 0
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return docs.withColumn("text", F.when(shorter, half).otherwise(F.col("text")))


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """`docs` with every found span of `text` replaced by `mark` (touching and overlapping spans by one
    mark) and `n_chars` set to the new length. All rows and columns stay."""
    ledger = ledger or new_path(docs.sparkSession, "secret-ledger")
    hits = stored(update_ledger(docs, ledger).where(F.size("found") > 0).select(F.col("blob").alias("__blob"), F.col("found").alias("__found")), "secret-hits")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(done: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (done.at + 1).cast("int"), (x.start - done.at).cast("int"))
        return F.struct(
            F.greatest(done.at, x.stop).alias("at"),
            F.when((x.start > done.at) | (F.size(done.pieces) == 0), F.concat(done.pieces, F.array(gap, F.lit(mark)))).otherwise(done.pieces).alias("pieces"),
        )

    rest = F.aggregate("__found", start, step, lambda done: F.concat(F.array_join(done.pieces, ""), F.substring(F.col("text"), (done.at + 1).cast("int"), F.length("text"))))
    # Always by sort and merge: one plan at every size.
    joined = docs.withColumn("__blob", address(F.col("text"))).join(hits.hint("merge"), "__blob", "left")
    clean = F.when(F.col("__found").isNull(), F.col("text")).otherwise(rest)
    size = F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("__clean").cast("long"))
    return joined.withColumn("__clean", clean).select(
        *[F.col("__clean").alias("text") if c == "text" else size.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    )
