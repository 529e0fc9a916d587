"""Column expressions for capacities, durations and parallelism limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtable.functions.common import col

# Fixed value: what a capacity text looks like.
CAPACITY_PATTERN = r"(\d+)\s*([KMGT]?B)"
# Units are powers of 1024; an unlimited task counts as this many slots.
UNIT_BYTES = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3, "TB": 1024**4}
UNLIMITED_SLOTS = 262144


def _unit_factor(unit: Column) -> Column:
    factor = F.when(unit == "B", F.lit(UNIT_BYTES["B"]).cast("double"))
    for name in ("KB", "MB", "GB", "TB"):
        factor = factor.when(unit == name, F.lit(UNIT_BYTES[name]).cast("double"))
    return factor


def parse_capacity(text, strict: bool = False) -> Column:
    """Bytes of a text such as `10GB` or `5 mb`; null when it does not parse.

    The default finds the first number-and-unit anywhere (`1.5GB` reads as 5 GB, as the
    original behaviour is); `strict` wants the whole text to be one.
    """
    pattern = CAPACITY_PATTERN
    if strict:
        pattern = r"^\s*" + pattern + r"\s*$"
    upper = F.upper(col(text))
    number = F.regexp_extract(upper, pattern, 1)
    unit = F.regexp_extract(upper, pattern, 2)
    return (number.try_cast("double") * _unit_factor(unit)).try_cast("bigint")


def to_bytes(value, unit: str) -> Column:
    """A number in `unit` as whole bytes, truncated; null beyond the largest long."""
    return (col(value).cast("double") * F.lit(float(UNIT_BYTES[unit]))).try_cast("bigint")


def from_bytes(value, unit: str) -> Column:
    return col(value).cast("double") / F.lit(float(UNIT_BYTES[unit]))


def bytes_of(number: float, unit: str) -> int:
    """The same truncation for a Python constant."""
    return int(number * UNIT_BYTES[unit])


_MS = {"days": 86_400_000, "hours": 3_600_000, "minutes": 60_000}


def duration_ms(value, unit: str) -> Column:
    """Milliseconds of a number of days, hours or minutes; the number is truncated first."""
    return F.try_multiply(col(value).try_cast("bigint"), F.lit(_MS[unit]).cast("bigint"))


def parse_parallelism(text) -> Column:
    """struct(ok, slots): `unlimited` in any case, or a whole number; slots are null when bad."""
    t = col(text)
    slots = F.when(F.lower(t) == "unlimited", F.lit(UNLIMITED_SLOTS)).otherwise(t.try_cast("int"))
    return F.struct(slots.isNotNull().alias("ok"), slots.alias("slots"))


def duration_text(ms) -> Column:
    """`3723500` -> `1h2m3.5s`, `0` -> `0s`; every part of a negative duration has its minus."""
    m = F.abs(col(ms))
    sign = F.when(col(ms) < 0, "-").otherwise("")
    hours = F.floor(m / 3_600_000)
    minutes = F.floor(m % 3_600_000 / 60_000)
    rest = m % 60_000
    seconds = F.floor(rest / 1000)
    millis = rest % 1000
    fraction = F.regexp_replace(F.lpad(millis.cast("string"), 3, "0"), "0+$", "")
    part = lambda cond, *pieces: F.when(cond, F.concat(sign, *pieces)).otherwise("")
    whole = (millis == 0) & ((seconds > 0) | (m == 0))
    return F.concat(
        part(hours > 0, hours.cast("string"), F.lit("h")),
        part(minutes > 0, minutes.cast("string"), F.lit("m")),
        part(millis > 0, seconds.cast("string"), F.lit("."), fraction, F.lit("s")),
        part(whole, seconds.cast("string"), F.lit("s")),
    )


def time_text(ms) -> Column:
    """Epoch milliseconds as `yyyy-MM-dd HH:mm:ss` in UTC."""
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd HH:mm:ss")
