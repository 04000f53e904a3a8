"""Text forms of numbers, durations and labels for report projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.numeric import col

# Byte units, base 1024.
BYTE_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def duration(seconds: Column | str) -> Column:
    """`1h 2m 3s`, `2m 3s` or `3s`; `0s` for null."""
    s = F.coalesce(col(seconds).cast("long"), F.lit(0).cast("long"))
    h, m, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %dm %ds", h, m, rest))
        .when(m > 0, F.format_string("%dm %ds", m, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def _plain(x: Column) -> Column:
    """A number rounded to 2 digits without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), r"0+$", ""), r"\.$", "")


def byte_size(b: Column | str) -> Column:
    """`1.5 KB`, two digits at most, base 1024."""
    b = col(b).cast("double")
    out = F.when(b == 0, F.lit("0 Bytes"))
    for i, unit in enumerate(BYTE_UNITS):
        value = F.concat(_plain(b / float(1024**i)), F.lit(f" {unit}"))
        out = out.when(b < float(1024 ** (i + 1)), value) if i + 1 < len(BYTE_UNITS) else out.otherwise(value)
    return out


def thousands(n: Column | str) -> Column:
    return F.coalesce(F.format_number(col(n), 0), F.lit("0"))


def percent(value: Column | str) -> Column:
    return F.concat(F.format_number(col(value), 1), F.lit("%"))


def shorten(text: Column | str, size: int = 50) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size), F.lit("...")))


def title(key: Column | str) -> Column:
    """`circuit_breaker` -> `Circuit Breaker`."""
    return F.initcap(F.regexp_replace(col(key), "_", " "))
