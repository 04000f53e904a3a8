"""Date and time helpers. Every operator takes `as_of`; nothing here reads the clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.numeric import col, flag


def moment(as_of: str | datetime | Column) -> Column:
    """A timestamp without zone from text, datetime or column."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def before(as_of, hours: float = 0, days: float = 0) -> Column:
    seconds = hours * 3600 + days * 86400
    return moment(as_of) - F.make_dt_interval(secs=F.lit(float(seconds)))


def after(as_of, hours: float = 0, seconds: float = 0) -> Column:
    return moment(as_of) + F.make_dt_interval(secs=F.lit(float(hours * 3600 + seconds)))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """end - start in seconds, fractions kept."""
    us = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return us / F.lit(1_000_000.0)


def hour_start(c: Column | str) -> Column:
    return F.date_trunc("hour", col(c)).cast("timestamp_ntz")


def day_start(c: Column | str) -> Column:
    return F.date_trunc("day", col(c)).cast("timestamp_ntz")


def iso(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def calendar(ts: Column | str) -> dict[str, Column]:
    """Hour, weekday (Monday is 0), weekend and business-hours flags."""
    hour, day = F.hour(col(ts)), F.weekday(col(ts))
    return {
        "hour": hour,
        "day_of_week": day,
        "is_weekend": flag(day >= 5),
        "is_business_hours": flag(hour.between(9, 17)),
    }


def cyclic(ts: Column | str) -> dict[str, Column]:
    """Hour of day and day of week as points on a circle."""
    hour = F.lit(2) * F.pi() * F.hour(col(ts)) / 24
    day = F.lit(2) * F.pi() * F.weekday(col(ts)) / 7
    return {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "day_sin": F.sin(day), "day_cos": F.cos(day)}
