"""Timestamps, ages and buckets. Sessions keep spark.sql.session.timeZone at UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes that are read; a fraction of a second and the zone may be missing.
SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}(:?\d{2})?)?$"


def parse_ts(c: Column) -> Column:
    """Null for what is no full timestamp; second 60 is the next minute's first."""
    s = F.trim(c)
    leap = F.substring(s, 18, 2) == "60"
    plain = F.when(leap, F.concat(F.substring(s, 1, 17), F.lit("59"), s.substr(F.lit(20), F.length(s)))).otherwise(s)
    ts = F.when(s.rlike(SHAPE), F.try_to_timestamp(plain))
    return F.when(leap, ts + F.expr("INTERVAL 1 SECOND")).otherwise(ts)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def age_hours(ts: Column, now: Column) -> Column:
    """What has no time is infinitely old."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 3600.0, F.lit(float("inf")))


def seconds_between(a: Column, b: Column) -> Column:
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def week(ts: Column) -> Column:
    """``YYYY-Wnn``: weeks start on Mondays, days before a year's first Monday are week 0."""
    number = F.floor((F.dayofyear(ts) + 6 - (F.dayofweek(ts) + 5) % 7) / 7)
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


def bucket(ts: Column, unit: str) -> Column:
    if unit == "week":
        return week(ts)
    return F.date_format(ts, {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd"}[unit])
