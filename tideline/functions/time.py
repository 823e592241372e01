"""Column builders over time. Naive timestamps throughout; ISO weekdays 1 (Monday) to 7."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"h": "HOUR", "d": "DAY", "m": "MINUTE"}


def window_size(spec: str) -> tuple[int, str]:
    """``6h``, ``1d`` or ``30m`` as (number, unit)."""
    m = re.fullmatch(r"(\d+)([hdm])", spec.strip().lower())
    if not m:
        raise ValueError(f"not a window size: {spec}")
    return int(m.group(1)), _UNITS[m.group(2)]


def interval(spec: str) -> Column:
    n, unit = window_size(spec)
    return F.expr(f"INTERVAL '{n}' {unit}")


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def parse_timestamp(c: Column) -> Column:
    """Three written formats, a trailing zone name cut off; null where none fits."""
    c = F.regexp_replace(F.regexp_replace(c, r"\s+(UTC|GMT|EST|EDT|Z)$", ""), "^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ", "")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MMM dd HH:mm:ss Z yyyy")]).cast("timestamp_ntz")


def eastern_to_utc(c: Column) -> Column:
    """``... EST`` is five hours behind, ``... EDT`` four."""
    t = F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.when(c.endswith("EST"), t + F.expr("INTERVAL '5' HOUR")).when(c.endswith("EDT"), t + F.expr("INTERVAL '4' HOUR")).otherwise(t)


def iso_weekday(c: Column) -> Column:
    return F.weekday(c) + 1


def calendar(c: Column) -> dict[str, Column]:
    day = F.dayofmonth(c)
    return {
        "year": F.year(c), "month": F.month(c), "iso_week": F.weekofyear(c), "week_of_month": F.floor((day - 1) / 7).cast("int") + 1, "day": day, "weekday": iso_weekday(c), "hour": F.hour(c), "minute": F.minute(c), "year_month": F.date_format(c, "yyyy-MM"),
    }


def day_parts(c: Column) -> dict[str, Column]:
    """Weekend by ISO (strict) and with Friday (compat), morning [6, 12), evening [18, 24)."""
    hour, day = F.hour(c), iso_weekday(c)
    return {"is_weekend": day >= 6, "is_weekend_compat": day >= 5, "is_morning": (hour >= 6) & (hour < 12), "is_evening": hour >= 18}


def window_start(c: Column, start: Column, spec: str) -> Column:
    """Start of the tumbling window of ``c`` when windows begin at ``start``."""
    n, unit = window_size(spec)
    size = n * {"MINUTE": 60, "HOUR": 3600, "DAY": 86400}[unit]
    k = F.floor(seconds_between(start, c) / size)
    return F.timestamp_add("SECOND", (k * size).cast("bigint"), start)
