"""Dates. Stored dates are epoch seconds of midnight in the source's zone (UTC+8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "+08:00"


def epoch_of(day: Column, zone: str = ZONE) -> Column:
    """ISO day -> epoch seconds of its midnight in the zone."""
    return F.unix_seconds(F.to_utc_timestamp(F.to_timestamp(F.to_date(day)), zone))


def day_of(epoch: Column, zone: str = ZONE) -> Column:
    """Epoch seconds -> date in the zone; whole numbers that read as YYYYMMDD are taken as such (T5)."""
    compact = F.to_date(epoch.cast("string"), "yyyyMMdd")
    real = F.to_date(F.from_utc_timestamp(F.timestamp_seconds(epoch), zone))
    return F.when(epoch.between(19000101, 21001231), compact).otherwise(real)


def year_of(epoch: Column, zone: str = ZONE) -> Column:
    return F.year(day_of(epoch, zone))


def parse_day(raw: Column) -> Column:
    """D3: 2024年3月5日, 2024-03-05, 2024.3.5, 2024/3/5, 2024-03 (day 1); null if it isn't a date."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(raw), "[年月./]", "-"), "日.*$", "")
    part = lambda k: F.regexp_extract(plain, r"^(\d{4})-(\d{1,2})(?:-(\d{1,2}))?-?(?:\s.*)?$", k)
    iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(F.when(part(3) == "", "1").otherwise(part(3)), 2, "0"))
    return F.when(part(1) != "", F.try_to_date(iso, "yyyy-MM-dd"))


def from_millis(ms: Column) -> Column:
    """D4."""
    return F.to_date(F.timestamp_millis(ms))


def compact_day(raw: Column) -> Column:
    """YYYYMMDD with month and day in range, else null."""
    good = raw.rlike(r"^(19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$")
    return F.when(good, F.try_to_date(raw, "yyyyMMdd"))


def months(year: Column, month: Column, default: int = 6) -> Column:
    """Absolute months."""
    return year * 12 + F.coalesce(month, F.lit(default))


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column, open_months: int = 48) -> Column:
    """Months that two intervals share; a missing end is open_months after the start."""
    end = lambda s, e: F.coalesce(e, s + open_months)
    return F.greatest(F.lit(0), F.least(end(a_start, a_end), end(b_start, b_end)) - F.greatest(a_start, b_start))


def month_key(day: Column) -> Column:
    """D7."""
    return F.substring(day.cast("string"), 1, 7)
