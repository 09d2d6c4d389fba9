"""Dates, times, schedules and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delays in seconds after the first, second, ... failure.
AGENT_DELAYS = [600, 3600, 21600, 86400]
PUBLISH_DELAYS = [300, 1800, 7200, 21600]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp without zone, as a number that RANGE frames take."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), _c(ts))


def lenient_timestamp(x) -> Column:
    """ISO text (without zone: UTC) or seconds since 1970; null for anything else."""
    x = _c(x)
    number = F.when(x.rlike(r"^-?\d+(\.\d+)?$"), x.try_cast("double"))
    return F.coalesce(F.when(number.isNull(), F.try_to_timestamp(F.nullif(x, F.lit("")))), F.timestamp_micros((number * 1_000_000).cast("long")))


def provider_timestamp(x) -> Column:
    """ISO, or `Sat Aug 30 00:00:00 +0000 2026`."""
    x = _c(x)
    return F.coalesce(F.when(x.rlike("^[A-Z][a-z]{2} "), F.try_to_timestamp(F.substr(x, F.lit(5)), F.lit("MMM dd HH:mm:ss Z yyyy"))), lenient_timestamp(F.when(~x.rlike("^[A-Z][a-z]{2} "), x)))


def dates_to_fetch(previous, target, limit: int) -> Column:
    """Days after previous up to target, the earliest `limit`; target alone without a previous one."""
    previous, target = _c(previous), _c(target)
    n = F.least(F.lit(max(1, limit)), F.datediff(target, previous))
    days = F.sequence(F.date_add(previous, 1), F.date_add(previous, n))
    return F.when(previous.isNull(), F.array(target)).when(previous >= target, F.expr("CAST(array() AS array<date>)")).otherwise(days)


def dates_to_backfill(previous, target, limit: int) -> Column:
    """Days after previous up to the day before target, the earliest `limit`; none without a previous one."""
    previous, end = _c(previous), F.date_sub(_c(target), 1)
    n = F.least(F.lit(max(1, limit)), F.datediff(end, previous))
    days = F.sequence(F.date_add(previous, 1), F.date_add(previous, n))
    return F.when(previous.isNull() | (previous >= end), F.expr("CAST(array() AS array<date>)")).otherwise(days)


def bounded_scan(previous, upstream, limit: int) -> Column:
    """(first, last, backlog) of the ids after previous, `limit` at most."""
    previous, upstream = _c(previous), _c(upstream)
    last = F.least(upstream, previous + limit)
    return F.struct((previous + 1).alias("first"), F.greatest(last, previous).alias("last"), F.greatest(upstream - last, F.lit(0)).alias("backlog"))


def retry_delay(attempt, delays: list[int], clamp: bool = True) -> Column:
    """Seconds until the next try after so many failures; past the end the last delay, or null if not clamped."""
    attempt = _c(attempt)
    at = F.greatest(attempt, F.lit(1))
    return F.try_element_at(F.array(*map(F.lit, delays)), (F.least(at, F.lit(len(delays))) if clamp else at).cast("int"))


def scheduled_events(hour, minute) -> Column:
    """Fixed times of day and what starts then."""
    hour, minute = _c(hour), _c(minute)
    names = lambda *x: F.array(*map(F.lit, x))
    on = minute == 0
    return (
        F.when((hour == 13) & (minute == 30), names("papers"))
        .when(hour == 7, names("daily"))
        .when(on & hour.isin(1, 13), names("incremental"))
        .when(on & (hour == 3), names("recover"))
        .when(on & (hour == 19), names("incremental", "papers"))
        .when(on & (hour == 20), names("x-for-you"))
        .otherwise(F.expr("CAST(array() AS array<string>)"))
    )


def catch_up_events(minute_of_day, daily_done) -> Column:
    """What a late wake-up starts; a daily run that is due covers everything else."""
    m = _c(minute_of_day)
    names = lambda *x: F.array(*map(F.lit, x))
    return F.when((m >= 420) & ~_c(daily_done), names("daily")).when(m >= 1200, names("incremental", "papers", "x-for-you")).when(m >= 810, names("incremental", "papers")).when(m >= 780, names("incremental")).when(m >= 420, names("recover")).when(m >= 60, names("incremental")).otherwise(names("recover"))


def stamp(ts) -> Column:
    return F.date_format(_c(ts), "yyyyMMdd'T'HHmmss")
