"""Column functions for slot times. Wall-clock arithmetic stays on TIMESTAMP_NTZ; UTC comes last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"
SLOT_MINUTES = 30


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def next_weekday(day: Column | str, weekday: Column | int) -> Column:
    """The first date strictly after `day` on `weekday` (0 is Monday): 1 to 7 days ahead."""
    ahead = F.pmod(F.lit(weekday) - F.weekday(_c(day)), F.lit(7))
    return F.date_add(_c(day), F.when(ahead == 0, F.lit(7)).otherwise(ahead).cast("int"))


def at_time(day: Column | str, hour: Column, minute: Column) -> Column:
    """A date's wall-clock time as TIMESTAMP_NTZ."""
    return _c(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, F.lit(0))


def slot_end(start: Column | str, minutes: int = SLOT_MINUTES) -> Column:
    return _c(start) + F.expr(f"INTERVAL {minutes} MINUTES")


def to_utc(local: Column | str, zone: str = ZONE) -> Column:
    """A zone's wall-clock time in UTC, still without a zone of its own."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _c(local))


def iso_with_offset(local: Column | str, zone: str = ZONE) -> Column:
    """ISO text of a wall-clock time with its UTC offset, as in 2025-12-07T15:00:00-06:00."""
    local = _c(local)
    minutes = F.timestamp_diff("MINUTE", to_utc(local, zone), local)
    size = F.abs(minutes)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, two(F.floor(size / 60)), F.lit(":"), two(size % 60))


def compact_utc(utc: Column | str) -> Column:
    """Compact UTC text, as in 20251207T210000Z."""
    return F.date_format(_c(utc), "yyyyMMdd'T'HHmmss'Z'")


def ntz_of(instant: Column | str) -> Column:
    """An instant as TIMESTAMP_NTZ in UTC, whatever the session's zone."""
    seconds = (F.unix_micros(_c(instant)).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def micros_of(time: Column | str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ since 1970, as if it were UTC, whatever the session's zone."""
    time = _c(time).cast("timestamp_ntz")
    minutes = (F.date_diff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(time)) * 60 + F.minute(time)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def parse_iso(text: Column | str) -> Column:
    """ISO text with or without an offset or a fraction as TIMESTAMP_NTZ in UTC; null if it can't be read.

    Text without an offset is UTC; the session's zone plays no part.
    """
    offset = F.rlike(_c(text), F.lit(r"[T ]\d{1,2}:.*(?:Z|[+-]\d{1,2}(?::?\d{2})?)\s*$"))
    return F.when(offset, ntz_of(F.try_to_timestamp(_c(text)))).otherwise(_c(text).try_cast("timestamp_ntz"))
