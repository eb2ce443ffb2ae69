"""Time predicates as columns. Instants are UTC timestamps; wall times are the archive's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.config import OVERDUE, WorkingHours


def local(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant.cast("timestamp"), zone)


def local_date(instant: Column, zone: str) -> Column:
    return F.to_date(local(instant, zone))


def date_text(instant: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(local(instant, zone), "yyyy-MM-dd"), F.lit(""))


def datetime_text(instant: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(local(instant, zone), "yyyy-MM-dd HH:mm"), F.lit(""))


def when_text(instant: Column, zone: str, now: Column) -> Column:
    """``14:02`` today, ``Mon 09:00`` within six days, else the full date."""
    away = F.datediff(local_date(instant, zone), local_date(now, zone))
    shown = local(instant, zone)
    return F.coalesce(
        F.when(away == 0, F.date_format(shown, "HH:mm"))
        .when(away.between(-6, 6), F.date_format(shown, "EEE HH:mm"))
        .otherwise(F.date_format(shown, "yyyy-MM-dd HH:mm")),
        F.lit(""),
    )


def mtime_date(mtime_ns: Column, zone: str) -> Column:
    seconds = F.floor(mtime_ns / F.lit(1_000_000_000))
    return date_text(F.timestamp_seconds(seconds), zone)


def due_text(due: Column, zone: str, now: Column) -> Column:
    """The local date of ``due``, or that it has passed."""
    return (
        F.when(due.isNull(), "")
        .when(local_date(due, zone) < local_date(now, zone), OVERDUE)
        .otherwise(date_text(due, zone))
    )


def iso_text(instant: Column) -> Column:
    return F.date_format(instant.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parse_iso(text: Column) -> Column:
    """ISO-8601 with any offset; without one it is UTC (the session's zone)."""
    return F.try_to_timestamp(text)


_DAY = 86_400_000_000  # microseconds


def _seconds(clock: str) -> int:
    return int(clock[:2]) * 3600 + int(clock[3:]) * 60


def is_working(instant: Column, hours: WorkingHours) -> Column:
    """Inside the working slot at its wall time; a slot over midnight belongs to its first day."""
    if hours.start == hours.end or not hours.days:
        return F.lit(False)
    wall = F.unix_micros(local(instant, hours.zone))
    clock = F.pmod(wall, F.lit(_DAY))
    today = F.pmod(F.floor(wall / _DAY) + 3, F.lit(7))  # the epoch was a Thursday
    start, end = (F.lit(_seconds(c) * 1_000_000) for c in (hours.start, hours.end))
    if hours.start < hours.end:
        return today.isin(*hours.days) & (clock >= start) & (clock < end)
    yesterday = F.pmod(today + 6, F.lit(7))
    return (today.isin(*hours.days) & (clock >= start)) | (
        yesterday.isin(*hours.days) & (clock < end)
    )


def next_change(instant: Column, hours: WorkingHours, horizon_days: int = 8) -> Column:
    """Next instant at which :func:`is_working` flips, or null within the horizon.

    Mostly the zone's offset does not change within the horizon; then the flip is plain
    arithmetic on the wall time. The search over candidates is left to the days around a change.
    """
    if hours.start == hours.end or not hours.days:
        return F.lit(None).cast("timestamp")
    instant = instant.cast("timestamp")
    limit = instant + F.expr(f"interval {horizon_days} days")

    def offset(at: Column) -> Column:
        return F.unix_micros(local(at, hours.zone)) - F.unix_micros(at)

    day_before = instant - F.expr("interval 1 day")
    day_after = limit + F.expr("interval 1 day")
    steady = (offset(day_before) == offset(instant)) & (offset(instant) == offset(day_after))
    wall = F.unix_micros(local(instant, hours.zone))
    flip = F.timestamp_micros(_next_flip(wall, hours, horizon_days) - offset(instant))
    flip = F.when(flip <= limit, flip)
    return F.when(steady, flip).otherwise(_search(instant, limit, hours, horizon_days))


def _next_flip(wall: Column, hours: WorkingHours, horizon_days: int) -> Column:
    """The wall time of the next flip where wall times never jump."""
    clock = F.pmod(wall, F.lit(_DAY))
    midnight = wall - clock
    today = F.pmod(F.floor(midnight / _DAY) + 3, F.lit(7))
    start, end = (F.lit(_seconds(c) * 1_000_000) for c in (hours.start, hours.end))
    listed = today.isin(*hours.days)
    if hours.start < hours.end:
        working = listed & (clock >= start) & (clock < end)
        closing = midnight + end
    else:
        evening = listed & (clock >= start)
        working = evening | (F.pmod(today + 6, F.lit(7)).isin(*hours.days) & (clock < end))
        closing = midnight + end + F.when(evening, F.lit(_DAY)).otherwise(F.lit(0))
    opening = F.lit(None).cast("bigint")
    for ahead in range(horizon_days, -1, -1):
        on_that_day = F.pmod(today + ahead, F.lit(7)).isin(*hours.days)
        if ahead == 0:
            on_that_day = on_that_day & (clock < start)
        opening = F.when(on_that_day, midnight + F.lit(ahead * _DAY) + start).otherwise(opening)
    return F.when(working, closing).otherwise(opening)


def _search(instant: Column, limit: Column, hours: WorkingHours, horizon_days: int) -> Column:
    """The first flip among the slot borders of each day, read at the offsets around the day, and
    the quarter hours of a day whose offset changes."""
    now_working = is_working(instant, hours)
    first = F.date_sub(local_date(instant, hours.zone), 1)
    days = F.sequence(first, F.date_add(first, horizon_days + 2))

    def offset(at: Column) -> Column:
        return F.unix_timestamp(F.from_utc_timestamp(at, hours.zone)) - F.unix_timestamp(at)

    def of_day(day: Column) -> Column:
        midnight = F.unix_timestamp(day.cast("timestamp"))
        early = offset(F.timestamp_seconds(midnight - 43200))
        late = offset(F.timestamp_seconds(midnight + 129600))
        borders = []
        for clock in (hours.start, hours.end):
            borders += [midnight + _seconds(clock) - early, midnight + _seconds(clock) - late]
        quarters = F.when(
            early != late,
            F.transform(F.sequence(F.lit(-48), F.lit(144)), lambda q: midnight + q * 900),
        ).otherwise(F.array().cast("array<bigint>"))
        return F.concat(F.array(*borders).cast("array<bigint>"), quarters)

    candidates = F.transform(F.flatten(F.transform(days, of_day)), F.timestamp_seconds)
    flips = F.filter(
        candidates,
        lambda c: (c > instant) & (c <= limit) & (is_working(c, hours) != now_working),
    )
    return F.array_min(flips)
