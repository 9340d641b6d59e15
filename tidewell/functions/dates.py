"""Calendar functions in Korean time, which is UTC+9 all year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Hours from which an edition is due.
SLOT_HOURS = {"morning": 7, "lunch": 12, "evening": 19}


def kst_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr("interval 9 hours"))


def week_key(day: Column) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_in_month(day: Column) -> Column:
    return F.day(F.last_day(day))


def slot_for_hour(hour: Column) -> Column:
    """morning from 5, lunch from 11, evening from 17 to 5."""
    return F.when((hour >= 5) & (hour < 11), "morning").when((hour >= 11) & (hour < 17), "lunch").otherwise("evening")


def due_slot(hour: Column) -> Column:
    """The edition that is due at an hour: morning from 7, lunch from 12, evening from 19, null before."""
    return F.when(hour >= 19, "evening").when(hour >= 12, "lunch").when(hour >= 7, "morning")


def age_label(minutes: Column) -> Column:
    """just now, so many minutes, so many hours, rounded."""
    return (
        F.when(minutes < 1, "방금")
        .when(minutes < 60, F.concat(F.floor(minutes + 0.5).cast("string"), F.lit("분")))
        .otherwise(F.concat(F.floor(minutes / 60 + 0.5).cast("string"), F.lit("시간")))
    )


def sane_time(ts: Column, now: Column) -> Column:
    """A publication time, null if over an hour ahead of now or over five years old."""
    return F.when((ts <= now + F.expr("interval 1 hour")) & (ts >= now - F.expr("interval 1826 days 6 hours")), ts)


def list_time(label: Column, now: Column) -> Column:
    """Times as list pages print them: clock times, month-day, relative ages and short dates; those ahead of now are of the day or year before. Null if not sane."""
    told = F.trim(label)

    def num(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(told, pattern, 1), F.lit("")).cast("int")

    today = F.date_format(now, "yyyy-MM-dd ")
    clock = F.coalesce(F.try_to_timestamp(F.concat(today, told), F.lit("yyyy-MM-dd H:mm:ss")), F.try_to_timestamp(F.concat(today, told), F.lit("yyyy-MM-dd H:mm")))
    clock = F.when(clock > now + F.expr("interval 1 minute"), clock - F.expr("interval 1 day")).otherwise(clock)
    day = F.try_to_timestamp(F.concat(F.year(now).cast("string"), F.lit("-"), F.regexp_replace(F.regexp_replace(told, "[/.]", "-"), r"\s+", " ")), F.lit("yyyy-M-d H:mm"))
    day = F.when(day > now + F.expr("interval 1 minute"), day - F.expr("interval 1 year")).otherwise(day)
    plain = F.regexp_replace(F.regexp_replace(told, r"^(\d{2})[./](\d{2})[./](\d{2})(?=\s|$)", "20$1-$2-$3"), r"\.", "-")
    read = (
        F.when(told.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), clock)
        .when(told.rlike(r"^\d{1,2}[-/.]\d{1,2}\s+\d{1,2}:\d{2}$"), day)
        .when(told.rlike(r"^\d+\s*시간\s*전$"), now - F.make_dt_interval(hours=num(r"^(\d+)")))
        .when(told.rlike(r"^\d+\s*분\s*전$"), now - F.make_dt_interval(mins=num(r"^(\d+)")))
        .when(told.rlike(r"^\d+\s*일$"), now - F.make_dt_interval(days=num(r"^(\d+)")))
        .otherwise(F.try_to_timestamp(plain))
    )
    return sane_time(read, now)
