"""Date functions. Weeks are ISO weeks, written 2026-W12."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_label(day: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def parse_week_label(label: Column) -> Column:
    """The Monday of the week; null for another text."""
    year, week = F.regexp_extract(label, "^([0-9]{4})-W([0-9]{2})$", 1), F.regexp_extract(label, "^([0-9]{4})-W([0-9]{2})$", 2)
    fourth = F.make_date(F.try_to_number(year, F.lit("9999")).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(F.trunc(fourth, "week"), (F.try_to_number(week, F.lit("99")).cast("int") - 1) * 7)


def week_label_offset(day: Column, weeks: int | Column) -> Column:
    """The week so many weeks before ``day``."""
    return week_label(F.date_sub(day, weeks * 7 if isinstance(weeks, int) else (weeks * 7).cast("int")))


def next_run(day: Column, frequency: Column) -> Column:
    """When a watched topic runs next: the Sunday after, or the first of the next month; null for another frequency."""
    d = F.to_date(day)
    return F.when(frequency == "weekly", F.next_day(d, "Sun")).when(frequency == "monthly", F.add_months(F.trunc(d, "month"), 1)).cast("timestamp")


def next_run_scheduler(day: Column, frequency: Column) -> Column:
    """The scheduler's own rule: a week on and then the next Sunday; thirty days on and then that month's first; otherwise a week."""
    d = F.to_date(day)
    return F.when(frequency == "weekly", F.next_day(F.date_add(d, 7), "Sun")).when(frequency == "monthly", F.trunc(F.date_add(d, 30), "month")).otherwise(F.date_add(d, 7)).cast("timestamp")


def annotation_cutoff(day: Column) -> Column:
    """Annotations appear about 30 days after publication: the latest date to ask for."""
    return F.date_format(F.date_sub(F.to_date(day), 30), "yyyy/MM/dd")


def job_ttl_days(status: Column) -> Column:
    return F.when(status == "completed", 7).when(status == "failed", 30).when(status == "cancelled", 3).otherwise(1)


def job_expiry(updated: Column, status: Column) -> Column:
    return updated + F.make_dt_interval(job_ttl_days(status))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def pub_date(year: Column, month: Column) -> Column:
    """"Mar 2026", or "2026" without a month; null without a year."""
    return F.when(year.isNotNull(), F.concat_ws(" ", F.when(month != "", month), year))
