"""Dates, zones, week and month buckets.  The session zone is UTC (see session)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.fixed import BUSINESS_TZ, WAREHOUSE_TZ


def instant(text: Column) -> Column:
    """Timestamp of an ISO text; text without an offset counts as UTC."""
    return F.try_to_timestamp(F.trim(text))


def local_date(text: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant(text), zone).cast("date")


def business_date(text: Column) -> Column:
    return local_date(text, BUSINESS_TZ)


def leading_date(text: Column) -> Column:
    """Date a text starts with, no zone applied; null when there is none."""
    return F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def warehouse_date(text: Column) -> Column:
    """Warehouse-local date of an instant, else the leading date."""
    return F.coalesce(local_date(text, WAREHOUSE_TZ), leading_date(text))


def month_of(day: Column) -> Column:
    return F.substring(day.cast("string"), 1, 7)


def week_key(day: Column, floor: dt.date | None = None) -> Column:
    """Monday of the week, but never before the first of the month."""
    key = F.greatest(F.date_trunc("week", day).cast("date"), F.trunc(day, "month"))
    return key if floor is None else F.when(key >= F.lit(floor), key)


def previous_business_day(day: Column) -> Column:
    back = F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1)
    return F.date_sub(day, back)


def business_midnight(day: Column, zone: str = BUSINESS_TZ) -> Column:
    """Instant of local midnight."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def business_midnight_text(day: Column, zone: str = BUSINESS_TZ) -> Column:
    """Local midnight as ISO text with its offset."""
    minutes = ((F.unix_timestamp(day.cast("timestamp")) - F.unix_timestamp(business_midnight(day, zone))) / 60).cast("int")
    size = F.abs(minutes)
    return F.concat(
        F.date_format(day, "yyyy-MM-dd'T'00:00:00"),
        F.when(minutes <= 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def month_start(as_of: dt.date, back: int = 0) -> dt.date:
    """First day of the month `back` months before as_of's month."""
    index = as_of.year * 12 + as_of.month - 1 - back
    return dt.date(index // 12, index % 12 + 1, 1)


def month_keys(as_of: dt.date, months: int) -> list[str]:
    """Rolling window of month keys, oldest first, as_of's month last."""
    return [month_start(as_of, back).strftime("%Y-%m") for back in range(months - 1, -1, -1)]


def month_window(spark: SparkSession, as_of: dt.date, months: int) -> DataFrame:
    """One row per month of the window: idx (0 = oldest), ym, first day, label."""
    first = F.lit(month_start(as_of, months - 1))
    steps = F.sequence(F.lit(0), F.lit(months - 1))
    return (
        spark.range(1)
        .select(F.explode(steps).alias("idx"))
        .withColumn("first_day", F.add_months(first, F.col("idx")))
        .select(
            "idx",
            F.date_format("first_day", "yyyy-MM").alias("ym"),
            "first_day",
            F.date_format("first_day", "MMM yyyy").alias("label"),
        )
    )


def iso_utc(text: Column) -> Column:
    """A moment without a zone is UTC: it is read and written as ISO with a Z, its fraction kept; any other text stays, a blank is null."""
    seconds, rest = F.substring(text, 1, 19), F.substring(text, 20, 20)
    moment = F.coalesce(*[F.try_to_timestamp(seconds, F.lit(layout)) for layout in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")])
    no_zone = (rest == "") | (rest.startswith(".") & rest.try_cast("decimal(20,18)").isNotNull())
    written = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), rest, F.lit("Z"))
    return F.when(moment.isNotNull() & no_zone, written).otherwise(F.nullif(text, F.lit("")))


def accounting_date(text: Column) -> Column:
    """UTC date of '/Date(ms+offset)/' (offset ignored) or of an ISO text."""
    ms = F.regexp_extract(text, r"/Date\((-?\d+)", 1).try_cast("long")
    return F.coalesce(F.timestamp_millis(ms), instant(text)).cast("date")


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def fill_dates(text: Column, as_of: dt.date, roll_after: int = 120) -> Column:
    """Array of every day named in free text such as '29 Jul & 3 Aug'.

    A day takes the next month word after it, or else the last one; a date
    more than `roll_after` days before as_of means next year.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\d{1,2}|" + "|".join(_MONTHS) + ")"), F.lit(1))

    def is_month(token: Column) -> Column:
        return token.rlike("^[a-z]")

    def month_number(token: Column) -> Column:
        return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), token).cast("int")

    def resolve(token: Column, at: Column) -> Column:
        after = F.filter(tokens, lambda t, i: (i > at) & is_month(t))
        every = F.filter(tokens, is_month)
        number = month_number(F.coalesce(F.get(after, F.lit(0)), F.element_at(every, -1)))
        shift = token.try_cast("int") - 1
        this_year = F.date_add(F.make_date(F.lit(as_of.year), number, F.lit(1)), shift)
        next_year = F.date_add(F.make_date(F.lit(as_of.year + 1), number, F.lit(1)), shift)
        return F.when(F.datediff(F.lit(as_of), this_year) > roll_after, next_year).otherwise(this_year)

    def is_day(token: Column) -> Column:
        return token.try_cast("int").between(1, 31)

    slots = F.transform(tokens, lambda t, i: F.when(is_day(t), resolve(t, i)))
    has_month = F.exists(tokens, is_month)
    return F.when(has_month, F.filter(slots, lambda d: d.isNotNull()))


def fill_date(text: Column, as_of: dt.date) -> Column:
    """Earliest day named in the text; null when no day or no month is named."""
    return F.array_min(fill_dates(text, as_of))
