"""Date, time and duration expressions. All are built-in column expressions on DATE / TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The dates that stand for "no date" at either end of a calendar.
FIRST_SENTINEL = "1900-01-01"
LAST_SENTINEL = "9999-12-31"


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def date_simple(date: ColumnOrName) -> Column:
    """YYYYMMDD as an int, the key of the calendar dimension."""
    d = _col(date)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def time_simple(ts: ColumnOrName) -> Column:
    """HHMMSS as an int, the key of the time-of-day dimension."""
    t = _col(ts)
    return (F.hour(t) * 10000 + F.minute(t) * 100 + F.second(t)).cast("int")


def two_digits(number: ColumnOrName) -> Column:
    return F.lpad(_col(number).cast("string"), 2, "0")


def time_from_parts(hour: ColumnOrName, minute: ColumnOrName, second: ColumnOrName) -> Column:
    """HH:MM:SS text. The TIME type is off by default in Spark, so a time travels as text plus `time_simple`."""
    return F.concat_ws(":", two_digits(hour), two_digits(minute), two_digits(second))


def iso_week(date: ColumnOrName) -> Column:
    return F.weekofyear(_col(date))


def iso_year(date: ColumnOrName) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _col(date)).cast("int")


def weekday_nr(date: ColumnOrName) -> Column:
    """1 = Monday .. 7 = Sunday, whatever the session's week settings; right before 1900 too."""
    days = F.datediff(_col(date), F.to_date(F.lit(FIRST_SENTINEL)))
    return (F.pmod(days, F.lit(7)) + 1).cast("int")


def known_date(date: ColumnOrName) -> Column:
    """The date, or NULL for the last sentinel, which has no next day to compute with."""
    return F.nullif(_col(date), F.to_date(F.lit(LAST_SENTINEL)))


_MONTHS = {"year": 12, "quarter": 3, "month": 1}


def period_start(date: ColumnOrName, unit: str) -> Column:
    """First date of the year, quarter, month or week."""
    if unit == "week":
        return F.date_add(_col(date), 1 - weekday_nr(date))
    return F.trunc(_col(date), unit)


def period_end(date: ColumnOrName, unit: str) -> Column:
    """Last date of the year, quarter, month or week."""
    if unit == "week":
        return F.date_add(_col(date), 7 - weekday_nr(date))
    return F.date_sub(F.add_months(period_start(date, unit), _MONTHS[unit]), 1)


def is_leap_year(year: ColumnOrName) -> Column:
    y = _col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def shift_hours(ts: ColumnOrName, hours: ColumnOrName | int) -> Column:
    """A timestamp moved by whole hours; stays TIMESTAMP_NTZ."""
    n = F.lit(hours) if isinstance(hours, int) else _col(hours)
    return F.timestamp_add("HOUR", n, _col(ts))


def hour_ending(date: ColumnOrName, hour: ColumnOrName) -> Column:
    """The end of hour 1..24 of a date: hour 24 is midnight of the next day."""
    return shift_hours(_col(date).cast("date").cast("timestamp_ntz"), _col(hour).cast("int"))


def utc_now() -> Column:
    """Now in UTC as TIMESTAMP_NTZ, whatever the session time zone."""
    return F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())


def utc_today() -> Column:
    return utc_now().cast("date")


def format_duration(seconds: ColumnOrName) -> Column:
    """Seconds as HH:MM:SS. Hours have at least two digits and are never cut; NULL stays NULL."""
    whole = F.floor(_col(seconds)).cast("bigint")
    hours = F.floor(whole / 3600).cast("string")
    padded = F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours)
    minutes = F.floor(F.pmod(whole, F.lit(3600)) / 60)
    return F.when(
        whole.isNotNull(), F.concat_ws(":", padded, two_digits(minutes), two_digits(F.pmod(whole, F.lit(60))))
    )


def loaded_at(load_id: ColumnOrName) -> Column:
    """The moment of a load from its id, epoch seconds as text; kept to the microsecond, in UTC."""
    micros = (_col(load_id).cast("decimal(20,6)") * 1000000).cast("bigint")
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def easter_sunday(year: ColumnOrName) -> Column:
    """Western Easter, by the Gregorian computus (Meeus, Jones, Butcher) in integer columns."""
    y = _col(year)

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b)

    golden = y % 19
    century, in_century = div(y, 100), y % 100
    correction = div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - div(century, 4) - correction + 15) % 30
    weekday = (century % 4 * 2 + div(in_century, 4) * 2 - epact - in_century % 4 + 32) % 7
    late = div(golden + epact * 11 + weekday * 22, 451)
    days_after_march_1 = epact + weekday - late * 7 + 21
    return F.date_add(F.make_date(y, F.lit(3), F.lit(1)), days_after_march_1.cast("int"))


def orthodox_easter(year: ColumnOrName) -> Column:
    """Easter of the Julian computus as a date of the Gregorian calendar."""
    y = _col(year)
    moon = (y % 19 * 19 + 15) % 30
    days_after_march_21 = moon + (y % 4 * 2 + y % 7 * 4 - moon + 34) % 7 + 1
    behind = F.floor(y / 100) - F.floor(y / 400) - 2  # days that the Julian calendar is behind in March
    return F.date_add(F.make_date(y, F.lit(3), F.lit(21)), (days_after_march_21 + behind).cast("int"))


#: The first day of the Islamic calendar (16 July 622, Julian) counted from 1970-01-01, and the days of 30 years.
ISLAMIC_EPOCH, ISLAMIC_CYCLE = -492_148, 10_631


def islamic_year(date: ColumnOrName) -> Column:
    """Year of the tabular Islamic calendar in which a date falls."""
    days = F.unix_date(_col(date)).cast("bigint") - ISLAMIC_EPOCH
    return F.floor((days * 30 + ISLAMIC_CYCLE + 15) / ISLAMIC_CYCLE)


def islamic_date(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName) -> Column:
    """A day of the tabular Islamic calendar as a date: months of 30 and 29 days by turns, 11 leap years in 30.

    The tables run up to a day or two before or after a sighting of the moon.
    """
    y, m, d = _col(year), _col(month), _col(day)
    days = (y - 1) * 354 + F.floor((y * 11 + 3) / 30) + (m - 1) * 29 + F.floor(m / 2) + d - 1
    return F.date_from_unix_date((days + ISLAMIC_EPOCH).cast("int"))
