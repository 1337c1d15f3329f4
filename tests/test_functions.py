from __future__ import annotations

import hashlib
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratawork.functions import (
    blank_to_null,
    date_simple,
    easter_sunday,
    format_duration,
    hash_key,
    hour_ending,
    is_leap_year,
    iso_week,
    iso_year,
    json_text,
    known_date,
    loaded_at,
    parse_json,
    period_end,
    period_start,
    replace_sentinel,
    scaled,
    shift_hours,
    surrogate_key,
    time_from_parts,
    time_simple,
    try_int,
    utc_now,
    utc_today,
    weekday_nr,
    yes_no,
)


def day(text):
    return F.lit(text).cast("date")


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_integer_keys(one):
    assert one(date_simple(day("2024-02-09"))) == 20240209
    assert one(time_simple(ts("2024-02-09 07:08:09.5"))) == 70809
    assert one(time_from_parts(F.lit(7), F.lit(0), F.lit(59))) == "07:00:59"


@pytest.mark.parametrize(
    "text", ["1899-12-27", "1900-01-01", "2000-02-29", "2005-01-01", "2008-12-29", "2010-01-03", "2026-12-31"]
)
def test_iso_parts_match_python(one, text):
    expected = date.fromisoformat(text).isocalendar()
    assert one(iso_year(day(text)), iso_week(day(text)), weekday_nr(day(text))) == tuple(expected)


def test_period_bounds(one):
    d = day("2024-02-29")
    assert [one(period_start(d, u)).isoformat() for u in ("year", "quarter", "month", "week")] == [
        "2024-01-01",
        "2024-01-01",
        "2024-02-01",
        "2024-02-26",
    ]
    assert [one(period_end(d, u)).isoformat() for u in ("year", "quarter", "month", "week")] == [
        "2024-12-31",
        "2024-03-31",
        "2024-02-29",
        "2024-03-03",
    ]
    assert one(known_date(day("9999-12-31"))) is None
    assert one(period_end(known_date(day("9999-12-31")), "year")) is None


@pytest.mark.parametrize("year,leap", [(1900, False), (2000, True), (2023, False), (2024, True), (2100, False)])
def test_leap_years(one, year, leap):
    assert one(yes_no(is_leap_year(F.lit(year)))) == ("Y" if leap else "N")


def test_hour_24_is_the_next_midnight(one):
    assert one(hour_ending(F.lit("2024-12-31"), F.lit(24))) == datetime(2025, 1, 1)
    assert one(hour_ending(F.lit("2024-02-28"), F.lit(1))) == datetime(2024, 2, 28, 1)
    # A landed date may carry a time and a zone mark.
    assert one(hour_ending(F.lit("2024-02-28T00:00:00Z"), F.lit("24"))) == datetime(2024, 2, 29)
    assert one(shift_hours(ts("2024-03-01 00:00:00"), -1)) == datetime(2024, 2, 29, 23)


@pytest.mark.parametrize(
    "seconds,text",
    [(0, "00:00:00"), (59.9, "00:00:59"), (3661, "01:01:01"), (94205, "26:10:05"), (360000, "100:00:00"), (None, None)],
)
def test_durations_grow_past_99_hours(one, seconds, text):
    assert one(format_duration(F.lit(seconds).cast("double"))) == text


def test_clock_is_utc_whatever_the_session_zone(spark, one):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        now, today = one(utc_now(), utc_today())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    real = datetime.now(timezone.utc).replace(tzinfo=None)
    assert abs((real - now).total_seconds()) < 120
    assert abs((real.date() - today).days) <= 1


def test_load_id_keeps_microseconds(one):
    expected = datetime.fromtimestamp(1790329283, timezone.utc).replace(tzinfo=None, microsecond=573185)
    assert one(loaded_at(F.lit("1790329283.5731854"))) == expected
    assert one(loaded_at(F.lit(None).cast("string"))) is None


def test_easter(one):
    known = {1999: (4, 4), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}
    for year, (month, dom) in known.items():
        assert one(easter_sunday(F.lit(year))) == date(year, month, dom)


def test_keys(one):
    assert one(hash_key(F.lit(260))) == hashlib.sha1(b"260").hexdigest()
    assert one(hash_key(F.lit(None).cast("string"))) is None
    text = "260-2024-01-01 01:00:00-T"
    assert one(surrogate_key(F.lit(260), ts("2024-01-01 01:00:00"), F.lit("T"))) == hashlib.md5(text.encode()).hexdigest()
    assert one(surrogate_key(F.lit(None), F.lit("a"))) == hashlib.md5(b"_dbt_utils_surrogate_key_null_-a").hexdigest()
    assert one(surrogate_key(F.lit(""), F.lit("a"))) != one(surrogate_key(F.lit(None), F.lit("a")))


def test_values(one):
    assert one(scaled(F.lit(57), "10.0")) == Decimal("5.7")
    rain = [one(replace_sentinel(F.lit(v).cast("int"), -1, 0.05, F.lit(v).cast("double") / 10)) for v in (-1, 12, None)]
    assert rain == [0.05, 1.2, None]
    assert one(blank_to_null(F.lit("")), blank_to_null(F.lit(" "))) == (None, " ")
    assert one(try_int(F.lit("12")), try_int(F.lit("x")), try_int(F.lit(""))) == (12, None, None)
    assert one(yes_no(F.lit(None).cast("boolean"))) == "N"
    assert one(parse_json(F.lit("{")).isNull(), parse_json(F.lit("[1]")).isNull()) == (True, False)


def test_nested_values_as_json_text(one):
    nested = F.struct(
        F.lit(None).cast("string").alias("none"),
        F.struct(ts("2024-01-02 03:04:05").alias("at")).alias("inner"),
        F.array(F.lit(1), F.lit(2)).alias("list"),
    )
    assert one(json_text(nested)) == '{"none":null,"inner":{"at":"2024-01-02T03:04:05.000000"},"list":[1,2]}'
