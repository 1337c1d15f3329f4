"""Column expressions."""

from .dates import (
    FIRST_SENTINEL,
    LAST_SENTINEL,
    date_simple,
    easter_sunday,
    format_duration,
    hour_ending,
    is_leap_year,
    islamic_date,
    islamic_year,
    iso_week,
    iso_year,
    known_date,
    loaded_at,
    orthodox_easter,
    period_end,
    period_start,
    shift_hours,
    time_from_parts,
    time_simple,
    two_digits,
    utc_now,
    utc_today,
    weekday_nr,
)
from .keys import NULL_TOKEN, hash_key, surrogate_key
from .values import blank_to_null, json_text, parse_json, replace_sentinel, scaled, try_int, yes_no

__all__ = [name for name in dir() if not name.startswith("_")]
