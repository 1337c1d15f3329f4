"""Whole models: generated dimensions and the weather chain."""

from .calendar import (
    calendar,
    calendar_dimension,
    date_spine,
    end_year,
    integer_series,
    with_sentinels,
    year_span,
)
from .holidays import holidays
from .pipeline import build_weather, weather_suite
from .time_of_day import day_part, time_dimension, time_of_day

__all__ = [name for name in dir() if not name.startswith("_")]
