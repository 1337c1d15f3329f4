"""Expressions that clean and convert values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scaled(value: Column | str, divisor: str | int | Decimal) -> Column:
    """An integer reading divided by a unit factor, exactly (decimal, not double)."""
    return _col(value).cast("int") / F.lit(Decimal(str(divisor)))


def replace_sentinel(value: Column | str, sentinel: object, replacement: object, otherwise: Column) -> Column:
    """`replacement` where the value is the sentinel, else `otherwise`."""
    return F.when(_col(value) == F.lit(sentinel), F.lit(replacement)).otherwise(otherwise)


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))


def try_int(value: Column | str) -> Column:
    """The text as an int, NULL where it is not one."""
    return _col(value).try_cast("int")


def yes_no(condition: Column) -> Column:
    """'Y' where the condition holds, 'N' where it does not or is unknown."""
    return F.when(condition, "Y").otherwise("N")


def parse_json(text: Column | str) -> Column:
    """The JSON text as a VARIANT, NULL where it does not parse."""
    return F.try_parse_json(_col(text))


def json_text(value: Column) -> Column:
    """A struct, array or map as JSON text; NULL fields stay, timestamps are ISO 8601 to the microsecond."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(value, {"ignoreNullFields": "false", "timestampFormat": iso, "timestampNTZFormat": iso})
