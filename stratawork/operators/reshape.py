"""Wide to long."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_by_codes(
    df: DataFrame,
    ids: list[str],
    columns: dict[str, str],
    codes: list[str],
    code_name: str = "code",
    value_name: str = "value",
    value_type: str = "decimal(10,2)",
) -> DataFrame:
    """One row per input row and code that has a value.

    `columns` maps a code to the column that holds its measure, `codes` is the code table's list; a code that is listed
    twice gives its rows twice, as a join with the code table would. A code without a column yields no rows, nor does a
    column whose code is not in the list. The values are cast to one type; the rows are expanded in place: one scan, no
    shuffle, no join.
    """
    named = [code for code in codes if code in columns]
    pairs = [F.struct(F.lit(code).alias(code_name), F.col(columns[code]).cast(value_type).alias(value_name)) for code in named]
    empty = F.array().cast(f"array<struct<`{code_name}`: string, `{value_name}`: {value_type}>>")
    long = df.select(*ids, F.inline(F.array(*pairs) if pairs else empty))
    return long.filter(F.col(value_name).isNotNull())


def code_list(codes: DataFrame, column: str, known: Iterable[str]) -> list[str]:
    """The codes of a code table that are among the `known` ones, in order (action); so its size is the caller's."""
    rows = codes.filter(F.col(column).isin(list(known))).select(column).orderBy(column).collect()
    return [row[0] for row in rows]
