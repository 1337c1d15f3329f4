"""Typed staging: pick columns, rename and cast them in one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def typed(df: DataFrame, spec: list[tuple[str, str, str]]) -> DataFrame:
    """`[(source column, name, type)]` as one explicit projection; columns not listed are not read.

    A `varchar(n)` or `char(n)` type cuts the text to its width, which a plain cast does not.
    """
    columns = []
    for source, name, kind in spec:
        width = kind.lower().replace("varchar", "char")
        if width.startswith("char("):
            column = F.substring(F.col(source).cast("string"), 1, int(width[5:-1]))
        else:
            column = F.col(source).cast(kind)
        columns.append(column.alias(name))
    return df.select(*columns)


def describe_columns(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach a description to columns; it is saved with the table and shown by DESCRIBE."""
    unknown = set(comments) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    for name, comment in comments.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": comment})
    return df
