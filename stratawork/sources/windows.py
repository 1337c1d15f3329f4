"""The load window of an overlapping load, its chunks, and the check that rows arrived."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class NoRowsError(RuntimeError):
    """A load without a single row. Raised because nothing downstream would notice."""


def window_bounds(now: datetime | date, days_back: int, start_date: datetime | date) -> tuple[date, date]:
    """The dates to load: the last `days_back` days up to `now`, never before `start_date`."""
    last = now.date() if isinstance(now, datetime) else now
    floor = start_date.date() if isinstance(start_date, datetime) else start_date
    first = max(last - timedelta(days=days_back), floor)
    if first > last:
        raise ValueError(f"empty load window: {first} is after {last}")
    return first, last


def load_window(
    df: DataFrame, date_col: str, now: datetime | date, days_back: int, start_date: datetime | date
) -> DataFrame:
    """The rows of the load window, both end dates included. The bounds are literals, so they reach the scan."""
    first, last = window_bounds(now, days_back, start_date)
    kind = df.schema[date_col].dataType
    lower, upper = F.lit(str(first)).cast(kind), F.lit(str(last + timedelta(days=1))).cast(kind)
    return df.filter((F.col(date_col) >= lower) & (F.col(date_col) < upper))


def date_chunks(spark: SparkSession, start: date, end: date, days: int) -> DataFrame:
    """Chunks of `days` days that cover start..end inclusive; the last one may be shorter."""
    chunks = max(0, ((end - start).days // days) + 1)
    first = F.date_add(F.lit(start), (F.col("id") * days).cast("int"))
    return spark.range(chunks).select(
        F.col("id").cast("int").alias("chunk_nr"),
        first.alias("chunk_start"),
        F.least(F.date_add(first, days - 1), F.lit(end)).alias("chunk_end"),
    )


def chunk_coverage(df: DataFrame, date_col: str, chunks: DataFrame, start: date, days: int) -> DataFrame:
    """Rows per chunk and whether the chunk is empty.

    A row finds its chunk by arithmetic, so the rows are counted per chunk before anything is joined.
    """
    offset = F.datediff(F.col(date_col).cast("date"), F.lit(start))
    counts = (
        df.filter(offset >= 0)
        .groupBy(F.floor(offset / days).cast("int").alias("chunk_nr"), F.col(date_col).cast("date").alias("_day"))
        .agg(F.count("*").alias("_n"))
    )
    # One count per day at most: a row after the last chunk's end must not count for it.
    return (
        chunks.join(counts, "chunk_nr", "left")
        .groupBy("chunk_nr", "chunk_start", "chunk_end")
        .agg(F.coalesce(F.sum(F.when(F.col("_day") <= F.col("chunk_end"), F.col("_n"))), F.lit(0)).alias("rows"))
        .withColumn("is_empty", F.col("rows") == 0)
    )


def require_rows(df: DataFrame, what: str = "load") -> DataFrame:
    """Fail before anything is written when the load has no row at all (action: reads one row)."""
    if df.isEmpty():
        raise NoRowsError(f"{what} has no rows")
    return df
