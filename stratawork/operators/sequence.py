"""Dense sequence numbers over the distinct values of a large table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .joins import BROADCAST_BYTES, measured_bytes


def dense_values(df: DataFrame, cols: list[str], start: int = 1, name: str = "sequence_nr") -> DataFrame:
    """The distinct values of `cols` numbered densely in order; NULL sorts first (action: one checkpoint).

    No task sees all values: they are range-partitioned, each range is numbered by itself and
    starts after the rows of the ranges before it. The ranges are fixed by a checkpoint, so a lost
    executor cannot move a value to another range between the count and the numbering.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (
        df.select(*cols).distinct().repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()).checkpoint()
    )
    # One row per range, so this single-task window is as small as the number of ranges.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_range").orderBy(*cols)
    numbered = ranged.withColumn("_row_nr", F.row_number().over(within)).join(F.broadcast(offsets), "_range")
    return numbered.select(*cols, (F.col("_offset") + F.col("_row_nr") + (start - 1)).cast("bigint").alias(name))


def dense_sequence(
    df: DataFrame, cols: list[str], start: int = 1, name: str = "sequence_nr", max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Every row with the dense rank of its `cols` over the whole table, like DENSE_RANK without a partition.

    Rows meet their rank by value: NULL equals NULL, and -0.0 equals 0.0 as it does in a sort.
    """
    values = dense_values(df, cols, start, name)
    side = values.select(*[F.col(c).alias(f"_value_{c}") for c in cols], name)
    same = reduce(and_, [df[c].eqNullSafe(F.col(f"_value_{c}")) for c in cols])
    joined = df.join(F.broadcast(side) if measured_bytes(side) <= max_bytes else side, same, "inner")
    return joined.select(*[df[c] for c in df.columns], name)
