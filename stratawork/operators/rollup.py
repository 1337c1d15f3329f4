"""Roll-ups by day and by calendar period. Every aggregate combines on the map side before the shuffle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import shift_hours
from .evolve import has_files, read_stored
from .joins import join_reference
from .merge import merge_into
from .write import remove_path, write_table


def daily_rollup(
    df: DataFrame, entity: list[str], ts: str, measures: list[Column], shift: int = 0, day: str = "day"
) -> DataFrame:
    """One row per entity and day. `shift=-1` puts an hour-ending timestamp on the day its hour belongs to."""
    moment = shift_hours(ts, shift) if shift else F.col(ts)
    return df.groupBy(*entity, moment.cast("date").alias(day)).agg(*measures)


def calendar_rollup(
    fact: DataFrame,
    calendar: DataFrame,
    key: str,
    by: list[str],
    measures: dict[str, str],
    entity: list[str] = (),
    **join_options: int,
) -> DataFrame:
    """Measures per calendar period, through the calendar key of the fact.

    `measures` maps a column to 'sum', 'min', 'max' or 'count'. These add up, so the fact is first
    aggregated to its calendar key and only the daily totals meet the calendar.
    """
    again = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}
    first = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    names = {column: f"{column}_{how}" for column, how in measures.items()}
    daily = fact.groupBy(*entity, key).agg(*[first[how](c).alias(names[c]) for c, how in measures.items()])
    labelled = join_reference(daily, calendar.select(key, *by), [key], "inner", **join_options)
    return labelled.groupBy(*entity, *by).agg(*[again[how](names[c]).alias(names[c]) for c, how in measures.items()])


def rollup_states(
    df: DataFrame, by: dict[str, Column], measures: dict[str, Column], distinct: dict[str, Column] = {}, load: str = "_load_id"
) -> DataFrame:
    """Mergeable states of a roll-up: its group columns, rows, of each measure count, sum, min and max, and the loads in it.

    A `distinct` expression becomes a sketch of its values. States of parts add up to those of the whole.
    """
    aggregates = [F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set(load)).alias("loads")]
    for name, value in measures.items():
        aggregates += [f(value).alias(f"{name}_{how}") for how, f in _HOW.items()]
    aggregates += [F.hll_sketch_agg(value).alias(f"{name}_sketch") for name, value in distinct.items()]
    return df.groupBy(*[e.alias(c) for c, e in by.items()]).agg(*aggregates)


_HOW = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def _added(states: DataFrame, by: list[str]) -> DataFrame:
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max, "sketch": F.hll_union_agg}
    aggregates = [F.sum("rows").alias("rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("loads")))).alias("loads")]
    for field in states.schema:
        if field.name not in (*by, "rows", "loads"):
            value = again[field.name.rpartition("_")[2]](field.name)
            aggregates.append((value if isinstance(field.dataType, BinaryType) else value.cast(field.dataType)).alias(field.name))
    return states.groupBy(*by).agg(*aggregates).select(*states.columns)


def keep_rollup(spark: SparkSession, path: str, load: DataFrame, by: list[str], partition_by: list[str]) -> None:
    """Add the states of new loads to a stored roll-up (write); only their partitions are read and rewritten.

    `load` is what `rollup_states` gives for the rows of one load or several; earlier rows are not read again. A state
    keeps which loads are in it, so one that is delivered twice adds nothing, be it in part. A load must come whole: rows
    of one load that come later are taken for a repetition. Sums keep their type and fail if they outgrow it.
    """
    if not set(partition_by) <= set(by):
        raise ValueError("the partition columns must be among the group columns")
    if not has_files(spark, path):
        merge_into(spark, path, load, by, ["rows"], partition_by)
        return
    held = read_stored(spark, path)
    delta, kept = f"{path}__delta", [F.col(c).alias(f"_held_{c}") for c in by]
    same = reduce(and_, [load[c].eqNullSafe(F.col(f"_held_{c}")) for c in by])
    ends = load.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in partition_by for f in (F.min, F.max)]).first()
    for c in partition_by:
        held = held.filter(F.col(c).between(F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"])))
    known = held.select(*kept, F.col("loads").alias("_held_loads"))
    fresh = load.join(known, same, "left").filter(
        F.coalesce(F.size(F.array_except("loads", "_held_loads")) == F.size("loads"), F.lit(True))
    )
    write_table(fresh.select(*load.columns), delta, "replace")
    fresh = spark.read.schema(load.schema).parquet(delta)
    touched = held.join(fresh.select(*by), by, "left_semi")
    merge_into(spark, path, _added(touched.select(*load.columns).unionByName(fresh), by), by, ["rows"], partition_by)
    remove_path(spark, delta)


def rollup_values(states: DataFrame) -> DataFrame:
    """What the states say: the group columns, rows, count, sum, min, max and avg of each measure, distinct counts."""
    columns = []
    for field in states.schema:
        name, _, how = field.name.rpartition("_")
        if field.name == "loads":
            continue
        if isinstance(field.dataType, BinaryType):
            columns.append(F.hll_sketch_estimate(field.name).alias(f"{name}_distinct"))
            continue
        columns.append(F.col(field.name))
        if how == "sum" and f"{name}_count" in states.columns:
            columns.append((F.col(field.name) / F.nullif(F.col(f"{name}_count"), F.lit(0))).alias(f"{name}_avg"))
    return states.select(*columns)


def row_count_latest(df: DataFrame, event_ts: str) -> DataFrame:
    """Rows and the latest event, one row."""
    return df.agg(F.count("*").alias("row_count"), F.max(event_ts).alias("latest"))
