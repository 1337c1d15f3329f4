"""Keyed merge load: latest row per key, upsert, and writing it into a partitioned Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType, VariantType

from .evolve import digits, fitted, has_files, record_columns, recorded_columns, stored_columns
from .write import move_partitions, move_path, path_exists, remove_path, write_table


def _descending(df: DataFrame, keys: list[str], order: list[str | Column]) -> list[Column]:
    """The wanted order, newest first, then every other column, so equal loads always pick the same row."""
    wanted = [F.col(o).desc() if isinstance(o, str) else o for o in order]
    named = {*keys, *[o for o in order if isinstance(o, str)]}
    rest = [
        F.col(f.name).desc()
        for f in df.schema
        if f.name not in named and not isinstance(f.dataType, (MapType, VariantType))
    ]
    return wanted + rest


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first by `order` (names sort descending).

    Spark limits each group to one row before the shuffle, so a hot key costs one row per input
    partition, not a task that holds the whole group.
    """
    ranked = Window.partitionBy(*keys).orderBy(*_descending(df, keys, order))
    return df.withColumn("_row_nr", F.row_number().over(ranked)).filter("_row_nr = 1").drop("_row_nr")


def merge_upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The existing rows with the batch upserted: a key of the batch replaces the existing row.

    Only the batch is deduplicated; the existing table has one row per key already. A batch whose
    keys are small enough is broadcast by Spark and the existing rows are not shuffled at all.
    """
    untouched = existing.join(batch.select(*keys).distinct(), keys, "left_anti")
    return untouched.unionByName(latest_per_key(batch, keys, order))


def merge_latest(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Like `merge_upsert`, but the newest row by `order` wins on either side.

    The outcome does not depend on the order in which loads arrive or on how often one is replayed.
    """
    return latest_per_key(existing.unionByName(batch), keys, order)


def _table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _stored_schema(schema: StructType, partition_by: list[str]) -> StructType:
    """The columns as a read of the table returns them: partition columns last."""
    return StructType([f for f in schema if f.name not in partition_by] + [schema[c] for c in partition_by])


def _with_keys(df: DataFrame, keys: list[str], partition_by: list[str]) -> DataFrame:
    """The rows, failing the job on the first one whose key is NULL or whose partition is blank.

    Such a row could never be merged again: a blank text is stored as the NULL partition.
    """
    checked = df.withColumns({k: F.coalesce(k, F.raise_error(F.lit(f"merge key {k} is NULL"))) for k in keys})
    texts = [c for c in partition_by if isinstance(df.schema[c].dataType, StringType)]
    blank = {c: F.when(F.col(c) == "", F.raise_error(F.lit(f"partition key {c} is blank"))).otherwise(F.col(c)) for c in texts}
    return checked.withColumns(blank)


def _touched(existing: DataFrame, batch: DataFrame, partition_by: list[str]) -> DataFrame:
    """The rows in partitions that the batch writes to: a literal range prunes the scan, a semi-join does the rest."""
    ends = batch.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in partition_by for f in (F.min, F.max)]).first()
    for c in partition_by:
        existing = existing.filter(F.col(c).between(F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"])))
    return existing.join(batch.select(*partition_by).distinct(), partition_by, "left_semi")


def _publish(spark: SparkSession, path: str, partition_by: list[str], whole: bool = False) -> None:
    """Move what is staged into the table: partition by partition, or as a whole. Doing it twice gives the same table.

    A whole table is staged in a folder of its own, so moves that were cut off are finished as what they were.
    """
    folder = f"{path}__refresh" if whole else f"{path}__staging"
    if partition_by and not whole:
        move_partitions(spark, folder, path, len(partition_by))
        remove_path(spark, folder)
    else:
        remove_path(spark, path)
        move_path(spark, folder, path)
    spark.catalog.refreshByPath(path)


def _finish_pending(spark: SparkSession, path: str, partition_by: list[str]) -> None:
    """Finish moves that were cut off: what is still staged is complete."""
    for folder, whole in ((f"{path}__staging", False), (f"{path}__refresh", True)):
        if path_exists(spark, f"{folder}/_SUCCESS"):
            _publish(spark, path, partition_by, whole)


def merge_into(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: list[str],
    order: list[str | Column],
    partition_by: list[str] = (),
    newest_wins: bool = False,
) -> None:
    """Upsert a batch into the Parquet table at `path` (write).

    The batch is read and deduplicated once, into `<path>__batch`. Only the partitions it touches are read from the table
    and written anew, to `<path>__staging`, and moved into place from there. So a job that dies on the way never loses
    rows: before the moves the table is untouched, and moves that were cut off are finished by the next merge.
    The partition columns must be part of the key, or a moved row would leave its old copy behind. A key must not be NULL,
    a partition column not blank. The table keeps columns that the batch lacks (NULL in the batch's own rows) and takes on
    columns that are new. A column that comes in another type is promoted, or its misfits go to a side column (see
    `fitted`); files of untouched partitions stay as they are. The table's columns are recorded beside it: `read_stored`
    reads them, as does any read with that schema declared. A table without rows keeps its columns and can be merged into.
    `newest_wins` compares both sides by `order` instead of letting the batch win; order columns may then only widen.
    """
    partition_by = list(partition_by)
    if not set(partition_by) <= set(keys):
        raise ValueError("the partition columns must be part of the key")
    _finish_pending(spark, path, partition_by)
    stored = stored_columns(spark, path)
    named = [o for o in order if isinstance(o, str)] if newest_wins else []
    kept = StructType() if stored is None else stored
    if recorded_columns(spark, path) is None:  # a folder's name does not tell text from numbers
        kept = StructType([batch.schema[f.name] if f.name in partition_by else f for f in kept])
    batch, whole = fitted(batch, kept, [*keys, *partition_by, *named])
    for c in partition_by:
        if c in kept.names and whole[c].dataType != kept[c].dataType and digits(whole[c].dataType) is None:
            raise ValueError(f"partition column {c} is stored as {kept[c].dataType.simpleString()}")
    whole = _stored_schema(whole, partition_by)
    latest = latest_per_key(_with_keys(batch, keys, partition_by), keys, order)
    absent = {f.name: F.lit(None).cast(f.dataType) for f in whole if f.name not in batch.columns}
    latest = latest.withColumns(absent).select(*whole.names)
    if not has_files(spark, path):
        write_table(latest, f"{path}__staging", "replace", partition_by, spread=True)
        record_columns(spark, f"{path}__staging", whole)
        _publish(spark, path, [])
        return
    write_table(latest, f"{path}__batch", "replace")
    staged = _table(spark, f"{path}__batch", whole)
    existing = _table(spark, path, whole)
    if partition_by:
        existing = _touched(existing, staged, partition_by)
    if newest_wins:
        merged = merge_latest(existing, staged, keys, order)
    else:
        # One row per key already. Spark knows the size of the staged keys and broadcasts them if they are few.
        merged = existing.join(staged.select(*keys), keys, "left_anti").unionByName(staged)
    write_table(merged, f"{path}__staging", "replace", partition_by, spread=True)
    # Into the table before its files, as the wider columns read the older files too; with them where all are replaced.
    record_columns(spark, path if partition_by else f"{path}__staging", whole)
    _publish(spark, path, partition_by)
    remove_path(spark, f"{path}__batch")


def full_refresh(
    spark: SparkSession,
    path: str,
    batch: DataFrame,
    keys: list[str],
    order: list[str | Column],
    partition_by: list[str] = (),
    replay_from: DataFrame | None = None,
) -> None:
    """Drop what the table holds and load it again (write).

    Rows older than the batch's window are gone, unless `replay_from` brings the whole archive back.
    The new rows are complete in `<path>__refresh` before the old ones are dropped, so a load that
    fails leaves the table as it was.
    """
    partition_by = list(partition_by)
    rows = batch if replay_from is None else replay_from.unionByName(batch)
    schema = _stored_schema(rows.schema, partition_by)
    latest = latest_per_key(_with_keys(rows.select(*schema.names), keys, partition_by), keys, order)
    _finish_pending(spark, path, partition_by)
    write_table(latest, f"{path}__refresh", "replace", partition_by, spread=True)
    record_columns(spark, f"{path}__refresh", schema)
    _publish(spark, path, partition_by, whole=True)
