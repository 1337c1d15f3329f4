"""Continuous merge load: new files in the landing archive are upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.merge import merge_into


def stream_merge(
    spark: SparkSession,
    landing: str,
    schema: StructType | str,
    target: str,
    keys: list[str],
    order: list[str],
    checkpoint: str,
    partition_by: list[str] = (),
    max_files: int | None = 1000,
    available_now: bool = True,
) -> StreamingQuery:
    """Upsert every landed row into `target`; the newest row of a key by `order` wins (write).

    A micro-batch that is replayed after a failure, or a load that arrives late, leaves the same
    table, because the winner is decided by the load and not by the order of arrival. The state is
    the target itself, so nothing grows in the stream.
    """

    def upsert(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            merge_into(batch.sparkSession, target, batch, keys, order, partition_by, newest_wins=True)

    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("mode", "FAILFAST")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    writer = reader.json(landing).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
