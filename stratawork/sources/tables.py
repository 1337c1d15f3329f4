"""Reading source tables and curated seed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_source(spark: SparkSession, location: str) -> DataFrame:
    """A source table, by catalog name or by Parquet path."""
    if "/" in location:
        return spark.read.parquet(location)
    return spark.table(location)


def read_seed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A curated CSV with declared column types; a blank field is NULL, a field that does not fit fails."""
    return spark.read.csv(
        path, schema=schema, header=True, nullValue="", emptyValue="", mode="FAILFAST", enforceSchema=False
    )
