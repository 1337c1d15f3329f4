"""The landing archive: one folder of JSON lines per load, kept as delivered."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import new_folder

LOAD_ID = "_load_id"


def stamp_load(df: DataFrame, load_id: str) -> DataFrame:
    """Mark every row with the load that wrote it: epoch seconds as text, one id per load."""
    return df.withColumn(LOAD_ID, F.lit(load_id))


def land(df: DataFrame, root: str, pipeline: str, load_id: str, compression: str = "none") -> str:
    """Write one load into its own folder `<pipeline>__<load id>` and return the path.

    A folder that is already there is an error: an archived load is never rewritten. The files are as
    many as `df` has partitions; a compressed one is read by one task.
    """
    path = f"{root}/{pipeline}__{load_id}"
    df.write.mode("errorifexists").json(path, compression=compression, ignoreNullFields=False)
    return path


def read_landing(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Landed rows as delivered, typed by the declared schema (no inference pass over the files).

    `path` is one load folder, or a glob such as `<root>/<pipeline>__*` for the whole archive. A
    column that is NULL in every row keeps its declared type; a line that does not parse fails.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


_ENTRIES = "path string, is_folder boolean, size bigint, modified_at timestamp"


def _lister(uri: str, start: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The entries of each folder of a column, as the file system of `uri` lists them."""
        store = fs.FileSystem.from_uri(uri)[0]
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                # A folder that has gone meanwhile has no entries.
                found = store.get_file_info(fs.FileSelector(folder.removeprefix(start), allow_not_found=True))
                found = [x for x in found if not x.base_name.startswith(("_", "."))]
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([start + x.path for x in part], pa.string()), pa.array([x.type == fs.FileType.Directory for x in part]),
                            pa.array([x.size for x in part], pa.int64()), pa.array([x.mtime for x in part], pa.timestamp("us", "UTC")),
                        ],
                        ["path", "is_folder", "size", "modified_at"],
                    )

    return run


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder: path, size, modified_at (write). Names that begin with _ or . are left out.

    Tasks list the folders, one row for each, level by level; each level's entries are written to the shared folder, and
    only whether there are more folders reaches the driver. The folder must be in a file system that pyarrow knows (local,
    hdfs, s3, gs, abfs).
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    uri = re.sub("^file:/+", "file:///", uri)
    path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))[1]
    start = uri.removesuffix(path) if uri.endswith(path) else uri.split("://")[0] + "://"
    folders, files = spark.range(1).select(F.lit(start + path).alias("path")), None
    while True:
        level = new_folder(spark, "listing")
        folders.mapInArrow(_lister(quote(uri, safe=":/@"), start), _ENTRIES).write.parquet(level)
        entries = spark.read.schema(_ENTRIES).parquet(level)
        own = entries.filter("not is_folder").drop("is_folder")
        files = own if files is None else files.unionByName(own)
        folders = entries.filter("is_folder").select("path")
        if folders.isEmpty():
            return files
        folders = folders.repartition("path")


def landing_files(spark: SparkSession, root: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per landed file: path, load id, size in bytes, modification time, and rows if they are given to count.

    The folders are listed by tasks (`walk`), no file is read; empty files and those of a load that has not ended are
    listed too. `rows` is the archive as `read_landing` returns it; it costs a read of every file.
    """
    files = walk(spark, root).select(
        F.regexp_replace("path", "^file:/+", "file:/").alias("path"),
        F.regexp_extract("path", "__([^/]+)/[^/]*$", 1).alias("load_id"), "size", "modified_at",
    )
    if rows is None:
        return files
    plain = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    counts = rows.select(F.url_decode(plain).alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    return files.join(counts, "path", "left").na.fill(0, ["rows"])


def read_landing_split(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Landed rows that parse by the declared schema, and the lines that don't.

    The bad lines: file, block_start (where the block of the file begins that the line was read from), line. A line is bad
    if it is no JSON object or a value does not fit its type; it then gives no row at all, not one with holes. Blank lines
    are neither. Every other line is in exactly one of the two, whichever columns are used later: lines are parsed whole.
    """
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if _CORRUPT in schema.names:
        raise ValueError(f"{_CORRUPT} is the reader's own column")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    row = F.from_json("value", StructType([*schema, StructField(_CORRUPT, StringType())]), options)
    lines = spark.read.text(path).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").alias("line"), row.alias("row"),
    )
    bad = F.coalesce(F.col(f"row.{_CORRUPT}").isNotNull() | F.col("row").isNull(), F.lit(True))
    objects = F.ltrim("line").startswith("{")
    return lines.filter(~bad & objects).select("row.*").drop(_CORRUPT), lines.filter(bad | ~objects).select("file", "block_start", "line")


_CORRUPT = "_corrupt_line"


def quarantine(spark: SparkSession, path: str, schema: StructType | str, target: str) -> DataFrame:
    """Append the bad lines of a landing to the quarantine table and return the good rows (write).

    The bad lines carry file, block_start and the line as it was read, and line_hash to find repeated ones by.
    """
    good, bad = read_landing_split(spark, path, schema)
    bad.withColumn("line_hash", F.xxhash64("line")).write.mode("append").parquet(target)
    return good
