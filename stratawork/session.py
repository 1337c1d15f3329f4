"""Session settings and shared folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",  # folders of a table are listed by so many tasks
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "stratawork", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library expects; `settings` use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir` where the cluster names one.

    Only a local session may go without it and gets a temporary folder, once per session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = spark.conf.get("spark.stratawork.local.folder", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="stratawork-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.stratawork.local.folder", folder)
    return folder


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one write under the shared folder. Results may read from it until `remove_folders` is called."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def remove_folders(spark: SparkSession) -> int:
    """Delete what was written to the folders this process made: call it once their results have been read."""
    done = 0
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make `DataFrame.checkpoint()` usable without replacing a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
