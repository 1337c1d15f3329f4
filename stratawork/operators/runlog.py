"""Run metadata: execution, node, invocation and freshness rows, and the summary of a run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import blank_to_null, try_int
from ..schemas import METADATA, NODE
from ..sources.documents import read_json_members
from .write import write_table

EXECUTION_KINDS = ("model", "seed", "snapshot", "test")
NODE_KINDS = ("model", "seed", "snapshot", "test", "source", "exposure")

# What each outcome of a node counts as in the summary; anything else was skipped.
OUTCOMES = {
    "model": {"success": "passed", "error": "failed"},
    "test": {"pass": "passed", "fail": "failed", "error": "failed", "warn": "warned"},
    "seed": {"success": "passed"},
}


def _stamp(value: str | datetime | Column) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return value if isinstance(value, Column) else F.lit(value)


def _as_table(df: DataFrame, dataset: str) -> DataFrame:
    """Exactly the columns and types of a metadata table, in its order; a column `df` lacks is NULL."""
    fields = StructType.fromDDL(METADATA[dataset])
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def _valid_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def _phase(name: str, moment: str) -> Column:
    phase = F.filter("timing", lambda t: t["name"] == name)
    # The moments are UTC text with or without a zone mark, which the cast leaves out.
    return F.try_element_at(phase, F.lit(1))[moment].cast("timestamp_ntz")


def execution_rows(
    results: DataFrame,
    kind: str,
    invocation_id: str | Column,
    run_started_at: datetime | Column,
    full_refresh: bool = False,
) -> DataFrame:
    """Run results of one kind of node (model, seed, snapshot, test) as rows of its execution table.

    The start of compilation and the end of execution come out of the timing list; a result without
    them (it was skipped) has NULL there.
    """
    rows = results.filter(F.col("node.resource_type") == kind).select(
        _stamp(invocation_id).alias("command_invocation_id"),
        F.col("node.unique_id").alias("node_id"),
        _stamp(run_started_at).alias("run_started_at"),
        F.coalesce("node.config.full_refresh", F.lit(full_refresh)).alias("was_full_refresh"),
        "thread_id",
        "status",
        _phase("compile", "started_at").alias("compile_started_at"),
        _phase("execute", "completed_at").alias("query_completed_at"),
        F.col("execution_time").alias("total_node_runtime"),
        try_int(F.get_json_object("adapter_response", "$.rows_affected")).alias("rows_affected"),
        "failures",
        F.col("node.config.materialized").alias("materialization"),
        F.col("node.schema").alias("schema"),
        F.col("node.name").alias("name"),
        F.col("node.alias").alias("alias"),
        "message",
        _valid_json(F.col("adapter_response")).alias("adapter_response"),
    )
    return _as_table(rows, f"{kind}_executions")


def node_rows(
    manifest: DataFrame,
    kind: str,
    invocation_id: str | Column,
    run_started_at: datetime | Column,
    with_all_results: bool = True,
) -> DataFrame:
    """The nodes of one kind (model, seed, snapshot, test, source, exposure) of a project manifest as typed rows."""
    group = _GROUPS.get(kind, "nodes")
    nodes = manifest.select(
        _stamp(invocation_id).alias("command_invocation_id"),
        _stamp(run_started_at).alias("run_started_at"),
        F.explode(group).alias("node_id", "all_results"),
    )
    return _typed_nodes(nodes, kind, with_all_results)


_GROUPS = {"source": "sources", "exposure": "exposures"}


def read_manifests(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """Manifest documents, one for each file, member by member: file, document (a variant). A file that is no JSON fails.

    Each row is the document with one node only (`read_json_members`), so that neither a task nor a row holds a whole one.
    With `pieces` the files of a folder are one document.
    """
    return read_json_members(spark, path, pieces).select("file", F.parse_json("document").alias("document"))


def manifest_node_rows(
    manifests: DataFrame,
    kind: str,
    invocation_id: str | Column,
    run_started_at: datetime | Column,
    with_all_results: bool = True,
) -> DataFrame:
    """Like `node_rows`, from whole documents as `read_manifests` gives them.

    Each node is parsed once and becomes a row by a lateral explosion of its variant; they are dealt out before they are
    typed. all_results is the node as compact JSON with its keys in order.
    """
    group = _GROUPS.get(kind, "nodes")
    stamped = manifests.select(
        _stamp(invocation_id).alias("command_invocation_id"), _stamp(run_started_at).alias("run_started_at"),
        F.variant_get("document", f"$.{group}", "variant").alias("_group"),
    )
    each = stamped.lateralJoin(stamped.sparkSession.tvf.variant_explode_outer(F.col("_group").outer()))
    nodes = each.filter("key is not null").select(
        "command_invocation_id", "run_started_at", F.col("key").alias("node_id"), F.to_json("value").alias("all_results")
    )
    return _typed_nodes(nodes.hint("rebalance"), kind, with_all_results)


def _typed_nodes(nodes: DataFrame, kind: str, with_all_results: bool) -> DataFrame:
    """Nodes (command_invocation_id, run_started_at, node_id, all_results) in the columns of their table."""
    nodes = nodes.withColumn("node", F.from_json("all_results", NODE))
    if kind not in _GROUPS:
        nodes = nodes.filter(F.col("node.resource_type") == kind)
    plain = [
        "database", "schema", "name", "package_name", "tags", "alias", "source_name", "loader", "identifier",
        "loaded_at_field", "freshness", "type", "owner", "maturity", "description", "url",
    ]
    path = "test_path" if kind == "test" else "path"
    rows = nodes.select(
        "command_invocation_id",
        "node_id",
        "run_started_at",
        *[F.col(f"node.{name}").alias(name) for name in plain],
        F.col("node.original_file_path").alias(path),
        F.col("node.depends_on.nodes").alias("depends_on_nodes"),
        F.col("node.checksum.checksum").alias("checksum"),
        F.col("node.config.materialized").alias("materialization"),
        F.col("node.config.strategy").alias("strategy"),
        F.col("node.config.meta").alias("meta"),
        (F.col("all_results") if with_all_results else F.lit(None)).alias("all_results"),
    )
    return _as_table(rows, f"{kind}s")


def invocation_rows(invocations: DataFrame) -> DataFrame:
    """Invocations as rows of their table: blank job ids and reasons become NULL, arguments must be JSON."""
    rows = invocations
    for name in ("project_id", "job_id", "run_id", "run_reason_category", "run_reason"):
        if f"dbt_cloud_{name}" in rows.columns:
            rows = rows.withColumn(f"dbt_cloud_{name}", blank_to_null(f"dbt_cloud_{name}"))
    for name in ("env_vars", "dbt_vars", "invocation_args", "dbt_custom_envs"):
        if name in rows.columns:
            rows = rows.withColumn(name, _valid_json(F.col(name)))
    return _as_table(rows, "invocations")


def freshness_rows(
    results: DataFrame, invocation_id: str | Column, run_started_at: datetime | Column
) -> DataFrame:
    """A freshness check as rows of its table."""
    rows = results.withColumn("command_invocation_id", _stamp(invocation_id)).withColumn(
        "run_started_at", _stamp(run_started_at)
    )
    return _as_table(rows.withColumnRenamed("source", "node_id"), "source_freshness")


def metadata_datasets(command: str, has_results: bool = True) -> list[str]:
    """Which tables a command writes: a freshness check only its own, only a run or build the project's nodes."""
    if command == "freshness":
        return ["source_freshness", "invocations"]
    executions = [f"{kind}_executions" for kind in EXECUTION_KINDS] if has_results else []
    return [*executions, "invocations", *([f"{k}s" for k in NODE_KINDS] if command in ("run", "build") else [])]


def append_metadata(df: DataFrame, root: str, dataset: str) -> None:
    """Append rows to a metadata table; the first append creates it (write)."""
    write_table(_as_table(df, dataset), f"{root}/{dataset}", "append")


def _outcome() -> Column:
    outcome = F.lit("skipped")
    for kind, statuses in OUTCOMES.items():
        for status, name in statuses.items():
            outcome = F.when((F.col("resource_type") == kind) & (F.col("status") == status), name).otherwise(outcome)
    return outcome


def run_summary(executions: DataFrame) -> DataFrame:
    """Per resource type (model, test, seed): how many passed, failed, warned and were skipped."""
    counted = executions.filter(F.col("resource_type").isin(*OUTCOMES)).withColumn("outcome", _outcome())
    table = counted.groupBy("resource_type").pivot("outcome", ["passed", "failed", "warned", "skipped"]).count()
    return table.na.fill(0)


def total_runtime(executions: DataFrame, seconds: str = "execution_time") -> DataFrame:
    """Total time as one row, minutes and seconds: rounded once to a tenth, then split."""
    total = F.coalesce(F.sum(F.col(seconds).cast("decimal(18,6)")), F.lit(0))
    rounded = executions.agg(F.round(total, 1).cast("decimal(18,1)").alias("total_seconds"))
    minutes = F.floor(F.col("total_seconds") / 60).cast("bigint")
    return rounded.select(
        "total_seconds",
        minutes.alias("minutes"),
        (F.col("total_seconds") - minutes * 60).cast("decimal(18,1)").alias("seconds"),
    )


def with_outcome(executions: DataFrame, resource_type: str, outcome: str) -> DataFrame:
    """The results of one type with one outcome, such as the failed or warned tests."""
    return executions.filter(F.col("resource_type") == resource_type).filter(_outcome() == outcome)


def slowest(executions: DataFrame, n: int = 5, seconds: str = "execution_time", resource_type: str = "model") -> DataFrame:
    """The n slowest successful nodes; equal times are ordered by name."""
    return with_outcome(executions, resource_type, "passed").orderBy(F.col(seconds).desc(), "name").limit(n)
