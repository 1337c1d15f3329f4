"""Freshness, change detection and run metadata; the events serve as the logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    affected_partitions,
    append_metadata,
    change_set_key,
    changed_sources,
    execution_rows,
    freshness,
    freshness_rows,
    freshness_status,
    invocation_rows,
    last_success_start,
    latest_observation,
    manifest_node_rows,
    node_rows,
    observations,
    read_manifests,
    Step,
    read_stored,
    recompute_chain,
    recompute_partitions,
    run_summary,
    slowest,
    stored_freshness,
    total_runtime,
    with_outcome,
    write_table,
)
from ..schemas import METADATA
from ..session import new_folder
from .inputs import number_of
from .registry import query, read

NOW = datetime(2024, 2, 1, 12)
STARTED = datetime(2024, 2, 1, 6)

STATUS = """
CASE WHEN max_loaded_at IS NULL THEN 'runtime error'
     WHEN max_loaded_at < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 7 DAY THEN 'error'
     WHEN max_loaded_at < TIMESTAMP '2024-02-01 12:00:00' - INTERVAL 48 HOUR THEN 'warn' ELSE 'pass' END
"""
FRESHNESS = f"""
TIMESTAMP '2024-02-01 12:00:00' AS snapshotted_at,
CAST(date_diff('microsecond', max_loaded_at, TIMESTAMP '2024-02-01 12:00:00') AS DOUBLE) / 1000000 AS age_seconds,
{STATUS} AS status
"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    orders = read(spark, sf_dir, "orders")
    return freshness(
        {
            "shop.events": (events, F.col("ts")),
            "shop.orders": (orders, F.col("o_orderdate")),
            "shop.returns": (orders.filter("o_totalprice < 0"), F.col("o_orderdate")),
            "shop.documents": (read(spark, sf_dir, "documents"), None),
        },
        NOW,
    )


SOURCES = """
latest AS (
  SELECT 'shop.events' AS source, max(ts) AS max_loaded_at FROM events
  UNION ALL SELECT 'shop.orders', max(o_orderdate) FROM orders
  UNION ALL SELECT 'shop.returns', max(o_orderdate) FROM orders WHERE o_totalprice < 0
)
"""


@query(f"WITH {SOURCES} SELECT source, max_loaded_at, {FRESHNESS} FROM latest")
def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age and status per source; one is empty and one has no loaded-at column and is skipped."""
    return _sources(spark, sf_dir)


@query(f"""
WITH latest AS (SELECT 'shop.events' AS source, max(ts) AS max_loaded_at FROM events
  UNION ALL SELECT 'shop.orders', max(o_orderdate) FROM orders UNION ALL SELECT 'shop.lines', max(l_shipdate) FROM lineitem)
SELECT source, max_loaded_at, {FRESHNESS} FROM latest
""")
def source_freshness_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of tables as written, from the footers of their files."""
    tables = {"shop.events": ("events", "ts"), "shop.orders": ("orders", "o_orderdate"), "shop.lines": ("lineitem", "l_shipdate")}
    return stored_freshness(spark, {source: (f"{sf_dir}/{table}.parquet", column) for source, (table, column) in tables.items()}, NOW)


@query(f"""
WITH latest AS (SELECT 'user ' || user_id AS source, max(ts) AS max_loaded_at FROM events GROUP BY 1)
SELECT source, max_loaded_at, {FRESHNESS} FROM latest
""")
def user_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of many sources that share a table, by group."""
    latest = (
        read(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source"))
        .agg(F.max("ts").alias("max_loaded_at"))
    )
    return freshness_status(latest, NOW)


@query(f"""
WITH {SOURCES}
SELECT source, max_loaded_at, TIMESTAMP '2024-02-01 12:00:00' AS observed_at FROM latest WHERE max_loaded_at IS NOT NULL
""")
def freshness_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check adds to the observation log."""
    return observations(_sources(spark, sf_dir))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation per event: the source is the user, low values could not be queried."""
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("source.shop.u"), F.col("user_id").cast("string")).alias("source"),
        F.when(F.col("value") >= 20, F.date_trunc("DAY", "ts").cast("timestamp_ntz")).alias("max_loaded_at"),
        F.col("ts").alias("observed_at"),
        "event_id",
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per event: the job is the type, high values succeed."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("job"),
        F.when(F.col("value") >= 100, "SUCCESS").otherwise("FAILURE").alias("status"),
        F.col("ts").alias("start_time"),
    )


LOG = """
log AS (
  SELECT 'source.shop.u' || user_id AS source,
         CASE WHEN value >= 20 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS max_loaded_at,
         ts AS observed_at, event_id
  FROM events
)
"""
CHANGED = f"""
{LOG},
since AS (SELECT max(ts) AS s FROM events WHERE event_type = 'error' AND value >= 100),
latest AS (
  SELECT source, max_loaded_at FROM log
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY observed_at DESC, event_id DESC) = 1
),
built AS (
  SELECT source, max_loaded_at FROM log, since WHERE observed_at < s
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY observed_at DESC, event_id DESC) = 1
),
changed AS (
  SELECT l.source, l.max_loaded_at FROM latest l LEFT JOIN built b USING (source)
  WHERE l.max_loaded_at IS NOT NULL AND l.max_loaded_at IS DISTINCT FROM b.max_loaded_at
)
"""


@query(f"""
WITH {LOG}
SELECT source, max_loaded_at FROM
  (SELECT source, max_loaded_at FROM log WHERE observed_at < TIMESTAMP '2024-01-15 00:00:00'
   QUALIFY row_number() OVER (PARTITION BY source ORDER BY observed_at DESC, event_id DESC) = 1)
WHERE max_loaded_at IS NOT NULL
""")
def latest_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value per source before a moment; a NULL that is latest drops the source."""
    return latest_observation(_log(spark, sf_dir), datetime(2024, 1, 15), ["event_id"])


@query("SELECT max(ts) AS last_success_start FROM events WHERE event_type = 'error' AND value >= 100")
def last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The start of the latest successful run of a job."""
    return last_success_start(_runs(spark, sf_dir), "error")


@query(f"WITH {CHANGED} SELECT * FROM changed")
def changed_since_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that moved since the last successful run of the job."""
    return changed_sources(_log(spark, sf_dir), _runs(spark, sf_dir), "error", ["event_id"])


@query("""
WITH changed AS (SELECT 'shop.' || event_type AS source, max(ts) AS max_loaded_at FROM events GROUP BY 1)
SELECT string_agg(source || '@' || strftime(max_loaded_at, '%Y-%m-%d %H:%M:%S.%f'), '|' ORDER BY source)
  AS change_set_key FROM changed
""")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five event types as changed sources, in one key."""
    changed = (
        read(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("shop."), "event_type").alias("source"))
        .agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("max_loaded_at"))
    )
    return change_set_key(changed)


@query("""
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE ts > TIMESTAMP '2024-01-27 18:00:00'
""")
def affected_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user days that got newer events."""
    events = read(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    return affected_partitions(events, "ts", datetime(2024, 1, 27, 18), ["user_id", "day"])


@query("""
SELECT CAST(ts AS DATE) AS day, event_type,
       CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-27' THEN CAST(count(*) AS BIGINT) ELSE 0 END AS events
FROM events GROUP BY 1, 2
""")
def recomputed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stale daily table of zeros, of which only the days with newer events are built again."""
    path = new_folder(spark, "recomputed")
    events = read(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))

    def model(rows: DataFrame) -> DataFrame:
        return rows.groupBy("event_type", "day").agg(F.count("*").alias("events"))

    write_table(model(events).withColumn("events", F.lit(0).cast("bigint")), path, "replace", ["day"])
    recompute_partitions(spark, events, "ts", datetime(2024, 1, 27, 18), ["day"], model, path)
    return spark.read.schema("event_type string, events bigint, day date").parquet(path)


@query("""
SELECT day, event_type, CASE WHEN day IS NULL OR day >= DATE '2024-01-27' THEN CAST(count(*) AS BIGINT) ELSE 0 END AS events
FROM (SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, event_type FROM events)
WHERE day IS NULL OR day != DATE '2024-01-28'
GROUP BY 1, 2
""")
def recomputed_odd_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days built again, of which one is NULL and another one has nothing left."""
    path = new_folder(spark, "recomputed")
    day = F.when(F.col("user_id") % 5 != 0, F.col("ts").cast("date"))
    events = read(spark, sf_dir, "events").withColumn("day", day)

    def model(rows: DataFrame) -> DataFrame:
        kept = rows.filter("day is null or day != date'2024-01-28'")
        return kept.groupBy("event_type", "day").agg(F.count("*").alias("events"))

    old = events.groupBy("event_type", "day").agg(F.lit(0).cast("bigint").alias("events"))
    write_table(old, path, "replace", ["day"])
    recompute_partitions(spark, events, "ts", datetime(2024, 1, 27, 18), ["day"], model, path)
    return spark.read.schema("event_type string, events bigint, day date").parquet(path)


def _status_of(kind: Column) -> Column:
    value = F.col("value")
    test = (
        F.when(value < 2, "fail").when(value < 4, "error").when(value < 8, "warn").when(value < 10, "skipped")
    ).otherwise("pass")
    return F.when(kind == "test", test).otherwise(
        F.when(value < 3, "error").when(value < 6, "skipped").otherwise("success")
    )


# Event type -> kind of node.
KINDS = {"click": "model", "error": "model", "purchase": "seed", "view": "test", "signup": "snapshot"}


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An execution per event: what kind of node it was, how it ended and how long it took."""
    kind = F.lit(None)
    for event_type, node_kind in KINDS.items():
        kind = F.when(F.col("event_type") == event_type, node_kind).otherwise(kind)
    return read(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        kind.alias("resource_type"),
        _status_of(kind).alias("status"),
        F.col("value").alias("execution_time"),
        F.concat(F.lit("node_"), F.col("event_id").cast("string")).alias("name"),
        number_of().alias("k"),
    )


EXECUTIONS = """
kinds AS (
  SELECT *, CASE event_type WHEN 'click' THEN 'model' WHEN 'error' THEN 'model' WHEN 'purchase' THEN 'seed'
            WHEN 'view' THEN 'test' ELSE 'snapshot' END AS resource_type FROM events
),
executions AS (
  SELECT event_id, ts, resource_type, value AS execution_time, 'node_' || event_id AS name,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN resource_type = 'test' THEN
                CASE WHEN value < 2 THEN 'fail' WHEN value < 4 THEN 'error' WHEN value < 8 THEN 'warn'
                     WHEN value < 10 THEN 'skipped' ELSE 'pass' END
              ELSE CASE WHEN value < 3 THEN 'error' WHEN value < 6 THEN 'skipped' ELSE 'success' END END AS status
  FROM kinds
)
"""


@query(f"""
WITH {EXECUTIONS}
SELECT resource_type,
       count(*) FILTER ((resource_type = 'test' AND status = 'pass') OR status = 'success') AS passed,
       count(*) FILTER (resource_type <> 'seed' AND status IN ('error', 'fail')) AS failed,
       count(*) FILTER (resource_type = 'test' AND status = 'warn') AS warned,
       count(*) FILTER (status = 'skipped' OR (resource_type = 'seed' AND status = 'error')) AS skipped
FROM executions WHERE resource_type IN ('model', 'test', 'seed') GROUP BY 1
""")
def run_summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many models, tests and seeds passed, failed, warned and were skipped."""
    return run_summary(_executions(spark, sf_dir))


@query("""
WITH r AS (SELECT CAST(round(sum(CAST(value AS DECIMAL(18,6))), 1) AS DECIMAL(18,1)) AS total_seconds FROM events)
SELECT total_seconds, CAST(floor(total_seconds / 60) AS BIGINT) AS minutes,
       CAST(total_seconds - CAST(floor(total_seconds / 60) AS BIGINT) * 60 AS DECIMAL(18,1)) AS seconds FROM r
""")
def run_total_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total time of the run, rounded once and then split."""
    return total_runtime(_executions(spark, sf_dir))


@query(f"WITH {EXECUTIONS} SELECT * FROM executions WHERE resource_type = 'test' AND status IN ('fail', 'error')")
def failed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests that failed."""
    return with_outcome(_executions(spark, sf_dir), "test", "failed")


@query(f"WITH {EXECUTIONS} SELECT * FROM executions WHERE resource_type = 'model' AND status = 'error'")
def failed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that failed."""
    return with_outcome(_executions(spark, sf_dir), "model", "failed")


@query(f"WITH {EXECUTIONS} SELECT * FROM executions WHERE resource_type = 'test' AND status = 'warn'")
def warned_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tests that warned."""
    return with_outcome(_executions(spark, sf_dir), "test", "warned")


@query(f"""
WITH {EXECUTIONS}
SELECT * FROM executions WHERE resource_type = 'model' AND status = 'success'
ORDER BY execution_time DESC, name LIMIT 5
""")
def slowest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five slowest successful models."""
    return slowest(_executions(spark, sf_dir))


@query(f"""
WITH {EXECUTIONS}
SELECT resource_type, status, CAST(count(*) AS BIGINT) AS results,
       CAST(sum(CAST(execution_time AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS seconds
FROM executions GROUP BY 1, 2
""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and time per resource type and status."""
    seconds = F.sum(F.col("execution_time").cast("decimal(12,2)")).alias("seconds")
    return _executions(spark, sf_dir).groupBy("resource_type", "status").agg(F.count("*").alias("results"), seconds)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run results in the shape they are read in: skipped nodes have no timing, some have no row count."""

    def moment(seconds: int) -> Column:
        return F.date_format(F.timestamp_add("SECOND", F.lit(seconds), F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def phase(name: str, start: int) -> Column:
        names = (F.lit(name).alias("name"), moment(start).alias("started_at"), moment(start + 2).alias("completed_at"))
        return F.struct(*names)

    timing = F.when(F.col("status") != "skipped", F.array(phase("compile", 0), phase("execute", 2)))
    rows = _executions(spark, sf_dir)
    node = F.struct(
        F.concat_ws(".", "resource_type", F.lit("shop"), "name").alias("unique_id"),
        "resource_type",
        F.lit("_MRT").alias("schema"),
        "name",
        F.col("name").alias("alias"),
        F.struct(
            F.lit("table").alias("materialized"), F.when(F.col("k") > 90, True).alias("full_refresh")
        ).alias("config"),
    )
    affected = F.when(F.col("k") % 5 != 0, F.col("k").cast("string")).otherwise("n/a").alias("rows_affected")
    return rows.select(
        "status",
        F.lit("Thread-1").alias("thread_id"),
        "execution_time",
        F.concat(F.lit("it's "), "status").alias("message"),
        F.when(F.col("resource_type") == "test", F.col("k").cast("int")).alias("failures"),
        F.to_json(F.struct(affected)).alias("adapter_response"),
        timing.alias("timing"),
        node.alias("node"),
    )


def _execution_sql(kind: str) -> str:
    tail = (
        "CAST(k AS INTEGER) AS failures"
        if kind == "test"
        else "'table' AS materialization, '_MRT' AS schema, name, name AS alias"
    )
    return f"""
    WITH {EXECUTIONS}
    SELECT 'inv-1' AS command_invocation_id, resource_type || '.shop.' || name AS node_id,
           TIMESTAMP '2024-02-01 06:00:00' AS run_started_at, k > 90 AS was_full_refresh, 'Thread-1' AS thread_id, status,
           CASE WHEN status <> 'skipped' THEN ts END AS compile_started_at,
           CASE WHEN status <> 'skipped' THEN ts + INTERVAL 4 SECOND END AS query_completed_at,
           execution_time AS total_node_runtime, CAST(CASE WHEN k % 5 <> 0 THEN k END AS INTEGER) AS rows_affected,
           {tail}, 'it''s ' || status AS message,
           '{{"rows_affected":"' || CASE WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) ELSE 'n/a' END || '"}}' AS adapter_response
    FROM executions WHERE resource_type = '{kind}'
    """


@query(_execution_sql("model"))
def model_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution_rows(_results(spark, sf_dir), "model", "inv-1", STARTED)


@query(_execution_sql("seed"))
def seed_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution_rows(_results(spark, sf_dir), "seed", "inv-1", STARTED)


@query(_execution_sql("snapshot"))
def snapshot_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution_rows(_results(spark, sf_dir), "snapshot", "inv-1", STARTED)


@query(_execution_sql("test"))
def test_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execution_rows(_results(spark, sf_dir), "test", "inv-1", STARTED)


@query(f"{_execution_sql('model')} UNION ALL SELECT * FROM ({_execution_sql('model')})")
def appended_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the metadata table of model executions."""
    root = new_folder(spark, "metadata")
    for _ in range(2):
        append_metadata(execution_rows(_results(spark, sf_dir), "model", "inv-1", STARTED), root, "model_executions")
    return spark.read.schema(METADATA["model_executions"]).parquet(f"{root}/model_executions")


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small manifest per part: one node whose kind depends on the size, one source, one exposure."""
    size = F.col("p_size")
    kind = F.when(size <= 20, "model").when(size <= 30, "seed").when(size <= 40, "snapshot").otherwise("test")
    key = F.col("p_partkey").cast("string")
    node = F.format_string(
        '{"unique_id":"%s.shop.n%s","resource_type":"%s","database":"DB","schema":"_MRT","name":"n%s","alias":"a%s",'
        '"package_name":"shop","original_file_path":"models/n%s.sql","tags":["%s"],'
        '"depends_on":{"nodes":["source.shop.s%s"]},"checksum":{"checksum":"c%s"},'
        '"config":{"materialized":"table","strategy":"check","meta":{"size":%d}}}',
        kind, key, kind, key, key, key, "p_brand", key, key, size,
    )
    source = F.format_string(
        '{"unique_id":"source.shop.s%s","database":"DB","schema":"_SRC","name":"s%s","source_name":"shop",'
        '"loader":"files","identifier":"shop__s%s","loaded_at_field":"_load_id","freshness":{"warn_after":%d}}',
        key, key, key, size,
    )
    exposure = F.format_string(
        '{"unique_id":"exposure.shop.e%s","name":"e%s","type":"dashboard","owner":{"name":"%s"},"maturity":"high",'
        '"original_file_path":"exposures/e%s.yml","description":"%s","url":"http://shop/%s","package_name":"shop",'
        '"depends_on":{"nodes":["model.shop.n%s"]},"tags":[]}',
        key, key, "p_brand", key, "p_name", key, key,
    )
    return read(spark, sf_dir, "part").select(
        F.create_map(F.concat(kind, F.lit(".shop.n"), key), node).alias("nodes"),
        F.create_map(F.concat(F.lit("source.shop.s"), key), source).alias("sources"),
        F.create_map(F.concat(F.lit("exposure.shop.e"), key), exposure).alias("exposures"),
    )


MANIFEST = """
parts AS (
  SELECT *, CASE WHEN p_size <= 20 THEN 'model' WHEN p_size <= 30 THEN 'seed' WHEN p_size <= 40 THEN 'snapshot'
            ELSE 'test' END AS kind, CAST(p_partkey AS VARCHAR) AS k FROM part
),
nodes AS (
  SELECT *, format('{{"unique_id":"{0}.shop.n{1}","resource_type":"{0}","database":"DB","schema":"_MRT","name":"n{1}",'
    || '"alias":"a{1}","package_name":"shop","original_file_path":"models/n{1}.sql","tags":["{2}"],'
    || '"depends_on":{{"nodes":["source.shop.s{1}"]}},"checksum":{{"checksum":"c{1}"}},'
    || '"config":{{"materialized":"table","strategy":"check","meta":{{"size":{3}}}}}}}', kind, k, p_brand, p_size)
    AS all_results
  FROM parts
)
"""
NODE_HEAD = """
'inv-1' AS command_invocation_id, kind || '.shop.n' || k AS node_id, TIMESTAMP '2024-02-01 06:00:00' AS run_started_at
"""
NODE_COLUMNS = {
    "database": "'DB' AS database",
    "schema": "'_MRT' AS schema",
    "name": "'n' || k AS name",
    "depends_on_nodes": "['source.shop.s' || k] AS depends_on_nodes",
    "package_name": "'shop' AS package_name",
    "path": "'models/n' || k || '.sql' AS path",
    "test_path": "'models/n' || k || '.sql' AS test_path",
    "checksum": "'c' || k AS checksum",
    "materialization": "'table' AS materialization",
    "strategy": "'check' AS strategy",
    "tags": "[p_brand] AS tags",
    "meta": "'{\"size\":' || p_size || '}' AS meta",
    "alias": "'a' || k AS alias",
    "all_results": "all_results",
}


def _node_sql(kind: str, columns: str) -> str:
    chosen = ", ".join(NODE_COLUMNS[c] for c in columns.split())
    return f"WITH {MANIFEST} SELECT {NODE_HEAD}, {chosen} FROM nodes WHERE kind = '{kind}'"


@query(
    _node_sql(
        "model",
        "database schema name depends_on_nodes package_name path checksum materialization tags meta alias all_results",
    )
)
def model_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(_manifests(spark, sf_dir), "model", "inv-1", STARTED)


@query(_node_sql("seed", "database schema name package_name path checksum meta alias all_results"))
def seed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(_manifests(spark, sf_dir), "seed", "inv-1", STARTED)


@query(
    _node_sql(
        "snapshot", "database schema name depends_on_nodes package_name path checksum strategy meta alias all_results"
    )
)
def snapshot_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(_manifests(spark, sf_dir), "snapshot", "inv-1", STARTED)


@query(_node_sql("test", "name depends_on_nodes package_name test_path tags all_results"))
def test_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_rows(_manifests(spark, sf_dir), "test", "inv-1", STARTED)


@query("""
SELECT 'inv-1' AS command_invocation_id, 'source.shop.s' || p_partkey AS node_id,
       TIMESTAMP '2024-02-01 06:00:00' AS run_started_at, 'DB' AS database, '_SRC' AS schema, 'shop' AS source_name,
       'files' AS loader, 's' || p_partkey AS name, 'shop__s' || p_partkey AS identifier, '_load_id' AS loaded_at_field,
       '{"warn_after":' || p_size || '}' AS freshness, CAST(NULL AS VARCHAR) AS all_results
FROM part
""")
def source_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows without the full node text."""
    return node_rows(_manifests(spark, sf_dir), "source", "inv-1", STARTED, with_all_results=False)


@query("""
SELECT 'inv-1' AS command_invocation_id, 'exposure.shop.e' || p_partkey AS node_id,
       TIMESTAMP '2024-02-01 06:00:00' AS run_started_at, 'e' || p_partkey AS name, 'dashboard' AS type,
       '{"name":"' || p_brand || '"}' AS owner, 'high' AS maturity, 'exposures/e' || p_partkey || '.yml' AS path,
       p_name AS description, 'http://shop/' || p_partkey AS url, 'shop' AS package_name,
       ['model.shop.n' || p_partkey] AS depends_on_nodes, CAST([] AS VARCHAR[]) AS tags,
       CAST(NULL AS VARCHAR) AS all_results
FROM part
""")
def exposure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure rows without the full node text."""
    return node_rows(_manifests(spark, sf_dir), "exposure", "inv-1", STARTED, with_all_results=False)


@query("""
SELECT 'run-' || strftime(ts, '%Y%m%d') AS command_invocation_id, '1.10' AS dbt_version, 'shop' AS project_name,
       min(ts) AS run_started_at, 'build' AS dbt_command, count(*) % 2 = 0 AS full_refresh_flag, 'default' AS
       target_profile_name, 'prd' AS target_name, '_TMP' AS target_schema, CAST(16 AS INTEGER) AS target_threads,
       CAST(NULL AS VARCHAR) AS dbt_cloud_project_id, nullif(CAST(count(*) % 3 AS VARCHAR), '0') AS dbt_cloud_job_id,
       CAST(NULL AS VARCHAR) AS dbt_cloud_run_id, CAST(NULL AS VARCHAR) AS dbt_cloud_run_reason_category,
       CAST(NULL AS VARCHAR) AS dbt_cloud_run_reason, CAST(NULL AS VARCHAR) AS env_vars, CAST(NULL AS VARCHAR) AS dbt_vars,
       '{"events":' || count(*) || '}' AS invocation_args, CAST(NULL AS VARCHAR) AS dbt_custom_envs
FROM events GROUP BY strftime(ts, '%Y%m%d')
""")
def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invocation per day of events; blanks become NULL, text that is not JSON too."""
    events = F.count("*")
    days = read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("day")).agg(
        F.min("ts").alias("run_started_at"),
        (events % 2 == 0).alias("full_refresh_flag"),
        F.when(events % 3 == 0, "").otherwise((events % 3).cast("string")).alias("dbt_cloud_job_id"),
        F.format_string('{"events":%d}', events).alias("invocation_args"),
    )
    constant = {
        "dbt_version": "1.10", "project_name": "shop", "dbt_command": "build", "target_profile_name": "default",
        "target_name": "prd", "target_schema": "_TMP", "target_threads": 16, "dbt_cloud_run_reason": "",
        "dbt_custom_envs": "{",
    }
    rows = days.withColumn("command_invocation_id", F.concat(F.lit("run-"), "day"))
    return invocation_rows(rows.withColumns({name: F.lit(value) for name, value in constant.items()}))


@query(f"""
WITH {SOURCES}, checked AS (SELECT source, max_loaded_at, {FRESHNESS} FROM latest)
SELECT 'inv-1' AS command_invocation_id, source AS node_id, TIMESTAMP '2024-02-01 06:00:00' AS run_started_at, status,
       max_loaded_at, snapshotted_at, age_seconds, CAST(NULL AS DOUBLE) AS execution_seconds,
       CAST(NULL AS VARCHAR) AS thread_id
FROM checked
""")
def freshness_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The freshness check as metadata rows."""
    return freshness_rows(_sources(spark, sf_dir), "inv-1", STARTED)


@query("""
WITH days AS (
  SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total
  FROM orders GROUP BY 1
)
SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(count(*) AS BIGINT) AS days, CAST(sum(orders) AS BIGINT) AS orders,
       CAST(sum(total) AS DECIMAL(32,2)) AS total
FROM days GROUP BY 1
""")
def recomputed_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late orders: the days of their months are rebuilt from orders, and then only the years of those months from days."""
    late = (F.col("o_orderkey") % 50 == 0) & (F.month("o_orderdate") == 3)
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
        F.when(late, F.lit("2024-02-01 09:00:00")).otherwise("2024-01-01 00:00:00").cast("timestamp_ntz").alias("loaded_at"),
    )

    month, year = F.trunc("day", "month"), F.year("month")

    def of_days(rows: DataFrame) -> DataFrame:
        return rows.groupBy("day").agg(F.count("*").alias("orders"), F.sum("price").alias("total")).withColumn("month", month)

    def of_months(days: DataFrame) -> DataFrame:
        sums = [F.count("*").alias("days"), F.sum("orders").alias("orders"), F.sum("total").cast("decimal(32,2)").alias("total")]
        return days.groupBy("month").agg(*sums).withColumn("year", year)

    steps = [Step(of_days, new_folder(spark, "days"), {"month": month}), Step(of_months, new_folder(spark, "months"), {"year": year})]
    recompute_chain(spark, orders.filter(~late), "loaded_at", datetime(2000, 1, 1), steps)
    recompute_chain(spark, orders, "loaded_at", STARTED.replace(day=1, hour=0), steps)
    return read_stored(spark, steps[-1].path).drop("year")


@query(_node_sql("model", "database schema name depends_on_nodes package_name path checksum materialization tags meta alias").replace(
    " FROM nodes WHERE", ", CAST(NULL AS VARCHAR) AS all_results FROM nodes WHERE"
))
def manifest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of one landed manifest that holds the nodes of all parts in one document."""
    folder = new_folder(spark, "manifest")
    nodes = _manifests(spark, sf_dir).select(F.explode("nodes").alias("id", "node")).withColumn("n", F.monotonically_increasing_id())
    comma = F.when(F.col("n") > nodes.agg(F.min("n")).scalar(), ",").otherwise("")
    members = nodes.select(F.concat(comma, F.lit('"'), "id", F.lit('":'), "node").alias("value"))
    first, last = (
        spark.range(0, 1, 1, 1).select(F.lit(text).alias("value")) for text in ('{"metadata":{"project":"shop"},"nodes":{', "}}")
    )
    first.unionAll(members).unionAll(last).write.text(folder)  # files in the order of the union, each some lines of the document
    manifests = read_manifests(spark, folder, pieces=True)
    return manifest_node_rows(manifests, "model", "inv-1", STARTED, with_all_results=False)
