"""Sources, load windows and writes."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (
    describe_columns,
    full_refresh,
    keep_rollup,
    latest_per_key,
    materialise,
    merge_into,
    merge_latest,
    merge_upsert,
    read_stored,
    rollup_states,
    rollup_values,
    row_count_latest,
    typed,
    write_table,
)
from ..plans import integer_series
from ..session import new_folder
from ..sources import (
    chunk_coverage,
    date_chunks,
    land,
    landing_files,
    load_window,
    quarantine,
    read_landing,
    read_seed,
    read_source,
    require_rows,
    stamp_load,
)
from ..streaming import stream_merge
from .registry import query, read

EVENT = "event_id bigint, day date, user_id bigint, event_type string, value decimal(12,2), _load_id string"
FIRST_LOAD, SECOND_LOAD = "1705708800.25", "1706572800.75"


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("date").alias("day"),
        "user_id",
        "event_type",
        F.col("value").cast("decimal(12,2)").alias("value"),
    )


def _loads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two loads whose windows overlap by nine days; the second one carries corrected values."""
    rows = _event_rows(spark, sf_dir)
    corrected = (F.col("value") + 1).cast("decimal(12,2)")
    first = stamp_load(rows.filter("day < date'2024-01-20'"), FIRST_LOAD)
    second = stamp_load(rows.filter("day >= date'2024-01-11'").withColumn("value", corrected), SECOND_LOAD)
    return first, second


KEYS, ORDER = ["event_id", "day"], ["_load_id"]

EVENT_ROWS = """
rows AS (
  SELECT event_id, CAST(ts AS DATE) AS day, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value FROM events
)
"""
TWO_LOADS = f"""
WITH {EVENT_ROWS},
first_load AS (SELECT *, '{FIRST_LOAD}' AS _load_id FROM rows WHERE day < DATE '2024-01-20'),
second_load AS (
  SELECT event_id, day, user_id, event_type, CAST(value + 1 AS DECIMAL(12,2)) AS value, '{SECOND_LOAD}' AS _load_id
  FROM rows WHERE day >= DATE '2024-01-11'
)
"""
MERGED = f"""
{TWO_LOADS}
SELECT * FROM second_load
UNION ALL
SELECT f.* FROM first_load f WHERE NOT EXISTS
  (SELECT 1 FROM second_load s WHERE s.event_id = f.event_id AND s.day = f.day)
"""


@query(f"WITH {EVENT_ROWS} SELECT *, '{FIRST_LOAD}' AS _load_id FROM rows")
def landing_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the events as one load of JSON lines and read them back by declared schema."""
    rows = stamp_load(require_rows(_event_rows(spark, sf_dir), "events"), FIRST_LOAD)
    path = land(rows, new_folder(spark, "landing"), "events", FIRST_LOAD)
    return read_landing(spark, path, EVENT)


@query(f"""
{TWO_LOADS}
SELECT _load_id AS load_id, CAST(count(*) AS BIGINT) AS rows FROM
  (SELECT _load_id FROM first_load UNION ALL SELECT _load_id FROM second_load) GROUP BY 1
""")
def landing_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per load, counted from the listing of the landed files."""
    root = new_folder(spark, "landing")
    for load_id, rows in zip((FIRST_LOAD, SECOND_LOAD), _loads(spark, sf_dir)):
        land(rows, root, "events", load_id)
    files = landing_files(spark, root, read_landing(spark, f"{root}/events__*", EVENT))
    return files.groupBy("load_id").agg(F.sum("rows").alias("rows"))


@query("""
SELECT p_partkey, p_name, p_brand, nullif(p_type, 'ECONOMY') AS p_type, p_size,
       CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice
FROM part
""")
def seed_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated CSV with declared types; a blank field comes back as NULL."""
    path = new_folder(spark, "seed")
    blanked = read(spark, sf_dir, "part").withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    blanked.withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(12,2)")).write.csv(
        path, header=True, nullValue=""
    )
    return read_seed(
        spark,
        path,
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice decimal(12,2)",
    )


@query("""
SELECT n AS o_orderkey FROM range((SELECT max(o_orderkey) + 1 FROM orders)) AS r(n)
WHERE n NOT IN (SELECT l_orderkey FROM lineitem)
""")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer series of order numbers, without those that have lines."""
    orders = read(spark, sf_dir, "orders").agg(F.max("o_orderkey") + 1).first()[0]
    numbers = integer_series(spark, orders).withColumnRenamed("n", "o_orderkey")
    used = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return numbers.join(used, "o_orderkey", "left_anti")


@query("""
SELECT event_id, ts, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-12 00:00:00' AND ts < TIMESTAMP '2024-01-23 00:00:00'
""")
def load_window_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the last fourteen days before a fixed now, clipped to the start date."""
    window = load_window(
        read_source(spark, f"{sf_dir}/events.parquet"), "ts", datetime(2024, 1, 22, 9), 14, date(2024, 1, 12)
    )
    return window.select("event_id", "ts", "user_id", "event_type")


@query("""
WITH span AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders),
chunks AS (SELECT n, a + CAST(n * 10 AS INTEGER) AS chunk_start, b FROM span, range(100000) AS r(n))
SELECT CAST(n AS INTEGER) AS chunk_nr, chunk_start, least(chunk_start + 9, b) AS chunk_end
FROM chunks WHERE chunk_start <= b
""")
def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-day chunks over the span of the orders."""
    first, last = read(spark, sf_dir, "orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    return date_chunks(spark, first.date(), last.date(), 10)


@query("""
WITH span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) + 12 AS b FROM events),
chunks AS (
  SELECT CAST(n AS INTEGER) AS chunk_nr, a + CAST(n * 4 AS INTEGER) AS chunk_start,
         least(a + CAST(n * 4 AS INTEGER) + 3, b) AS chunk_end
  FROM span, range(1000) AS r(n) WHERE a + CAST(n * 4 AS INTEGER) <= b
)
SELECT chunk_nr, chunk_start, chunk_end, CAST(count(e.event_id) AS BIGINT) AS rows, count(e.event_id) = 0 AS is_empty
FROM chunks LEFT JOIN events e ON CAST(e.ts AS DATE) BETWEEN chunk_start AND chunk_end
GROUP BY 1, 2, 3
""")
def event_chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per four-day chunk of a window that reaches past the last event, so its end is empty."""
    events = read(spark, sf_dir, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    start, end = first.date(), last.date() + timedelta(days=12)
    return chunk_coverage(events, "ts", date_chunks(spark, start, end, 4), start, 4)


@query(MERGED)
def merge_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second load upserted into the first by key."""
    first, second = _loads(spark, sf_dir)
    return merge_upsert(first, second, KEYS, ORDER)


@query(MERGED)
def merge_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same load merged twice changes nothing."""
    first, second = _loads(spark, sf_dir)
    return merge_upsert(merge_upsert(first, second, KEYS, ORDER), second, KEYS, ORDER)


@query(MERGED)
def merge_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older load arrives last and changes nothing that the newer one brought."""
    first, second = _loads(spark, sf_dir)
    return merge_latest(second, first, KEYS, ORDER)


@query(f"""
{TWO_LOADS}, merged AS (
  SELECT event_id, day, user_id, NULL AS event_type, value, _load_id, 'second' AS origin FROM second_load
  UNION ALL
  SELECT f.event_id, f.day, f.user_id, f.event_type, f.value, f._load_id, NULL FROM first_load f WHERE NOT EXISTS
    (SELECT 1 FROM second_load s WHERE s.event_id = f.event_id AND s.day = f.day)
)
SELECT event_id, day, user_id, CAST(event_type AS VARCHAR) AS event_type, value, _load_id, origin FROM merged
""")
def merge_other_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that lacks a stored column and brings a new one: the table keeps the one and takes on the other."""
    path = new_folder(spark, "grown")
    first, second = _loads(spark, sf_dir)
    merge_into(spark, path, first, KEYS, ORDER, ["day"])
    merge_into(spark, path, second.drop("event_type").withColumn("origin", F.lit("second")), KEYS, ORDER, ["day"])
    schema = "event_id bigint, user_id bigint, event_type string, value decimal(12,2), _load_id string, origin string, day date"
    return spark.read.schema(schema).parquet(path)


@query("""
SELECT o_orderkey, CAST(o_custkey % 3 AS INTEGER) AS part, CAST(o_orderdate AS DATE) AS day,
       CASE WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS origin
FROM orders
""")
def merge_two_partition_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that touches nearly every one of thousands of partitions over two columns."""
    path = new_folder(spark, "two-columns")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("part"), F.col("o_orderdate").cast("date").alias("day"),
        F.lit("first").alias("origin"),
    )
    keys = ["o_orderkey", "part", "day"]
    merge_into(spark, path, orders, keys, ["origin"], ["part", "day"])
    merge_into(spark, path, orders.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("second")), keys, ["origin"], ["part", "day"])
    return spark.read.schema("o_orderkey bigint, origin string, part int, day date").parquet(path)


@query(f"""
{TWO_LOADS}
SELECT event_id, day, CAST(user_id AS DECIMAL(22,2)) AS user_id, event_type, CAST(value AS DECIMAL(14,4)) AS value, _load_id
FROM first_load f WHERE NOT EXISTS (SELECT 1 FROM second_load s WHERE s.event_id = f.event_id AND s.day = f.day)
UNION ALL
SELECT event_id, day, CAST(user_id + 0.25 AS DECIMAL(22,2)), CAST(length(event_type) AS VARCHAR), CAST(value + 0.0125 AS DECIMAL(14,4)),
       _load_id
FROM second_load
""")
def merge_promoted_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load whose numbers need more digits, and whose text comes as numbers; older files are read in the wider types."""
    path = new_folder(spark, "promoted")
    first, second = _loads(spark, sf_dir)
    merge_into(spark, path, first, KEYS, ORDER, ["day"])
    changed = second.withColumns({
        "user_id": (F.col("user_id") + F.lit(Decimal("0.25"))).cast("decimal(18,2)"), "event_type": F.length("event_type"),
        "value": (F.col("value") + F.lit(Decimal("0.0125"))).cast("decimal(10,4)"),
    })
    merge_into(spark, path, changed, KEYS, ORDER, ["day"])
    return read_stored(spark, path)


@query(f"""
{TWO_LOADS}, loads AS (
  SELECT event_id, day, user_id, NULL AS user_id__v_string, event_type, value, _load_id FROM first_load f
  WHERE NOT EXISTS (SELECT 1 FROM second_load s WHERE s.event_id = f.event_id AND s.day = f.day)
  UNION ALL
  SELECT event_id, day, CASE WHEN user_id % 3 > 0 THEN user_id END, CASE WHEN user_id % 3 = 0 THEN 'u' || user_id END, event_type,
         value, _load_id
  FROM second_load
)
SELECT * FROM loads
""")
def merge_side_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load whose numbers come as text: those that are numbers stay, the others go to a column of their own."""
    path = new_folder(spark, "sides")
    first, second = _loads(spark, sf_dir)
    merge_into(spark, path, first, KEYS, ORDER, ["day"])
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("u"), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    merge_into(spark, path, second.withColumn("user_id", text), KEYS, ORDER, ["day"])
    return read_stored(spark, path)


@query(MERGED)
def merge_after_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first load without rows, a load, a refresh to no rows, and both loads again."""
    path = new_folder(spark, "emptied")
    first, second = _loads(spark, sf_dir)
    nothing = first.filter("event_id < 0")
    merge_into(spark, path, nothing, KEYS, ORDER, ["day"])
    merge_into(spark, path, second, KEYS, ORDER, ["day"])
    full_refresh(spark, path, nothing, KEYS, ORDER, ["day"])
    for load in (first, second):
        merge_into(spark, path, load, KEYS, ORDER, ["day"])
    return read_stored(spark, path)


@query(MERGED)
def merge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both loads merged into a Parquet table partitioned by day; only touched partitions are rewritten."""
    path = new_folder(spark, "merged")
    for load in _loads(spark, sf_dir):
        merge_into(spark, path, load, KEYS, ORDER, ["day"])
    return spark.read.schema(EVENT).parquet(path)


@query(f"{TWO_LOADS} SELECT * FROM first_load UNION ALL SELECT * FROM second_load")
def append_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both loads appended, overlap and all."""
    path = new_folder(spark, "appended")
    for load in _loads(spark, sf_dir):
        write_table(load, path, "append", ["day"])
    return spark.read.schema(EVENT).parquet(path)


@query(f"{TWO_LOADS} SELECT * FROM second_load")
def replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second load replaces the table of the first."""
    path = new_folder(spark, "replaced")
    for load in _loads(spark, sf_dir):
        write_table(load, path, "replace", ["day"])
    return spark.read.schema(EVENT).parquet(path)


@query(f"{TWO_LOADS} SELECT * FROM second_load")
def full_refresh_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh keeps only what the new window holds."""
    path = new_folder(spark, "refreshed")
    first, second = _loads(spark, sf_dir)
    merge_into(spark, path, first, KEYS, ORDER, ["day"])
    full_refresh(spark, path, second, KEYS, ORDER, ["day"])
    return spark.read.schema(EVENT).parquet(path)


@query(MERGED)
def full_refresh_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full refresh that replays the landing archive brings the older rows back."""
    root, path = new_folder(spark, "landing"), new_folder(spark, "replayed")
    first, second = _loads(spark, sf_dir)
    land(first, root, "events", FIRST_LOAD)
    full_refresh(spark, path, second, KEYS, ORDER, ["day"], read_landing(spark, f"{root}/events__*", EVENT))
    return spark.read.schema(EVENT).parquet(path)


@query(MERGED)
def stream_merge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both loads arrive as files and are merged by a stream."""
    root, path = new_folder(spark, "landing"), new_folder(spark, "streamed")
    for load_id, rows in zip((FIRST_LOAD, SECOND_LOAD), _loads(spark, sf_dir)):
        land(rows, root, "events", load_id)
    stream_merge(
        spark, root, EVENT, path, KEYS, ORDER, new_folder(spark, "stream-state"), ["day"], max_files=4
    ).awaitTermination()
    return spark.read.schema(EVENT).parquet(path)


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS events,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS value_sum
FROM events GROUP BY 1, 2
""")
def incremental_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily model built for the first days, then merged for the days that were open or are new."""
    path = new_folder(spark, "incremental")
    rows = _event_rows(spark, sf_dir)

    def model(source: DataFrame) -> DataFrame:
        return source.groupBy("day", "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value_sum"))

    for window in ("day < date'2024-01-20'", "day >= date'2024-01-19'"):
        merge_into(spark, path, model(rows.filter(window)), ["day", "event_type"], ["events"], ["day"])
    return spark.read.schema("day date, event_type string, events bigint, value_sum decimal(22,2)").parquet(path)


@query("""
SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(value) AS BIGINT) AS value_count,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS value_sum, CAST(min(value) AS DECIMAL(12,2)) AS value_min,
       CAST(max(value) AS DECIMAL(12,2)) AS value_max
FROM events GROUP BY 1, 2
""")
def rollup_after_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily roll-up to which each of three loads adds its states; the second load comes twice."""
    path, rows = new_folder(spark, "rollup"), _event_rows(spark, sf_dir)
    for number in (0, 1, 1, 2):
        load = stamp_load(rows.filter(F.col("event_id") % 3 == number), f"170570880{number}.25")
        states = rollup_states(load, {"day": F.col("day"), "event_type": F.col("event_type")}, {"value": F.col("value")}, {"user": F.col("user_id")})
        keep_rollup(spark, path, states, ["day", "event_type"], ["day"])
    return rollup_values(read_stored(spark, path)).drop("value_avg", "user_distinct").select(
        "day", "event_type", "rows", "value_count", "value_sum", "value_min", "value_max"
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def clustered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in clusters of customer and date."""
    path = new_folder(spark, "clustered")
    orders = typed(
        read(spark, sf_dir, "orders"),
        [
            ("o_orderkey", "o_orderkey", "bigint"),
            ("o_custkey", "o_custkey", "bigint"),
            ("o_orderstatus", "o_orderstatus", "string"),
            ("o_orderdate", "o_orderdate", "date"),
        ],
    )
    write_table(orders, path, "replace", ["o_orderstatus"], ["o_custkey", "o_orderdate"])
    return spark.read.schema(orders.schema).parquet(path)


@query("""
SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31' OR o_custkey < 100
""")
def clustered_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written along a curve over customer and date, and read by a range of either."""
    path = new_folder(spark, "curve")
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"),
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
    )
    write_table(orders, path, "replace", cluster_by=["o_custkey", "o_orderdate"], curve=True)
    stored = spark.read.schema(orders.schema).parquet(path)
    spring = stored.filter("o_orderdate between date'1996-01-01' and date'1996-03-31'")
    return spring.unionByName(stored.filter("o_custkey < 100 and o_orderdate not between date'1996-01-01' and date'1996-03-31'"))


@query("""
SELECT 'good' AS kind, event_id, NULL AS line FROM events WHERE event_id % 7 > 0
UNION ALL
SELECT 'bad', NULL, CASE WHEN event_id % 2 = 0 THEN '{"event_id":"' || event_type || event_id || '"}' ELSE '{"event_id":' || event_id END
FROM events WHERE event_id % 7 = 0
""")
def landing_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed lines of which some are cut off and some hold text for a number: good rows and quarantined lines."""
    root = new_folder(spark, "landing")
    key = F.col("event_id").cast("string")
    bad = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"event_id":"'), "event_type", key, F.lit('"}')))
    line = F.when(F.col("event_id") % 7 == 0, F.coalesce(bad, F.concat(F.lit('{"event_id":'), key))).otherwise(
        F.to_json(F.struct("event_id", "event_type"))
    )
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(f"{root}/events__{FIRST_LOAD}")
    kept = new_folder(spark, "quarantine")
    good = quarantine(spark, f"{root}/events__*", "event_id bigint, event_type string", kept)
    lines = spark.read.schema("line string").parquet(kept)
    return good.select(F.lit("good").alias("kind"), "event_id", F.lit(None).cast("string").alias("line")).unionByName(
        lines.select(F.lit("bad").alias("kind"), F.lit(None).cast("bigint").alias("event_id"), "line")
    )


@query("""
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS customers,
       CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS balance
FROM customer GROUP BY 1
""")
def layered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A staged table and an exposed view on top of it, each in its layer."""
    root = new_folder(spark, "layers")
    staged = typed(
        read(spark, sf_dir, "customer"),
        [
            ("c_custkey", "c_custkey", "bigint"),
            ("c_mktsegment", "c_mktsegment", "varchar(10)"),
            ("c_acctbal", "c_acctbal", "decimal(12,2)"),
        ],
    )
    table = materialise(staged, root, "stg", "stg__shop__customer")
    segments = table.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"))
    return materialise(segments, root, "exp", "exp__shop__segment")


@query("SELECT s_suppkey, s_name FROM supplier")
def described_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column descriptions that survive a write."""
    path = new_folder(spark, "described")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    write_table(describe_columns(rows, {"s_suppkey": "Supplier number.", "s_name": "Supplier name."}), path, "replace")
    return spark.read.parquet(path)


@query("""
SELECT * FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
           l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1
""")
def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest line per key."""
    return latest_per_key(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query("SELECT CAST(count(*) AS BIGINT) AS row_count, max(ts) AS latest FROM events")
def events_row_count_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events there are and when the latest one was."""
    return row_count_latest(read(spark, sf_dir, "events"), "ts")
