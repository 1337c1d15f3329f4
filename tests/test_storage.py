"""Curves, footers, listings, quarantined lines, kept roll-ups, recomputed chains, whole manifests, wide keys, calendar ends."""

from __future__ import annotations

import json
import os
import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratawork import fixed_values
from stratawork.functions import date_simple
from stratawork.operators import (
    Step,
    calendar_rollup,
    check_relationships,
    footer_aggregates,
    join_reference,
    keep_rollup,
    manifest_node_rows,
    orphan_rows,
    read_manifests,
    read_stored,
    recompute_chain,
    rollup_states,
    rollup_values,
    stored_max,
    violations,
    with_curve,
    write_table,
)
from stratawork.plans import calendar, calendar_dimension, date_spine, end_year, holidays
from stratawork.sources import landing_files, quarantine, read_landing_split, walk

# Curves --------------------------------------------------------------------------------------------------------------


def files_in_range(spark, path, column, low, high):
    """Files whose smallest and largest value let them hold the range."""
    ends = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return ends.count(), ends.filter(F.col("b").isNull() | ((F.col("a") <= high) & (F.col("b") >= low))).count()


@pytest.mark.parametrize("skewed", [False, True])
def test_a_filter_on_either_column_skips_most_files(spark, tmp_path, skewed):
    path, power = str(tmp_path / "c"), 6 if skewed else 1
    rows = spark.range(40_000, numPartitions=8).select(
        "id", (F.pow(F.rand(1), power) * 1_000_000).cast("bigint").alias("x"), F.date_add(F.lit(date(2020, 1, 1)), (F.rand(2) * 2000).cast("int")).alias("day"),
    )
    write_table(rows, path, "replace", cluster_by=["x", "day"], curve=True, files=256)
    low, high = rows.agg(F.expr("percentile(x, 0.5)"), F.expr("percentile(x, 0.55)")).first()
    for column, a, b in (("x", int(low), int(high)), ("day", date(2022, 1, 1), date(2022, 4, 1))):
        files, hit = files_in_range(spark, path, column, F.lit(a), F.lit(b))
        assert files > 200 and hit < files / 4
    assert spark.read.parquet(path).count() == 40_000 and spark.read.parquet(path).columns == ["id", "x", "day"]


def test_curves_over_odd_columns(spark):
    rows = [(None, None, None), ("", Decimal("-1.5"), True), ("zz", Decimal("2.5"), False), ("é", None, None)]
    df = spark.createDataFrame(rows, "t string, n decimal(5,1), b boolean")
    assert with_curve(df, ["t", "n", "b"]).count() == 4
    assert with_curve(df.limit(0), ["t", "n"]).count() == 0
    places = [r._curve for r in with_curve(spark.range(512), ["id"]).orderBy("id").collect()]
    assert places == sorted(places) and len(set(places)) > 200
    with pytest.raises(ValueError, match="62 bits"):
        with_curve(df, ["t", "n"], bits=40)
    with pytest.raises(ValueError, match="no place"):
        with_curve(spark.range(1).select(F.array("id").alias("a")), ["a"])


# Footers -------------------------------------------------------------------------------------------------------------


def test_the_latest_value_is_read_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10_000).select(
        "id", F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 900).cast("int")).alias("day"),
        F.timestamp_micros(F.col("id") * 1_000_001).cast("timestamp_ntz").alias("at"), F.lit(None).cast("int").alias("none"),
        F.col("id").cast("string").alias("text"), F.col("id").cast("decimal(12,2)").alias("price"),
    )
    rows.repartition(4).write.parquet(path)
    plan = footer_aggregates(spark, path, ["id", "day", "at"])._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*), MAX(id), MAX(day), MAX(at)]" in plan
    wanted = rows.agg(*[F.max(c) for c in ("id", "day", "at", "none", "text", "price")]).first()
    footers = footer_aggregates(spark, path, ["id", "day", "at"]).first()
    assert (footers["count"], footers.max_id, footers.max_day) == (10_000, wanted[0], wanted[1])
    assert [stored_max(spark, path, c) for c in ("id", "day", "at", "none", "text", "price")] == list(wanted)
    # files whose columns stand in another order, which Spark's footers get wrong
    other = rows.select("price", "at", (F.col("id") + 5).alias("id"), F.date_add("day", 1).alias("day"), "text", "none")
    other.write.mode("append").parquet(path)
    assert stored_max(spark, path, "id") == wanted[0] + 5 and stored_max(spark, path, "at") == wanted[2]
    assert (stored_max(spark, path, "day") - wanted[1]).days == 1


def test_timestamps_of_another_unit_are_still_right(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    values = [datetime(2024, 1, 1, 3), datetime(2025, 6, 7, 8, 9)]
    for unit in ("ms", "us"):
        path = tmp_path / f"{unit}.parquet"
        pq.write_table(pa.table({"at": pa.array(values, pa.timestamp(unit))}), path)
        assert stored_max(spark, str(path), "at") == values[1]


# Listings ------------------------------------------------------------------------------------------------------------


def test_very_many_files_are_listed_by_tasks(spark, tmp_path):
    root = tmp_path / "archive"
    for load in range(100):
        folder = root / f"events__{load}.5"
        folder.mkdir(parents=True)
        for k in range(200):
            os.close(os.open(folder / f"part {k}%20.json", os.O_CREAT))
        (folder / "_SUCCESS").touch()
    (root / "deep" / "er").mkdir(parents=True)
    (root / "deep" / "er" / "x__9.json").write_text("12345")
    files = landing_files(spark, str(root))
    assert "LocalRelation" not in files._jdf.queryExecution().toString()
    assert files.count() == 20_001 and files.select("path").distinct().count() == 20_001
    assert files.filter("size = 5").select("path").first().path.endswith("deep/er/x__9.json")
    assert files.groupBy("load_id").count().filter("count = 200").count() == 100
    assert walk(spark, str(tmp_path / "none")).count() == 0
    assert walk(spark, f"file://{root}/deep").count() == 1


def test_bad_lines_are_kept_apart(spark, tmp_path):
    lines = ['{"id": 1, "v": "a"}', '{"id": "x", "v": "b"}', '{"id": 3', "", "[1, 2]", '{"id": 4}', "null", '  {"id": 5, "v": null, "more": 1}', "text"]
    folder = tmp_path / "landing" / "events__1"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("\n".join(lines) + "\n")
    good, bad = read_landing_split(spark, str(folder), "id int, v string")
    assert sorted(map(tuple, good.collect())) == [(1, "a"), (4, None), (5, None)]
    assert sorted(r.line for r in bad.collect()) == sorted(['{"id": "x", "v": "b"}', '{"id": 3', "[1, 2]", "null", "text"])
    assert good.select("v").count() == 3 and good.count() + bad.count() == sum(bool(x.strip()) for x in lines)
    for _ in range(2):
        assert quarantine(spark, str(folder), "id int, v string", str(tmp_path / "q")).count() == 3
    kept = spark.read.parquet(str(tmp_path / "q"))
    assert kept.count() == 10 and kept.select("line_hash").distinct().count() == 5
    assert kept.first().file.endswith("a.jsonl") and kept.first().block_start == 0
    with pytest.raises(ValueError, match="own column"):
        read_landing_split(spark, str(folder), "_corrupt_line string")


# Kept roll-ups -------------------------------------------------------------------------------------------------------


def test_a_kept_rollup_equals_that_of_all_rows(spark, tmp_path):
    path, rng = str(tmp_path / "r"), random.Random(2)
    rows = [(k, f"2024-01-{1 + rng.randrange(5):02}", rng.choice("ab"), None if k % 9 == 0 else rng.randrange(100), str(k % 4)) for k in range(4000)]
    table = spark.createDataFrame(rows, "id int, day string, kind string, v int, _load_id string").withColumn("day", F.to_date("day"))
    by = {"day": F.col("day"), "kind": F.col("kind")}

    def states(df):
        return rollup_states(df, by, {"v": F.col("v")}, {"id": F.col("id")})

    for load in ("0", "1", "1", "2", "0"):
        keep_rollup(spark, path, states(table.filter(F.col("_load_id") == load)), ["day", "kind"], ["day"])
    first_day = sorted((tmp_path / "r" / "day=2024-01-01").iterdir())
    keep_rollup(spark, path, states(table.filter("_load_id = '3' and day > date'2024-01-01'")), ["day", "kind"], ["day"])
    assert sorted((tmp_path / "r" / "day=2024-01-01").iterdir()) == first_day
    keep_rollup(spark, path, states(table.filter("_load_id = '3' and day = date'2024-01-01'")), ["day", "kind"], ["day"])
    got = {(r.day, r.kind): r for r in rollup_values(read_stored(spark, path)).collect()}
    wanted = table.groupBy("day", "kind").agg(
        F.count("*").alias("rows"), F.count("v").alias("n"), F.sum("v").alias("s"), F.min("v").alias("a"), F.max("v").alias("b"),
        F.avg("v").alias("m"), F.countDistinct("id").alias("ids"),
    ).collect()
    assert len(got) == len(wanted) == 10
    for w in wanted:
        g = got[w.day, w.kind]
        assert (g.rows, g.v_count, g.v_sum, g.v_min, g.v_max, g.v_avg) == (w.rows, w.n, w.s, w.a, w.b, w.m)
        assert abs(g.id_distinct - w.ids) <= 0.05 * w.ids


# Chains --------------------------------------------------------------------------------------------------------------


def test_a_chain_rebuilds_only_what_is_downstream(spark, tmp_path):
    hours = [(datetime(2023 + m // 12, 1 + m % 12, d, 5), d, datetime(2024, 6, 1)) for m in range(18) for d in (1, 2)]
    late = [(datetime(2023, 3, 2, 7), 50, datetime(2024, 7, 2)), (datetime(2024, 2, 1, 8), 60, datetime(2024, 7, 2))]
    schema = "at timestamp_ntz, v int, loaded timestamp_ntz"

    def days(df):
        return df.groupBy(F.to_date("at").alias("day")).agg(F.sum("v").alias("v"))

    def months(df):
        return df.groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("v").alias("v"), F.count("*").alias("days"))

    paths = [tmp_path / "days", tmp_path / "months"]
    steps = [Step(days, str(paths[0]), {"day": F.to_date("at")}), Step(months, str(paths[1]), {"month": F.trunc("day", "month")})]
    assert recompute_chain(spark, spark.createDataFrame(hours, schema), "loaded", datetime(2000, 1, 1), steps) == [36, 18]
    before = {p: sorted(p.iterdir()) for path in paths for p in path.glob("*=*")}
    every = spark.createDataFrame(hours + late, schema)
    assert recompute_chain(spark, every, "loaded", datetime(2024, 7, 1), steps) == [2, 2]
    assert sorted(map(tuple, read_stored(spark, str(paths[1])).select("month", "v", "days").collect())) == sorted(
        map(tuple, months(days(every)).select("month", "v", "days").collect())
    )
    changed = {p.name for p, files in before.items() if sorted(p.iterdir()) != files}
    assert changed == {"day=2023-03-02", "day=2024-02-01", "month=2023-03-01", "month=2024-02-01"}
    # all rows of a month go: its partitions go as well
    gone = every.filter("at < '2024-06-01'").unionByName(spark.createDataFrame([(datetime(2024, 6, 1), None, datetime(2024, 8, 1))], schema))

    def some(df):
        return days(df.filter("v is not null"))

    assert recompute_chain(spark, gone, "loaded", datetime(2024, 7, 31), [Step(some, *steps[0][1:]), steps[1]]) == [1, 1]
    assert not (paths[0] / "day=2024-06-01").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["days", "months"]


# Manifests -----------------------------------------------------------------------------------------------------------


def test_one_manifest_of_five_thousand_nodes(spark, tmp_path):
    node = lambda k: {"unique_id": f"model.shop.n{k}", "resource_type": "model" if k % 2 else "test", "name": f"n{k}", "tags": ["a"], "depends_on": {"nodes": [f"s{k}"]}, "config": {"meta": {"k": k}}}
    (tmp_path / "m.json").write_text(json.dumps({"nodes": {f"model.shop.n{k}": node(k) for k in range(5000)}, "sources": {}}, indent=1))
    (tmp_path / "n.json").write_text('{"nodes": {}}')
    manifests = read_manifests(spark, str(tmp_path))
    rows = manifest_node_rows(manifests, "model", "inv", datetime(2024, 1, 1))
    assert rows.count() == 2500 and rows.select("node_id").distinct().count() == 2500
    one = rows.filter("node_id = 'model.shop.n7'").first()
    assert (one.name, one.tags, one.depends_on_nodes, json.loads(one.meta), json.loads(one.all_results)) == ("n7", ["a"], ["s7"], {"k": 7}, node(7))
    assert manifest_node_rows(manifests, "source", "inv", datetime(2024, 1, 1)).count() == 0


@pytest.fixture
def small_blocks(spark):
    """Tasks that read 300 bytes of a file each."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_manifest_is_read_in_blocks_and_comes_node_by_node(spark, tmp_path, small_blocks):
    odd = 'a,"b\\"{[,' + "\n]},é"
    node = lambda k: {"resource_type": "model", "name": odd + str(k), "tags": [odd, f"t{k}"], "config": {"meta": {odd: [k, {"x": [odd]}]}}}
    whole = {odd: odd, "nodes": {f"{odd}{k}": node(k) for k in range(40)}, "long": {"text": "x,y" * 500}, "list": [[1, 2], {"a": 3}, "b"], "none": {}, "last": 7.5}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "m.json").write_text(json.dumps(whole))
    (tmp_path / "lines").mkdir()
    lines = json.dumps(whole, indent=1).split("\n")
    for k in range(0, len(lines), 50):
        (tmp_path / "lines" / f"part-{k:05d}").write_text("".join(f"{x}\n" for x in lines[k : k + 50]))
    for folder, pieces in (("one", False), ("lines", True)):
        manifests = read_manifests(spark, str(tmp_path / folder), pieces)
        each = [json.loads(x[0]) for x in manifests.select(F.to_json("document")).collect()]
        assert len(each) == 47 and all(len(x) == 1 for x in each)
        assert all(len(x["nodes"]) == 1 for x in each if "nodes" in x)
        assert sorted(json.dumps(v) for x in each for v in x.get("list", [])) == ['"b"', "[1, 2]", '{"a": 3}']
        assert all({k: v} in each for k, v in whole.items() if k not in ("nodes", "list"))
        rows = manifest_node_rows(manifests, "model", "inv", datetime(2024, 1, 1)).collect()
        assert {r.node_id: json.loads(r.all_results) for r in rows} == whole["nodes"] and len(rows) == 40
        assert {r.node_id: (r.name, r.tags, json.loads(r.meta)) for r in rows} == {
            k: (v["name"], v["tags"], v["config"]["meta"]) for k, v in whole["nodes"].items()
        }
    assert {x.file.rsplit("/", 1)[1] for x in manifests.select("file").distinct().collect()} == {"lines"}


@pytest.mark.parametrize(
    "text",
    [
        '{"nodes": {"a": {}}', '{"nodes": {"a": "x}}', '{"nodes": {"a": {}],"b": 2}', '{"nodes": {"a": {},}}', '{"nodes": {"a": {}},}', '{,"nodes": {}}',
        '{"nodes": {"a": {},,"b": {}}}', '{"nodes": {,"a": {}}}', '{"nodes": {"a": {}, 5}}', '{"nodes": {"a": {}} "b": 1}', '{"nodes": {"a": {}, "\\u0061": {}}}',
        '{"nodes": {"a": {}}, "nodes": {"b": {}}}', '{"nodes": {"a": {"b": 1, "b": 2}}}', '{}}, {{', "\n",
    ],
)
def test_a_manifest_that_is_no_json_fails(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|no JSON|twice"):
        read_manifests(spark, str(tmp_path)).collect()


# Keys ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_bytes", [0, 2**26])
def test_wide_decimals_meet_only_their_equals(spark, max_bytes):
    whole = spark.createDataFrame([(Decimal(k),) for k in (1, 2, -1, 0, 10**30)] + [(None,)], "k decimal(38,0)")
    parts = spark.createDataFrame([(Decimal(v), v) for v in ("1.4", "2", "-1.4", "0", "-0.0000000001")] + [(None, "none")], "k decimal(38,10), name string")
    got = {r.k: r.name for r in join_reference(whole, parts, ["k"], max_bytes=max_bytes).collect()}
    assert got == {1: None, 2: "2", -1: None, 0: "0", 10**30: None, None: None}
    back = {r.name for r in join_reference(parts, whole.withColumn("there", F.lit(1)), ["k"], "inner", max_bytes=max_bytes).collect()}
    assert back == {"2", "0"}
    orphans = {r.k for r in orphan_rows(whole, "k", parts, "k", max_bytes=max_bytes).collect()}
    assert orphans == {1, -1, 10**30}
    longs = spark.createDataFrame([(2,), (3,)], "k bigint").join(spark.range(1))
    assert {r.k for r in orphan_rows(longs, "k", parts, "k", max_bytes=max_bytes).collect()} == {3}


def test_relationship_tests_use_the_same_key_rule(spark):
    whole = spark.createDataFrame([(Decimal(1),), (Decimal(2),)], "k decimal(38,0)")
    parts = spark.createDataFrame([(Decimal("1.4"),), (Decimal("2"),)], "k decimal(38,10)")
    assert [tuple(r) for r in violations(whole, check_relationships("k", parts, "k")).collect()] == [(Decimal(1), 1)]
    texts = spark.createDataFrame([("01",), ("1",), ("abc",), ("abc",), (None,)], "k string")
    numbers = spark.createDataFrame([(1,)], "k int")
    found = {r.from_field: r.n_records for r in violations(texts, check_relationships("k", numbers, "k")).collect()}
    assert found == {"01": 1, "abc": 2}


# Calendars -----------------------------------------------------------------------------------------------------------


def test_an_order_far_ahead_keeps_its_total(spark):
    orders = spark.createDataFrame([(datetime(2140, 5, 6), 7), (datetime(1995, 1, 1), 1), (datetime(9999, 12, 31), 2), (None, 3)], "d timestamp_ntz, v int")
    assert end_year([(orders, "d")]) == 2140
    assert end_year([(orders.limit(0), "d")]) == end_year([]) == date.today().year + 10
    spine = date_spine(spark, 1990, end_year([(orders, "d")]))
    days = calendar(spine, fixed_values.months(spark), fixed_values.weekdays(spark), holidays(spine, fixed_values.nl_holidays(spark)))
    fact = orders.select("v", date_simple("d").alias("id_dim__common__calendar"))
    months = calendar_rollup(fact, calendar_dimension(days), "id_dim__common__calendar", ["year_nr", "month_nr"], {"v": "sum"})
    assert {(r.year_nr, r.month_nr, r.v_sum) for r in months.collect()} >= {(2140, 5, 7), (1995, 1, 1)}


def test_holidays_of_other_calendars(spark):
    schema = "holiday_name string, orthodox_offset int, islamic_month int, islamic_day int"
    rules = spark.createDataFrame([("easter", 0, None, None), ("fitr", None, 10, 1), ("new year", None, 1, 1), ("last", None, 12, 30)], schema)
    found = {}
    for r in holidays(date_spine(spark, 2000, 2030), rules).collect():
        for name in r.holiday_name.split("; "):
            found.setdefault(name, []).append(r.date)
    easter = {d.year: d for d in found["easter"]}
    known = {2000: "04-30", 2005: "05-01", 2010: "04-04", 2016: "05-01", 2021: "05-02", 2024: "05-05", 2025: "04-20", 2030: "04-28"}
    assert len(easter) == 31 and {y: easter[y].strftime("%m-%d") for y in known} == known
    # the Islamic months by counting: 30 and 29 days by turns, a day more at the end of leap years
    day, months = date(622, 7, 19), {}
    for year in range(1, 1460):
        for month in range(1, 13):
            months[year, month] = day
            leap = month == 12 and (year - 1) % 30 + 1 in (2, 5, 7, 10, 13, 16, 18, 21, 24, 26, 29)
            months[year, month, "long"] = month % 2 == 1 or leap
            day = date.fromordinal(day.toordinal() + (30 if months[year, month, "long"] else 29))
    between = lambda d: 2000 <= d.year <= 2030
    assert sorted(found["fitr"]) == sorted(d for k, d in months.items() if k[1:] == (10,) and between(d))
    assert sorted(found["new year"]) == sorted(d for k, d in months.items() if k[1:] == (1,) and between(d))
    assert date(2023, 7, 19) in found["new year"] and sum(d.year == 2000 for d in found["fitr"]) == 2
    assert len([d for d in found["last"]]) in range(31, 34)  # every year has a thirtieth day here, or the next one's first


# Reconciliation ------------------------------------------------------------------------------------------------------


def test_two_tables_are_reconciled_by_digests(spark):
    from stratawork.operators import reconcile_by_digest

    rows = [(k, f"v{k}", None if k % 7 == 0 else k / 3) for k in range(2000)]
    left = spark.createDataFrame([*rows, (5, "v5", 5 / 3), (None, "n", None)], "k int, v string, d double")
    right = [r for r in rows if r[0] not in (3, 4)] + [(9001, "new", None), (None, None, None)]
    right = [(k, None if k == 70 else v, 0.0 if k == 7 else d) for k, v, d in right]
    right = spark.createDataFrame(right, "k int, v string, d double").select("d", "v", "k")
    for ranges, levels in ((1024, 2), (4, 1), (2, 5)):
        got = {r.k: (r.left_rows, r.right_rows, r.status) for r in reconcile_by_digest(left, right, ["k"], ranges=ranges, levels=levels).collect()}
        assert got == {
            3: (1, 0, "extra"), 4: (1, 0, "extra"), 9001: (0, 1, "missing"), 5: (2, 1, "changed"), 7: (1, 1, "changed"), 70: (1, 1, "changed"),
            None: (1, 1, "changed"),
        }
    assert reconcile_by_digest(left, left.repartition(5), ["k"]).count() == 0
    assert reconcile_by_digest(left.limit(0), right, ["k"]).filter("status = 'missing'").count() == right.select("k").distinct().count()
    assert reconcile_by_digest(left, right, ["k"], ["k"]).count() == 4
    with pytest.raises(ValueError, match="two types"):
        reconcile_by_digest(left, right.withColumn("d", F.lit(1)), ["k"])


def test_equal_ranges_are_not_shuffled_by_key(spark):
    from stratawork.operators import reconcile_by_digest

    left = spark.range(100_000).withColumn("v", F.col("id") * 2)
    right = left.withColumn("v", F.when(F.col("id") == 77, 0).otherwise(F.col("v")))
    differences = reconcile_by_digest(left, right, ["id"], ranges=256)
    assert [tuple(r) for r in differences.collect()] == [(77, 1, 1, "changed")]
    assert "BroadcastHashJoin" in differences._jdf.queryExecution().executedPlan().toString()
