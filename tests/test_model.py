"""Dimensions, stars, joins, sequences and the weather chain."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratawork import fixed_values
from stratawork.operators import (
    calendar_rollup,
    code_list,
    daily_rollup,
    dense_sequence,
    describe_columns,
    flatten_star,
    join_reference,
    lookup,
    measured_bytes,
    merge_upsert,
    orphan_rows,
    reconcile_keys,
    typed,
    unpivot_by_codes,
    with_codes,
)
from stratawork.plans import calendar, calendar_dimension, date_spine, holidays, time_dimension, time_of_day, year_span
from stratawork.plans import weather


def days(spark, start=2000, end=2036):
    spine = date_spine(spark, start, end)
    return calendar(
        spine, fixed_values.months(spark), fixed_values.weekdays(spark), holidays(spine, fixed_values.nl_holidays(spark))
    )


def test_spine_is_exact(spark):
    spine = date_spine(spark, 2000, 2036)
    assert spine.count() == 13_515
    first = spine.orderBy("day").first()
    assert (first.day, first.date, first.date_time) == (36524, date(2000, 1, 1), datetime(2000, 1, 1))
    horizon = date_spine(spark).agg(F.max("date")).first()[0]
    assert horizon == date(date.today().year + 10, 12, 31)


def test_calendar_invariants(spark):
    rows = {r.date.isoformat(): r for r in days(spark).filter("date < '9999-12-31'").collect()}
    assert len(rows) + 1 == 13_517
    new_year = rows["2000-01-01"]
    assert (new_year.base_year, new_year.iso_year_nr, new_year.iso_week_nr, new_year.year_week_nr) == (1999, 1999, 52, 200052)
    # The sentinel 1900 has rank 0, so the first real period is 1; the partial ISO year counts from the spine.
    assert (new_year.year_sort, new_year.quarter_sort, new_year.month_sort, new_year.day_sort, new_year.week_sort) == (1,) * 5
    assert (new_year.iso_year_sort, new_year.iso_year_day_nr) == (1, 1)
    sentinel = rows["1900-01-01"]
    assert sentinel.day_sort is None and sentinel.first_date_of_year == date(1900, 1, 1)
    assert sentinel.is_first_day_of_year == "Y"
    leap = rows["2024-02-29"]
    assert (leap.is_leap_day, leap.is_last_day_of_month, leap.is_leap_year, leap.month_code) == ("Y", "Y", "Y", "M02")
    assert rows["2024-05-04"].is_high_generation_day and not rows["2024-05-06"].is_high_generation_day
    assert rows["2024-12-02"].is_high_consumption_day and not rows["2024-12-01"].is_high_consumption_day
    for text, row in rows.items():
        iso = date.fromisoformat(text).isocalendar()
        assert (row.iso_year_nr, row.iso_week_nr, row.day_of_week_nr) == tuple(iso)


def test_last_sentinel_has_no_periods(spark):
    row = days(spark, 2024, 2024).filter("date = '9999-12-31'").drop("date", "date_time").drop(
        "first_date_of_week"
    ).first()
    assert row.last_date_of_year is None and row.year_sort is None and row.is_last_day_of_year == "N"


def test_calendar_dimension_key(spark):
    dim = calendar_dimension(days(spark, 2024, 2024))
    assert dim.filter("id_dim__common__calendar <> date_simple").count() == 0
    assert len(dim.columns) == 16


def test_dutch_holidays(spark):
    named = {r.date.isoformat(): r.holiday_name for r in holidays(date_spine(spark, 2008, 2026), fixed_values.nl_holidays(spark)).collect()}
    assert named["2013-04-30"] == "Koninginnedag"
    assert named["2014-04-26"] == "Koningsdag"  # the 27th was a Sunday
    assert named["2024-04-27"] == "Koningsdag"
    assert "2024-05-05" not in named and named["2025-05-05"] == "Bevrijdingsdag"
    # Queen's Day and Ascension Day met in 2008.
    assert named["2008-04-30"] == "Koninginnedag" and named["2008-05-01"] == "Hemelvaartsdag"
    assert (named["2024-03-31"], named["2024-05-19"], named["2024-12-26"]) == (
        "Eerste paasdag",
        "Eerste Pinksterdag",
        "Tweede Kerstdag",
    )


def test_time_of_day(spark):
    times = time_dimension(time_of_day(spark))
    assert times.count() == 86_400
    assert times.select("id_dim__common__time").distinct().count() == 86_400
    # Numbered as windows over the complete day would number them.
    hour = F.dense_rank().over(Window.orderBy("hour_nr"))
    second = F.row_number().over(Window.partitionBy("hour_nr", "minute_nr").orderBy("second_nr"))
    assert times.withColumn("h", hour).withColumn("s", second).filter("h <> hour_sort or s <> second_sort").count() == 0
    parts = {r.hour_nr: (r.day_part, r.day_part_sort, r.day_part_alt, r.day_part_alt_sort) for r in times.filter("minute_nr = 0 and second_nr = 0").collect()}
    assert parts[4] == parts[21] == ("night", 4, "night", 8)
    assert parts[5] == ("morning", 1, "morning (early)", 1)
    assert parts[11] == ("morning", 1, "morning (late)", 3)
    assert parts[16] == ("afternoon", 2, "afternoon (late)", 5)
    assert parts[20] == ("evening", 3, "evening", 7)


def test_typed_cuts_to_width(spark):
    row = typed(spark.createDataFrame([("abcdef", "12")], "a string, b string"), [("a", "a", "char(3)"), ("b", "n", "int")]).first()
    assert (row.a, row.n) == ("abc", 12)


def test_descriptions_survive_a_write(spark, tmp_path):
    described = describe_columns(spark.range(1), {"id": "Number."})
    described.write.parquet(str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).schema["id"].metadata["comment"] == "Number."
    with pytest.raises(ValueError):
        describe_columns(spark.range(1), {"nope": "x"})


def test_unpivot_drops_missing_values_and_unknown_codes(spark):
    wide = spark.createDataFrame([(1, 10, None), (2, 20, 2.5)], "t int, a int, b double")
    codes = spark.createDataFrame([("T",), ("B",), ("X",)], "code string")
    columns = {"T": "a", "B": "b", "Z": "a"}
    long = unpivot_by_codes(wide, ["t"], columns, code_list(codes, "code", columns))
    assert sorted(map(tuple, long.collect())) == [(1, "T", Decimal(10)), (2, "B", Decimal("2.50")), (2, "T", Decimal(20))]


def test_unpivot_without_a_matching_code_and_with_a_repeated_one(spark):
    wide = spark.createDataFrame([(1, 10)], "t int, a int")
    none = unpivot_by_codes(wide, ["t"], {"T": "a"}, ["X"], "the code")
    assert none.collect() == [] and dict(none.dtypes) == {"t": "int", "the code": "string", "value": "decimal(10,2)"}
    assert unpivot_by_codes(wide, ["t"], {"T": "a"}, ["T", "T"]).count() == 2


def test_many_codes(spark):
    codes = spark.range(1001).selectExpr("concat('c', id) as code")
    assert with_codes(spark.range(2), codes).count() == 2002
    wide = spark.createDataFrame([(1, 10)], "t int, a int")
    names = {f"c{k}": "a" for k in range(1001)}
    assert unpivot_by_codes(wide, ["t"], names, code_list(codes, "code", names)).count() == 1001
    rules = spark.range(1001).selectExpr(
        "concat('h', id) as holiday_name", "1 as month", "1 as day", "cast(null as int) as easter_offset",
        "cast(null as int) as first_year", "cast(null as int) as last_year", "cast(null as int) as every_years",
        "cast(null as int) as sunday_shift",
    )
    named = holidays(date_spine(spark, 2024, 2024), rules).first()
    assert named.holiday_name.count(";") == 1000


def test_nth_weekday_rules(spark):
    rules = spark.createDataFrame(
        [("third Monday", 1, 3, 1), ("last Monday", 5, -1, 1), ("fifth Friday", 2, 5, 5), ("fourth Thursday", 11, 4, 4)],
        "holiday_name string, month int, nth int, weekday_nr int",
    ).selectExpr("*", *[f"cast(null as int) as {c}" for c in ("day", "easter_offset", "first_year", "last_year", "every_years", "sunday_shift")])
    found = {r.holiday_name: r.date.isoformat() for r in holidays(date_spine(spark, 2024, 2024), rules).collect()}
    assert found == {"third Monday": "2024-01-15", "last Monday": "2024-05-27", "fourth Thursday": "2024-11-28"}


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_broadcast_and_shuffled_joins_agree_with_a_plain_join(spark, how, max_bytes):
    # A third of the rows share one key, some have none, some have a key without a partner.
    large = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k")
    )
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(str, large.join(small, ["k"], how).collect()))
    assert sorted(map(str, join_reference(large, small, ["k"], how, max_bytes=max_bytes).collect())) == plain


def test_a_hot_key_is_split_at_run_time(spark):
    large = spark.range(400_000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("k"), F.uuid().alias("v"))
    small = spark.range(400_000).select(F.col("id").alias("k"), F.uuid().alias("w"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = join_reference(large.repartition(8), small, ["k"], "inner", max_bytes=0)
        assert joined.count() >= 360_000
        query = joined.select("k", "v", "w")
        query.write.format("noop").mode("overwrite").save()
        query.collect()
        assert "skew=true" in query._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_keys_are_widened_the_same_way_on_both_paths(spark, max_bytes):
    decimals = spark.createDataFrame([(Decimal("1.5"), "x"), (Decimal("2.0"), "y")], "k decimal(3,1), name string")
    numbers = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    texts = spark.createDataFrame([("01", "zero-one"), ("2", "two")], "k string, name string")
    longs = spark.createDataFrame([(1, "one"), (1 << 40, "big")], "k bigint, name string")

    def names(reference):
        rows = join_reference(numbers, reference, ["k"], max_bytes=max_bytes)
        assert dict(rows.dtypes)["k"] == "int"
        return sorted((r.k, r.name) for r in rows.collect() if r.name)

    assert (names(decimals), names(texts), names(longs)) == ([(2, "y")], [(2, "two")], [(1, "one")])
    dim = decimals.withColumn("dim_key", F.concat(F.lit("d"), "name"))
    keyed = lookup(numbers, dim, "k", "dim_key", max_bytes=max_bytes)
    assert sorted(map(tuple, keyed.collect())) == [(1, "-2"), (2, "dy"), (3, "-2")]
    flat = flatten_star(numbers, [(texts, "k", ["name"])], max_bytes=max_bytes)
    assert [r.name for r in flat.collect()] == ["two"]
    orphans = orphan_rows(numbers, "k", spark.createDataFrame([(Decimal("1.2"),), (Decimal("3.0"),)], "p decimal(3,1)"), "p", max_bytes=max_bytes)
    assert sorted(r.k for r in orphans.collect()) == [1, 2]
    with pytest.raises(ValueError, match="exactly"):
        join_reference(numbers, spark.createDataFrame([(1.0,)], "k double"), ["k"])


def test_only_reference_joins(spark):
    with pytest.raises(ValueError):
        join_reference(spark.range(1), spark.range(1), ["id"], "full")


def test_measured_size_counts_text(spark):
    short = spark.range(10).withColumn("t", F.lit("x"))
    assert measured_bytes(short.withColumn("t", F.repeat(F.lit("x"), 1001))) - measured_bytes(short) == 10_000


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_lookup_and_flatten(spark, max_bytes):
    dim = spark.createDataFrame([("k1", 1, "one"), ("-2", None, "unknown"), ("k3", 3, "three")], "dim_key string, code long, name string")
    fact = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "code int, v string")
    keyed = lookup(fact, dim, "code", "dim_key", max_bytes=max_bytes)
    assert sorted((r.v, r.dim_key) for r in keyed.collect()) == [("a", "k1"), ("b", "-2"), ("c", "k3"), ("d", "-2")]
    flat = flatten_star(keyed.drop("code"), [(dim, "dim_key", ["name"])], max_bytes=max_bytes)
    assert sorted(map(tuple, flat.collect())) == [("a", "one"), ("b", "unknown"), ("c", "three"), ("d", "unknown")]


def test_reconcile(spark):
    produced = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    declared = spark.createDataFrame([("b",), ("c",), ("c",)], "key string")
    assert sorted(map(tuple, reconcile_keys(produced, declared, ["key"]).collect())) == [("a", "warn"), ("c", "error")]


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_dense_sequence_is_dense_rank(spark, max_bytes):
    df = spark.range(2000).select(
        "id",
        F.when(F.col("id") % 11 != 0, (F.col("id") * 37) % 401).alias("a"),
        ((F.col("id") * 13) % 5).cast("string").alias("b"),
    )
    ranked = dense_sequence(df, ["a", "b"], start=0, max_bytes=max_bytes)
    expected = df.withColumn("r", F.dense_rank().over(Window.orderBy("a", "b")) - 1)
    assert ranked.join(expected, "id").filter("sequence_nr <> r").count() == 0
    assert ranked.count() == 2000


@pytest.mark.parametrize("max_bytes", [0, 1 << 26])
def test_dense_sequence_compares_values(spark, max_bytes):
    df = spark.createDataFrame([(0, -0.0), (1, 0.0), (2, None), (3, 1.5), (4, float("nan")), (5, None)], "id int, x double")
    ranked = {r.id: r.sequence_nr for r in dense_sequence(df, ["x"], max_bytes=max_bytes).collect()}
    assert ranked == {2: 1, 5: 1, 0: 2, 1: 2, 3: 3, 4: 4}


def test_dense_sequence_across_a_clock_change(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        hours = spark.range(8).select("id", F.timestamp_seconds(F.col("id") * 1800 + 1729983600).alias("at"))
        ranked = dense_sequence(hours, ["at"], start=0).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted((r.id, r.sequence_nr) for r in ranked) == [(k, k) for k in range(8)]


def test_sentinels_occur_once(spark):
    facts = spark.createDataFrame(
        [("1900-01-01", 1), ("9999-12-31", 2), ("1901-03-01", 3), ("2024-02-29", 4)], "day string, v int"
    ).select(F.col("day").cast("date").alias("date"), "v")
    assert year_span(facts, "date") == (1901, 2024)
    spine = date_spine(spark, 1900, 1902)
    full = calendar(spine, fixed_values.months(spark), fixed_values.weekdays(spark), holidays(spine, fixed_values.nl_holidays(spark)))
    assert full.count() == spine.count() + 1 and full.groupBy("date").count().filter("count > 1").count() == 0
    assert join_reference(facts, full.select("date", "year_sort", "day_sort"), ["date"]).count() == 4
    assert full.filter("date = date'1900-01-01' and year_sort is null").count() == 1
    second = full.filter("date = date'1900-01-02'").first()
    assert (second.day_sort, second.year_sort, second.month_sort, second.week_sort) == (1, 1, 1, 1)


def test_daily_rollup_moves_hour_24_back(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01 01:00:00", 2), (1, "2024-01-02 00:00:00", 4), (1, "2024-01-02 01:00:00", 8)], "s int, ts string, v int"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rolled = daily_rollup(rows, ["s"], "ts", [F.count("*").alias("n"), F.sum("v").alias("v")], shift=-1)
    assert sorted((r.day.isoformat(), r.n, r.v) for r in rolled.collect()) == [("2024-01-01", 2, 6), ("2024-01-02", 1, 8)]


def test_calendar_rollup_counts_daily_counts(spark):
    dim = calendar_dimension(days(spark, 2024, 2024))
    fact = spark.createDataFrame([(20240101, 1), (20240101, None), (20240131, 5), (20240201, 7)], "id_dim__common__calendar int, v int")
    rolled = calendar_rollup(fact.withColumn("w", F.col("v")), dim, "id_dim__common__calendar", ["month_nr"], {"v": "sum", "w": "count"})
    assert sorted(map(tuple, rolled.collect())) == [(1, 6, 2), (2, 7, 1)]


@pytest.fixture
def landed(spark):
    """Two overlapping loads; the second corrects a value. Station 999 is not in the seed."""

    def load(load_id, first, last, t):
        rows = []
        day = first
        while day <= last:
            for station in (260, 380, 999):
                for hour in (1, 24):
                    rain = -1 if hour == 1 else None if day.day == 31 else 12
                    rows.append((station, day.isoformat(), hour, t, 35, rain, 7, 88, None, None, load_id))
            day += timedelta(days=1)
        return spark.createDataFrame(
            rows,
            "station_code bigint, date string, hour bigint, t bigint, fh bigint, rh bigint, q bigint, u bigint, "
            "ww bigint, ix bigint, _load_id string",
        )

    first = load("1735603200.5731854", date(2024, 12, 29), date(2024, 12, 31), 57)
    second = load("1735689600.5731854", date(2024, 12, 30), date(2025, 1, 1), 60)
    return merge_upsert(first, second, ["station_code", "date", "hour"], ["_load_id"])


def test_weather_chain(spark, landed):
    assert landed.count() == 4 * 3 * 2
    staged = weather.stage_observations(landed)
    new_year = staged.filter("observed_at = timestamp_ntz'2025-01-01 00:00:00' and station_code = 260").first()
    assert (new_year.temperature_celsius, new_year.precipitation_mm, new_year.wind_speed_ms) == (Decimal("6.0"), None, Decimal("3.5"))
    unknown = fixed_values.unknown_members(spark)
    types = weather.stage_measurement_types(fixed_values.measurement_types(spark))
    stations = weather.station_dimension(weather.stage_stations(fixed_values.stations(spark)), unknown)
    type_dim = weather.measurement_type_dimension(types, unknown)
    assert (stations.count(), type_dim.count()) == (7 + 3, 5 + 3)
    missing = stations.filter("id_dim__weather__knmi_station = '-2'").first()
    assert (missing.station_code, missing.station_name, missing.latitude) == (-2, "<< unknown >>", None)

    long = weather.measurements(staged, types)
    assert long.count() == 24 * 5 - 3  # no rainfall in hour 24 of the 31st
    fact = weather.measurement_fact(long, stations, type_dim)
    assert fact.count() == long.count()
    assert fact.select("id_fct__weather__knmi_measurement").distinct().count() == fact.count()
    # Hour 24 belongs to the day it ends.
    last = fact.filter("observed_at = timestamp_ntz'2025-01-01 00:00:00'").select("id_dim__common__calendar", "id_dim__common__time").distinct()
    assert list(map(tuple, last.collect())) == [(20241231, 230000)]
    assert fact.filter("id_dim__weather__knmi_station = '-2'").count() == 39

    flat = weather.station_weather(fact, stations, type_dim)
    assert flat.count() == fact.count()
    rain = flat.filter("measurement_type_code = 'RH' and hour(observed_at) = 1").select("measurement_value").distinct()
    assert [r[0] for r in rain.collect()] == [Decimal("0.05")]
    assert flat.filter("station_code = -2").count() == 39


def test_environment_dimension(spark):
    dim = weather.environment_dimension(
        weather.stage_environments(fixed_values.environments(spark)), fixed_values.unknown_members(spark)
    )
    assert dim.count() == 5 + 3
    row = dim.filter("id_dim__common__environment = '-1'").first()
    assert (row.environment_alias, row.environment_desc, row.environment_sort) == ("<< empty >>", "", -1)
