"""Ordered operators against pandas, with buckets so small that values have to cross them."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from airframe.operators import ordered, quantiles, tables

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, key="a", step_hours=1):
    rows = [(key, T0 + dt.timedelta(hours=step_hours * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def column(df, name="v"):
    return [r[name] for r in df.orderBy("k", "ts").collect()]


@pytest.mark.parametrize("seconds", [3_600, 7_200, 86_400, 10**9])
def test_interpolation_example(spark, seconds):
    df = series(spark, [None, 2.0, None, None, 8.0, None])
    assert column(ordered.interpolate_linear(df, ["k"], ["ts"], ["v"], seconds=seconds)) == [2, 2, 4, 6, 8, 8]


@pytest.mark.parametrize("seconds", [3_600, 86_400])
def test_ffill_example(spark, seconds):
    assert column(ordered.ffill(series(spark, [None, 1.0, None, 3.0]), ["k"], ["ts"], ["v"], seconds=seconds)) == [None, 1, 1, 3]


def test_all_missing_stays_missing(spark):
    assert column(ordered.interpolate_linear(series(spark, [None, None]), ["k"], ["ts"], ["v"])) == [None, None]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=1, max_size=30), st.sampled_from([3_600, 5 * 3_600, 86_400]))
def test_interpolation_equals_pandas_and_is_idempotent(spark, values, seconds):
    want = pd.Series(values, dtype=float).interpolate(method="linear", limit_direction="both")
    once = ordered.interpolate_linear(series(spark, values), ["k"], ["ts"], ["v"], seconds=seconds)
    got = pd.Series(column(once), dtype=float)
    assert np.allclose(got, want, equal_nan=True)
    again = ordered.interpolate_linear(once, ["k"], ["ts"], ["v"], seconds=seconds)
    assert np.allclose(pd.Series(column(again), dtype=float), got, equal_nan=True)


def test_null_keys_form_a_series_of_their_own(spark):
    df = series(spark, [None, 4.0, None], key=None).unionByName(series(spark, [9.0, None], key="b"))
    got = ordered.ffill(df, ["k"], ["ts"], ["v"], seconds=3_600).orderBy(F.col("k").asc_nulls_first(), "ts").collect()
    assert [r["v"] for r in got] == [None, 4, 4, 9, 9]


def test_without_keys(spark):
    got = ordered.interpolate_linear(series(spark, [1.0, None, 3.0]), [], ["ts"], ["v"], seconds=3_600)
    assert column(got) == [1, 2, 3]


def test_night_rules(spark):
    rows = [
        ("a", T0 + dt.timedelta(hours=i), r, e, p)
        for i, (r, e, p) in enumerate([(None, 0.9, None), (0.5, None, 1.0), (20.0, None, None), (30.0, 0.4, 2.0), (40.0, None, None)])
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, shortwave_radiation double, et0_fao_evapotranspiration double, precipitation double")
    got = ordered.impute_readings(df, ["k"], ["ts"], seconds=3_600).orderBy("ts").collect()
    assert [r["shortwave_radiation"] for r in got] == [0, 0, 20, 30, 40]
    assert [round(r["et0_fao_evapotranspiration"], 6) for r in got] == [0, 0, 0.2, 0.4, 0.4]
    assert [r["precipitation"] for r in got] == [0, 1, 0, 2, 0]


def test_impute_policy_per_column(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), w, t, y) for i, (w, t, y) in enumerate([(10.0, 1.0, 2024), (None, None, None), (30.0, 3.0, 2024)])]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, wind_direction_10m double, temperature_2m double, year int")
    got = ordered.impute_readings(df, ["k"], ["ts"]).orderBy("ts").collect()
    assert [(r["wind_direction_10m"], r["temperature_2m"], r["year"]) for r in got] == [(10, 1, 2024), (10, 2, 2024), (30, 3, 2024)]


@pytest.mark.parametrize("n", [1, 4, 5, 11])
def test_positions_split_and_folds(spark, n):
    df = series(spark, [float(i) for i in range(n)])
    assert column(ordered.positions(df, ["k"], ["ts"], seconds=7_200), "position") == list(range(n))
    sides = column(ordered.positional_split(df, ["k"], ["ts"], seconds=7_200), "side")
    assert sides.count("reference") == int(n * 0.8) and sides == sorted(sides, reverse=True)
    folds = column(ordered.contiguous_folds(df, ["k"], ["ts"], 3, seconds=7_200), "fold")
    assert folds == [i for i, part in enumerate(np.array_split(np.arange(n), 3)) for _ in part]


def test_running_totals_with_nulls(spark):
    df = series(spark, [None, 1.0, None, 2.0, None])
    got = ordered.running_totals(df, ["k"], ["ts"], {"s": "v"}, seconds=3_600)
    assert column(got, "s") == [None, 1, 1, 3, 3]
    assert set(column(got, "_size")) == {5}


def brute_rates(points, window):
    out = []
    for i, (t, v) in enumerate(points):
        inside = [j for j in range(i + 1) if points[j][0] >= t - window]
        steps = [points[j][1] - points[j - 1][1] if points[j][1] >= points[j - 1][1] else points[j][1] for j in inside[1:]]
        if len(inside) < 2:
            out.append((None, None))
        else:
            out.append((sum(steps), sum(steps) / (t - points[inside[0]][0])))
    return out


def test_counter_rate_against_brute_force(spark):
    rng = random.Random(5)
    t, v, points = 0, 0.0, []
    for _ in range(150):
        t += rng.choice([15, 15, 30, 200, 700])
        v = 0.0 if rng.random() < 0.1 else v + rng.randint(0, 9)
        points.append((t, v))
    rows = [("a", T0 + dt.timedelta(seconds=s), x) for s, x in points]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = ordered.counter_rate(df, ["k"], "ts", "v", 300, 600).orderBy("ts").collect()
    assert len(got) == len(points)
    for r, (inc, rate) in zip(got, brute_rates(points, 300)):
        assert r["increase"] == (pytest.approx(inc) if inc is not None else None)
        assert r["rate"] == (pytest.approx(rate) if rate is not None else None)
    for (a, b), r in zip(zip(points, points[1:]), got[1:]):
        step = b[1] - a[1] if b[1] >= a[1] else b[1]
        assert r["irate"] == (pytest.approx(step / (b[0] - a[0])) if b[0] - a[0] <= 300 else None)


def test_walk_matches_the_recursion(spark):
    df = spark.createDataFrame([("a", i, 10.0) for i in range(40)], "k string, step long, x double")
    got = [r["x"] for r in ordered.multiplicative_walk(df, ["k"], "step", ["x"], bucket_steps=7).orderBy("step").collect()]
    assert got[0] == 10
    ratios = [b / a for a, b in zip(got, got[1:])]
    assert all(0.97 <= r < 1.03 for r in ratios) and len({round(r, 9) for r in ratios}) > 30
    other = [r["x"] for r in ordered.multiplicative_walk(df.repartition(5), ["k"], "step", ["x"], bucket_steps=13).orderBy("step").collect()]
    assert np.allclose(got, other)


def test_hour_spine_starts_at_the_next_full_hour(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 2, 28, 22, 15))], "k string, o timestamp_ntz")
    got = ordered.hour_spine(df, "o", 3, ["k"]).orderBy("step").collect()
    assert [(r["step"], r["ts"].isoformat(), r["day"], r["hour"]) for r in got] == [
        (0, "2024-02-28T23:00:00", 28, 23), (1, "2024-02-29T00:00:00", 29, 0), (2, "2024-02-29T01:00:00", 29, 1)]


def test_recent(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("g"))
    assert [r["id"] for r in ordered.recent(df, ["id"], 4).collect()] == [49, 48, 47, 46]
    per = ordered.recent(df, ["id"], 2, ["g"]).groupBy("g").agg(F.sum("id").alias("s")).orderBy("g").collect()
    assert [r["s"] for r in per] == [48 + 45, 49 + 46, 47 + 44]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60))
def test_exact_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = {r["q"]: r["value"] for r in quantiles.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert all(got[q] == pytest.approx(np.quantile(values, q)) for q in got) and len(got) == 5


def test_quantiles_with_a_dominant_value_and_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(6000).select(F.when(F.col("id") < 2500, 7.0).otherwise(F.col("id") * F.col("id") % 1009).cast("double").alias("x"))
        values = [r["x"] for r in df.collect()]
        got = {r["q"]: r["value"] for r in quantiles.exact_quantiles(df, ["x"], [0.1, 0.37, 0.5, 0.99]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(got[q] == pytest.approx(np.quantile(values, q)) for q in (0.1, 0.37, 0.5, 0.99))


def test_describe_matches_pandas(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1.0, 2.5, 9.0, -4.0]), float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double")
    want = df.toPandas().describe()
    for exact in (True, False):
        for r in tables.describe_table(df, exact=exact).collect():
            w = want[r["column"]]
            assert r["count"] == w["count"]
            assert [r["mean"], r["std"], r["min"], r["max"]] == pytest.approx([w["mean"], w["std"], w["min"], w["max"]])
            if exact:
                assert [r["q25"], r["q50"], r["q75"]] == pytest.approx([w["25%"], w["50%"], w["75%"]])


def test_counter_rate_with_resets_and_nulls_next_to_whole_windows(spark):
    rng = random.Random(11)
    rows = [("k", t, None if rng.random() < 0.1 else rng.randrange(40)) for t in sorted(rng.sample(range(4000), 300))]
    df = spark.createDataFrame(rows, "k string, s long, v long").selectExpr("k", "timestamp_seconds(s) AS ts", "s", "v")
    steps = []
    for i, (_, t, v) in enumerate(rows):
        before = rows[i - 1][2] if i else None
        steps.append((t, None if v is None or before is None else v if v < before else v - before))
    for window in (7, 90, 600):
        want = {}
        for t, _ in steps:
            inside = [s for s in steps if t - window <= s[0] <= t]
            known = [d for _, d in inside if d is not None]
            want[t] = sum(known) - (inside[0][1] or 0) if len(inside) > 1 and known else None
        got = {r.s: r.increase for r in ordered.counter_rate(df, ["k"], "ts", "v", window, 1000).collect()}
        assert got == want


def crowded(spark):
    """900 of 1,000 rows on one day, two thirds of them in one series; a NULL key, missing values."""
    rng = random.Random(5)
    rows = []
    for i in range(1_000):
        day = 40 if i < 900 else i % 80
        key = None if i % 50 == 7 else "a" if i % 3 else "b"
        rows.append((key, T0 + dt.timedelta(days=day, microseconds=i), i, None if rng.random() < 0.4 else float(i % 17)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, i long, v double"), rows


def test_one_day_with_most_rows_is_many_ranges(spark):
    df, rows = crowded(spark)
    for keys in ([], ["k"]):
        sizes = [r["count"] for r in ordered.ranged(df, keys, ["ts", "i"]).groupBy(ordered.RANGE).count().collect()]
        assert sum(sizes) == 1_000 and len(sizes) > 8 and max(sizes) < 200
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    placed = {r.i: r.position for r in ordered.positions(df, [], ["ts", "i"]).collect()}
    assert placed == {r[2]: n for n, r in enumerate(order)}
    sides = {r.i: r.side for r in ordered.positional_split(df, [], ["ts", "i"]).collect()}
    assert sides == {r[2]: "reference" if n < 800 else "current" for n, r in enumerate(order)}
    folds = {r.i: r.fold for r in ordered.contiguous_folds(df, [], ["ts", "i"], 3).collect()}
    assert folds == {r[2]: 0 if n < 334 else 1 if n < 667 else 2 for n, r in enumerate(order)}


def test_ranges_change_no_result(spark):
    df, rows = crowded(spark)
    daily, even = (
        {r.i: r.v for r in ordered.interpolate_linear(df, ["k"], ["ts", "i"], ["v"], seconds=s).collect()} for s in (86_400, None)
    )
    assert len(even) == 1_000 and even.keys() == daily.keys()
    assert all(daily[i] == pytest.approx(even[i]) for i in daily)
    places = {r.i: r.position for r in ordered.positions(df, ["k"], ["ts", "i"]).collect()}
    for key in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [places[r[2]] for r in own] == list(range(len(own)))
    assert ordered.positions(df.limit(0), ["k"], ["ts", "i"]).count() == 0
