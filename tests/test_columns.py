"""Scalar rules on literal rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions import columns as C
from airframe.functions import sqlfuncs
from airframe.operators import airquality
from airframe.sources import tables as io


def one(spark, rows, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_sub_index_bands_gaps_and_missing(spark):
    values = [0.0, 12.0, 12.05, 12.1, 35.4, 250.5, 500.4, 500.5, None, float("nan")]
    got = one(spark, [(v,) for v in values], "v double", C.sub_index("v"))
    assert [g[0] for g in got] == [0, 50, None, 51, 100, 301, 500, None, None, None]


def test_sub_index_rounds_half_to_even(spark):
    bands = [(0.0, 10.0, 0, 10)]
    got = one(spark, [(0.5,), (1.5,), (2.5,)], "v double", C.sub_index("v", bands))
    assert [g[0] for g in got] == [0, 2, 2]


def test_sub_index_on_events_sum(spark):
    path = "/root/testdata/sf0.01/events.parquet"
    row = spark.read.parquet(path).select(C.sub_index("value").alias("s")).agg(F.count("s"), F.sum("s"), F.count_if(F.col("s").isNull())).first()
    assert tuple(row) == (9977, 1059073, 23)


def test_calculated_aqi_ignores_missing_parts(spark):
    df = spark.createDataFrame([(5.0, None, 12.05), (None, None, None)], "pm2_5 double, pm10 double, no2 double")
    assert [r["Calculated_AQI"] for r in airquality.with_calculated_aqi(df).collect()] == [21, None]


@pytest.mark.parametrize(
    "value,name",
    [(50.0, "Good"), (50.01, "Moderate"), (100.0, "Moderate"), (150.0, "Unhealthy for Sensitive Groups"), (200.0, "Unhealthy"),
     (300.0, "Very Unhealthy"), (300.1, "Hazardous"), (None, None), (float("nan"), None)],
)
def test_category(spark, value, name):
    assert one(spark, [(value,)], "v double", C.aqi_category("v"))[0][0] == name


def test_category_display_falls_back_to_the_first(spark):
    df = spark.createDataFrame([("Hazardous",), ("Nonsense",), (None,)], "category string")
    got = {r["category"]: r["color"] for r in airquality.category_display(df).collect()}
    assert got == {"Hazardous": "#7e0023", "Nonsense": "#00e400", None: "#00e400"}


def test_round_even(spark):
    got = one(spark, [(0.125,), (2.675,), (-0.125,), (None,)], "v double", C.round_even("v"))
    assert [g[0] for g in got] == [0.12, 2.68, -0.12, None]


def test_epoch_and_dates(spark):
    parts = C.epoch_parts("e")
    got = one(spark, [(1704067200,), (0,), (None,)], "e long", *parts.values())
    assert got == [(2024, 1, 1, 0), (None,) * 4, (None,) * 4]
    got = one(spark, [(2024, 2, 29), (2023, 2, 29), (None, 1, 1)], "y int, m int, d int", C.date_of("y", "m", "d"))
    assert [g[0] for g in got] == [dt.date(2024, 2, 29), None, None]


def test_token_split_and_cost(spark):
    split = C.token_split("t")
    got = one(spark, [(245,), (10,)], "t long", split["input_tokens"], split["output_tokens"])
    assert got == [(171, 74), (7, 3)]
    cost = one(spark, [(1_000_000, 500_000)], "a long, b long", C.token_cost("a", "b", F.lit(0.59), F.lit(0.79)))[0][0]
    assert cost == pytest.approx(0.985)


def test_duration(spark):
    assert one(spark, [(1.2505,)], "s double", C.duration_ms("s"))[0][0] == 1250.5


def test_render_prompt_keeps_braces_apart(spark):
    t = 'A {aqi_value} {aqi_category} {{ "k": {{{{x}}}} }}'
    got = one(spark, [(t,)], "t string", C.render_prompt("t", F.lit(15), F.lit("{{Good}}")))[0][0]
    assert got == 'A 15 {{Good}} { "k": {{x}} }'


def test_parse_answer(spark):
    rows = [
        ('```json\n{"answer":"x","sources_used":["a"],"confidence":"low"}\n```',),
        ('{"answer":"x"}',),
        ("no json",),
        ("[1]",),
        ('```\n{"answer":"y"}\n``` tail',),
        ("",),
    ]
    p = C.parse_answer("t")
    got = one(spark, rows, "t string", p["answer"], p["sources_used"], p["confidence"], p["parse_error"])
    assert got == [
        ("x", ["a"], "low", False),
        ("x", [], "unknown", False),
        (None, None, None, True),
        (None, None, None, True),
        ("y", [], "unknown", False),
        (None, None, None, True),
    ]


def test_flatten_takes_the_first_entry_and_tolerates_absence(spark):
    schema = schemas.OBSERVATION
    full = {
        "aqi": {"list": [{"main": {"aqi": 2}, "components": {"co": 1.5}, "dt": 1761832800}, {"main": {"aqi": 5}}]},
        "weather": {"temperature_2m": 28.5, "cloudcover": 40.0},
    }
    empty = {"aqi": {"list": []}, "weather": None}
    rows = spark.createDataFrame([full, empty, {"aqi": None, "weather": None}], schema).select(*C.flatten_observation()).collect()
    assert (rows[0]["aqi_index"], rows[0]["co"], rows[0]["no2"], rows[0]["temperature_2m"], rows[0]["cloud_cover"]) == (2, 1.5, None, 28.5, 40.0)
    assert (rows[0]["year"], rows[0]["month"], rows[0]["day"], rows[0]["hour"]) == (2025, 10, 30, 14)
    assert set(rows[1]) == {None} and set(rows[2]) == {None}


def test_nest_is_the_inverse_of_flatten(spark):
    df = spark.createDataFrame([(3, 9.5, 1761832800)], "aqi_index int, pm10 double, e long")
    nested = df.select(*[c.alias(n) for n, c in io.nest_observation(["aqi_index", "pm10"], F.col("e")).items()])
    row = nested.select(*C.flatten_observation()).first()
    assert (row["aqi_index"], row["pm10"], row["hour"]) == (3, 9.5, 14)


def test_cosine_and_distance(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([], []), (None, [1.0])]
    got = one(spark, rows, "a array<double>, b array<double>", C.cosine_similarity("a", "b"))
    assert [round(g[0], 9) for g in got] == [0.0, 1.0, 0.0, 0.0]
    assert one(spark, rows[:1], "a array<double>, b array<double>", C.squared_distance("a", "b"))[0][0] == 5.0


def test_sql_functions_agree_with_columns(spark):
    names = sqlfuncs.register(spark)
    assert "sub_index" in names
    row = spark.sql("SELECT sub_index(35.4D) a, aqi_category(151D) b, round_even2(0.125D) c, token_cost(1000000, 0, 0.59D, 1D) d").first()
    assert tuple(row) == (100, "Unhealthy", 0.12, 0.59)


def test_noise_is_repeatable_and_spread(spark):
    n = spark.range(2000).select(C.unit_noise(F.lit(1), "id").alias("u"))
    lo, hi, mean = n.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= lo < 0.01 and 0.99 < hi < 1 and abs(mean - 0.5) < 0.03
    assert n.repartition(7).agg(F.sum(F.round("u", 9))).first()[0] == pytest.approx(n.agg(F.sum(F.round("u", 9))).first()[0])
