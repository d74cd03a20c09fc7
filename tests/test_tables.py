"""Aggregates, joins, drift, telemetry, models, files and streams on small rows."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airframe import schemas
from airframe.operators import drift, forecast, models, ordered, scoring, tables, telemetry
from airframe.plans import runs
from airframe.session import new_path, shared_folder, spread
from airframe.sources import tables as io
from airframe.streaming import streams

T0 = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- tables


def test_null_summary_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None), (None, "x", None)], "a int, b string, c double")
    assert [(r["column"], r["nulls"]) for r in tables.null_summary(df).collect()] == [("c", 2), ("a", 1), ("b", 1)]
    assert tables.drop_all_null_columns(df).columns == ["a", "b"]


def test_dedup_treats_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert tables.dedup_rows(df).count() == 2


def test_model_columns_drop_targets_and_times(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, T0)], "aqi_index int, Calculated_AQI double, f double, at timestamp")
    assert tables.model_columns(df) == ["f"]


def test_required_columns(spark):
    history = spark.createDataFrame([(1.0, 4.0), (3.0, 8.0)], "a double, b double")
    got = tables.required_columns(history.select("a"), history, ["b", "a"]).collect()
    assert sorted(tuple(r) for r in got) == [(6.0, 1.0), (6.0, 3.0)]


def test_category_counts_and_breakdown(spark):
    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "c string")
    assert [(r["c"], r["n"]) for r in tables.category_counts(df, "c").collect()] == [("Unknown", 1), ("x", 2), ("y", 1)]
    assert [(r["c"], r["pct"]) for r in tables.category_breakdown(df.dropna(), "c").limit(1).collect()] == [("x", pytest.approx(200 / 3))]


# ---------------------------------------------------------------- forecast


def hourly(spark, rows, key="s"):
    return spark.createDataFrame([(key, T0 + dt.timedelta(hours=h), float(v)) for h, v in rows], "k string, ts timestamp_ntz, v double")


@pytest.mark.parametrize("months,tier", [([(2024, 1), (2023, 12), (2022, 1)], 1), ([(2023, 12), (2022, 1)], 2), ([(2022, 1), (2023, 5)], 3), ([(2023, 5)], None)])
def test_recent_baseline_tiers(spark, months, tier):
    df = spark.createDataFrame([("a", y, m) for y, m in months], "k string, year int, month int")
    got = forecast.recent_baseline(df, ["k"], 2024, 1).collect()
    assert [r["tier"] for r in got] == ([tier] if tier else [])
    assert len(forecast.recent_baseline(df, [], 2024, 1).collect()) == len(got)


def test_good_and_avoid_hours(spark):
    low = hourly(spark, [(i, 40 + i) for i in range(15)])
    assert [r["v"] for r in forecast.good_hours(low, ["k"], "v", "ts").orderBy("rank").collect()] == [40, 41, 42, 43, 44]
    few = hourly(spark, [(0, 90), (1, 50), (2, 80), (3, 120)])
    assert [r["v"] for r in forecast.good_hours(few, ["k"], "v", "ts").collect()] == [50]
    none = hourly(spark, [(0, 90), (1, 100), (2, 101)])
    assert [r["v"] for r in forecast.good_hours(none, [], "v", "ts").orderBy("rank").collect()] == [90, 100]
    assert [r["v"] for r in forecast.avoid_hours(none, ["k"], "v", "ts").collect()] == [101]


def test_hourly_pattern_falls_back_to_the_series_mean(spark):
    df = hourly(spark, [(0, 2), (24, 4), (1, 9)]).withColumn("hour", F.hour("ts"))
    got = {r["hour"]: r["v"] for r in forecast.hourly_pattern(df, ["k"], ["v"]).collect()}
    assert len(got) == 24 and got[0] == 3 and got[1] == 9 and got[5] == 5


def test_insights_take_the_first_of_equal_extremes(spark):
    df = hourly(spark, [(0, 5), (1, 1), (2, 9), (3, 9), (4, 1)])
    r = forecast.forecast_insights(df, ["k"], "v", "ts").first()
    assert (r["min_at"].hour, r["max_at"].hour, r["mean"]) == (1, 2, 5)
    assert r["std"] == pytest.approx(np.std([5, 1, 9, 9, 1], ddof=1))
    s = forecast.forecast_stats(df, ["k"], ["v"]).first()
    assert s["std_v"] == round(float(np.std([5, 1, 9, 9, 1])), 2)


def test_daily_summary_has_exactly_the_days(spark):
    df = hourly(spark, [(23, 10), (24, 60), (25, 61.005), (80, 400)]).withColumn("w", F.col("v") * 2)
    got = forecast.daily_summary(df, ["k"], "ts", "v", "w", 3).orderBy("date").collect()
    assert [(r["date"].day, r["min_aqi_index"], r["aqi_category"]) for r in got] == [(1, 10, "Good"), (2, 60, "Moderate"), (3, None, None)]


def test_prediction_spine_and_long_horizon(spark):
    rows = [("s", T0 + dt.timedelta(hours=h), h % 24, float(h % 24), 1.0) for h in range(100)]
    df = spark.createDataFrame(rows, "station string, ts timestamp_ntz, hour int, temperature_2m double, pm10 double")
    got = runs.predict(df, ["temperature_2m", "pm10"], {"aqi_index": F.col("pm10") * 60, "Calculated_AQI": F.col("temperature_2m")}, 24)
    rows = got.orderBy("step").collect()
    assert len(rows) == 24 and rows[0]["datetime"] == "2024-01-05 04:00" and {r["aqi_category"] for r in rows} == {"Moderate"}
    assert runs.predict(df, ["pm10"], {"aqi_index": F.col("pm10")}, 500).count() == 500
    with pytest.raises(ValueError):
        runs.predict(df, ["pm10"], {"aqi_index": F.col("pm10")}, 0)


# ---------------------------------------------------------------- telemetry


def test_price_default_and_cost(spark):
    df = spark.createDataFrame([("gemma2-9b-it", 1000), ("new-model", 1000)], "model string, tokens long")
    got = {r["model"]: r["cost_usd"] for r in telemetry.with_cost(df).collect()}
    assert got == {"gemma2-9b-it": pytest.approx(0.0002), "new-model": pytest.approx(0.001)}


def test_histogram_and_quantiles(spark):
    values = [0.05, 0.1, 0.2, 0.3, 0.6, 40.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    h = telemetry.bucket_histogram(df, "v", [0.1, 0.25, 0.5, 1.0])
    assert [(r["le"], r["cum"]) for r in h.orderBy("le").collect()] == [(0.1, 2), (0.25, 3), (0.5, 4), (1.0, 5), (math.inf, 6)]
    q = {r["q"]: r["value"] for r in telemetry.histogram_quantile(h, [0.1, 0.5, 0.75, 0.99]).collect()}
    assert q[0.1] == pytest.approx(0.03) and q[0.5] == pytest.approx(0.25) and q[0.75] == pytest.approx(0.75) and q[0.99] == 1.0
    qs = [r["value"] for r in telemetry.histogram_quantile(h, [i / 20 for i in range(1, 20)]).orderBy("q").collect()]
    assert qs == sorted(qs)
    empty = telemetry.bucket_histogram(df.limit(0), "v", [1.0])
    assert [r["value"] for r in telemetry.histogram_quantile(empty, [0.5]).collect()] == [None]


def test_empty_log_totals(spark):
    ddl = "input_tokens long, output_tokens long, cost_usd double, latency_seconds double"
    assert tuple(telemetry.usage_totals(spark.createDataFrame([], ddl)).first()) == (0, 0, 0, 0.0, 0.0)
    none = spark.createDataFrame([], "event_type string")
    assert telemetry.guard_event_stats(none).first()["block_rate"] == 0.0
    assert {r["n"] for r in telemetry.guard_event_counts(none).collect()} == {0}


def test_metric_names_must_match_fully(spark):
    df = spark.createDataFrame([(n,) for n in ("llm_x", "my_llm_x", "guardrail_events_total", "up", "rag_")], "name string")
    assert {r["name"] for r in telemetry.metric_keep(df).collect()} == {"llm_x", "guardrail_events_total", "rag_"}


def test_safety_status(spark):
    rows = [("in", 1, True, False), ("in", 2, False, True), ("out", 1, False, True), ("out", 2, True, False), ("new", 1, False, False)]
    df = spark.createDataFrame(rows, "stage string, ts int, blocked boolean, reset boolean")
    assert {r["stage"]: r["status"] for r in telemetry.safety_status(df).collect()} == {"in": 1, "out": 0, "new": 1}


def test_query_status_order(spark):
    rows = [(False, 0, False, False), (True, 0, False, False), (True, 2, False, False), (True, 2, True, False), (True, 2, True, True)]
    df = spark.createDataFrame(rows, "i boolean, d int, g boolean, o boolean")
    got = [r[0] for r in df.select(telemetry.query_status("i", "d", "g", "o")).collect()]
    assert got == ["blocked_input", "no_documents", "generation_error", "blocked_output", "success"]


def test_resource_and_alerts(spark):
    rows = [("h", "avail", 1, 5.0), ("h", "avail", 2, 25.0), ("h", "total", 2, 100.0)]
    df = spark.createDataFrame(rows, "instance string, name string, ts int, value double")
    assert telemetry.used_percent(df, "instance", "name", "avail", "total").first()["used_percent"] == 75.0
    ind = spark.createDataFrame([("avg_confidence", 0.6), ("error_rate", 0.06), ("hourly_cost_usd", 0.5)], "indicator string, value double")
    assert {r["indicator"]: r["level"] for r in telemetry.alert_levels(ind).collect()} == {
        "avg_confidence": "warning", "error_rate": "critical", "hourly_cost_usd": "ok"}


# ---------------------------------------------------------------- drift


def test_drift_of_equal_and_shifted_parts(spark):
    rng = np.random.default_rng(2)
    ref, cur = rng.normal(size=400), rng.normal(size=300) + 0.8
    rows = [("reference", float(x), float(i % 7)) for i, x in enumerate(ref)] + [("current", float(x), float(i % 7)) for i, x in enumerate(cur)]
    df = spark.createDataFrame(rows, "side string, x double, same double")
    grid = np.sort(np.concatenate([ref, cur]))
    f1, f2 = (np.searchsorted(np.sort(a), grid, side="right") / len(a) for a in (ref, cur))
    ks = {r["column"]: r for r in drift.ks_statistic(df, ["x", "same"]).collect()}
    assert ks["x"]["statistic"] == pytest.approx(np.abs(f1 - f2).max()) and ks["x"]["p_value"] < 1e-6
    assert ks["same"]["statistic"] < 0.01 and ks["same"]["p_value"] == 1.0
    w = {r["column"]: r for r in drift.wasserstein(df, ["x", "same"]).collect()}
    want = (np.abs(f1 - f2)[:-1] * np.diff(grid)).sum()
    assert w["x"]["distance"] == pytest.approx(want) and w["x"]["normalised"] == pytest.approx(want / ref.std())
    d = drift.dataset_drift(drift.wasserstein(df, ["x", "same"]), "normalised", 0.1).first()
    assert (d["columns"], d["drifted"], d["share"], d["dataset_drift"]) == (2, 1, 0.5, True)


def test_category_and_embedding_drift(spark):
    rows = [("reference", "a")] * 3 + [("reference", "b")] + [("current", "c")] * 2
    df = spark.createDataFrame(rows, "side string, c string")
    assert drift.category_drift(df, ["c"]).first()["distance"] == pytest.approx(math.sqrt(math.log(2)))
    rng = np.random.default_rng(4)
    vec = [("reference", rng.normal(size=6).tolist()) for _ in range(60)] + [("current", (rng.normal(size=6) + 3).tolist()) for _ in range(60)]
    e = spark.createDataFrame(vec, "side string, v array<double>")
    got = drift.embedding_drift(e, "v", 2).collect()
    assert len(got) == 2 and max(r["statistic"] for r in got) > 0.5


# ---------------------------------------------------------------- models


def line(spark, n=300):
    rng = np.random.default_rng(0)
    x, z, e = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n) * 0.1
    rows = [(i, float(a), float(b), float(3 * a - 1 + c), float(a + b)) for i, (a, b, c) in enumerate(zip(x, z, e))]
    return spark.createDataFrame(rows, "i long, x double, z double, y1 double, y2 double")


def test_random_split_is_stable(spark):
    df = spark.range(5000)
    a = models.random_split(df, ["id"])
    b = models.random_split(df.repartition(9), ["id"])
    assert a.exceptAll(b).count() == 0
    assert abs(a.filter("part = 'test'").count() / 5000 - 0.2) < 0.02


def test_ridge_equals_the_closed_form(spark):
    df = line(spark)
    pdf = df.toPandas()
    rows, spread_ = models.label_stats(df, ["y1"])
    m = models.fit_one(df, ["x", "z"], models.train_ridge("y1", rows, spread_["y1"], alpha=50.0)).stages[-1]
    a = pdf[["x", "z"]].to_numpy() - pdf[["x", "z"]].to_numpy().mean(0)
    b = pdf["y1"].to_numpy() - pdf["y1"].mean()
    want = np.linalg.solve(a.T @ a + 50 * np.eye(2), a.T @ b)
    assert m.coefficients.toArray() == pytest.approx(want, abs=1e-6)


def test_metrics_and_ties(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 1.0)], "y double, p double")
    r = models.regression_metrics(df, {"t": ("y", "p")}).first()
    y, p = np.array([1, 3, 0.0]), np.array([2, 3, 1.0])
    assert r["rmse_t"] == pytest.approx(np.sqrt(((y - p) ** 2).mean())) and r["mae_t"] == pytest.approx(2 / 3)
    assert r["r2_t"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    m = models.mape(df, "y", "p").first()
    assert (m["mape"], m["zero_truth"]) == (50.0, 1)
    t = spark.createDataFrame([("b", 1, 2.0), ("a", 0, 2.0), ("c", 2, 3.0)], "model string, ordinal int, avg_rmse double")
    assert models.pick_best_model(t).first()["model"] == "a"


def test_zoo_ranks_and_saves(spark):
    parts = models.random_split(line(spark), ["i"])
    table, fitted = models.train_and_rank(parts, ["x", "z"], ["y1", "y2"], trees=3, rounds=3)
    assert table.count() == 4 and models.pick_best_model(table).first()["model"] in ("Linear_Regression", "Ridge_Regression")
    path = new_path(spark, "model")
    io.save_model(fitted["Linear_Regression"]["y1"], table, path)
    assert io.load_model(path).transform(line(spark)).agg(F.max(F.abs(F.col("prediction") - F.col("y1")))).first()[0] < 1


def test_importances_find_the_useless_feature(spark):
    df = line(spark)
    model = models.fit_one(df, ["x", "z"], models.train_forest("y1", trees=5, depth=4))
    assert models.feature_importance(model, ["x", "z"], df).first()["feature"] == "x"
    perm = {r["feature"]: r["importance"] for r in models.permutation_importance(df, ["i"], ["x", "z"], "y1", model).collect()}
    assert perm["x"] > 1 and abs(perm["z"]) < 0.3
    folded = ordered.contiguous_folds(df, [], ["i"], 3, bucket=F.floor(F.col("i") / 50).cast("long"))
    kept, compared = models.drop_weak_features(folded, ["i"], ["x", "z"], "y1", models.train_linear, drop=1, k=3)
    assert kept == ["x"] and abs(compared.first()["rmse_change_pct"]) < 5


def test_hash_sample_is_repeatable(spark):
    a = {r["id"] for r in models.hash_sample(spark.range(1000), ["id"], 50).collect()}
    assert len(a) == 50 and a == {r["id"] for r in models.hash_sample(spark.range(1000).repartition(7), ["id"], 50).collect()}


# ---------------------------------------------------------------- files


def test_csv_readings_by_column_name(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("hour,pm10,extra,aqi_index\n3,12.5,x,2\n4,,y,\n")
    got = io.read_readings(spark, str(p)).orderBy("hour").collect()
    assert [(r["hour"], r["pm10"], r["aqi_index"], r["co"]) for r in got] == [(3, 12.5, 2, None), (4, None, None, None)]


def test_observations_from_array_files(spark, tmp_path):
    good, bad, other = tmp_path / "good.json", tmp_path / "bad.json", tmp_path / "other.json"
    good.write_text(json.dumps([{"aqi": {"list": [{"dt": 1}]}}, {"weather": {"precipitation": 0.5}}], indent=1))
    bad.write_text('[{"aqi": ')
    other.write_text('{"note": 1}')
    assert io.read_observations(spark, str(good)).count() == 2
    assert io.read_observations(spark, str(bad)).count() == 0
    assert io.read_observations(spark, str(other)).count() == 0


def test_document_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "B.MD").write_text("three")
    (tmp_path / "c.html").write_text("no")
    (tmp_path / "d.txt").write_text("")
    got = {r["source"]: r["text"] for r in io.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one\ntwo", "B.MD": "three"}


def test_eval_lines_and_templates(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('{"aqi": 25, "category": "Good", "expected_summary": "s", "expected_precautions": ["a", "b"]}\n\n{"aqi": 700, "category": "Bad", "expected_summary": "s", "expected_precautions": []}')
    ex = io.read_eval_examples(spark, str(p)).withColumn("n", F.monotonically_increasing_id() + 1)
    assert ex.count() == 2
    issues = scoring.eval_set_issues(ex, "n").orderBy("order").collect()
    assert [r["issue"].split(": ")[1] for r in issues] == ["invalid AQI value 700.0", "invalid category 'Bad'"]
    assert tuple(scoring.eval_set_checks(ex, "n").first()) == (2, 2, False)
    (tmp_path / "zero_shot.txt").write_text("Reply in JSON about {aqi_value}, please, as was agreed upon earlier.")
    t = {r["name"]: r for r in scoring.template_checks(io.read_templates(spark, str(tmp_path))).collect()}
    assert t["zero_shot"]["valid"] and t["zero_shot"]["mentions_json"] and not t["meta_prompt"]["present"]


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == named and new_path(spark, "x").startswith(named)
    assert new_path(spark, "x") != new_path(spark, "x") and spark.sparkContext.getCheckpointDir()


def test_spread_leaves_large_inputs_alone(spark):
    assert spread(spark.range(10, numPartitions=64)).rdd.getNumPartitions() == 64
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 8


# ---------------------------------------------------------------- streams


def test_dedup_stream_across_batches_and_restart(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    rows = [("a", T0), ("a", T0), ("b", T0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    df.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: streams.stream_dedup(streams.table_stream(spark, src, df.schema), ["k"])
    streams.run_to_folder(stream(), out, mark)
    df.coalesce(1).write.mode("append").parquet(src)
    streams.run_to_folder(stream(), out, mark)
    assert spark.read.parquet(out).count() == 2


def test_safety_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = [("in", 1, True, False), ("in", 5, False, True), ("out", 9, True, False), ("out", 2, False, True), ("new", 1, False, False)]
    df = spark.createDataFrame(rows, "stage string, at long, blocked boolean, reset boolean")
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    df.repartition(5).write.parquet(src)
    stream = streams.stream_safety(streams.table_stream(spark, src, df.schema, files_per_trigger=1))
    streams.run_updates_to_folder(stream, out, mark)
    got = {r["stage"]: r["status"] for r in streams.latest_updates(stream, out, ["stage"], ["status"]).collect()}
    want = {r["stage"]: r["status"] for r in telemetry.safety_status(df.withColumnRenamed("at", "ts")).collect()}
    assert got == want == {"in": 1, "out": 0, "new": 1}


def test_schema_constants_agree():
    assert len(schemas.READING_COLUMNS) == 23 and len(schemas.STRATEGIES) == 5 and len(schemas.GUARD_EVENT_TYPES) == 6


@pytest.mark.parametrize("master, alone", [("local", True), ("local[8]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://host:7077", False)])
def test_only_a_single_process_may_use_a_local_folder(master, alone):
    from airframe.session import one_process

    assert one_process(master) is alone


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from airframe.session import shared_folder

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_csv_files_with_another_header_are_refused(spark):
    folder = new_path(spark, "csv")
    spark.createDataFrame([("10", "20")], "co string, no string").write.option("header", True).csv(folder)
    spark.createDataFrame([("20", "10")], "no string, co string").write.mode("append").option("header", True).csv(folder)
    with pytest.raises(Exception, match="(?i)header"):
        io.read_readings(spark, folder).collect()


def test_streams_over_a_folder_of_files_and_over_no_rows(spark, sf):
    from airframe.plans import continuous

    whole = spark.read.parquet(f"{sf}/events.parquet")
    for rows, folder in ((whole, new_path(spark, "several")), (whole.limit(0), new_path(spark, "none"))):
        rows.repartition(3).write.parquet(f"{folder}/events.parquet")
        for name in ("stream_dedup", "stream_rates", "stream_safety", "stream_latency_quantiles"):
            want = getattr(continuous, name)(spark, sf).count() if rows is whole else 0
            assert getattr(continuous, name)(spark, folder).count() == want, name
