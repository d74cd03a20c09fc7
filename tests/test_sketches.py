"""Stored sketches next to the rows they stand for."""

import os

import numpy as np
import pandas as pd
import pytest

from airframe.operators import sketches


def frame(spark, seed=1):
    rng = np.random.default_rng(seed)
    day = np.repeat(np.arange(6), [4000, 10, 1, 3000, 0 + 2, 9000])
    x = rng.standard_normal(len(day)) * 1e-3 + 1e6 + day
    y = rng.integers(0, 50, len(day)).astype(float)
    y[rng.random(len(day)) < 0.1] = np.nan
    y[day == 2] = np.nan
    pdf = pd.DataFrame({"d": day, "x": x, "y": y, "none": np.nan})
    return spark.createDataFrame(pdf), pdf


def test_summary_from_days(spark, tmp_path):
    df, pdf = frame(spark)
    path = str(tmp_path / "s")
    sketches.store_day(df, ["x", "y", "none"], "d", path)
    got = {r.column: r for r in sketches.summary(sketches.stored_days(spark, path)).collect()}
    for c in ("x", "y"):
        v, r = pdf[c].dropna(), got[c]
        assert (r["count"], r.missing) == (len(v), len(pdf) - len(v))
        assert (r["mean"], r["std"]) == (pytest.approx(v.mean(), rel=1e-12), pytest.approx(v.std(), rel=1e-9))
        assert (r["min"], r["max"]) == (v.min(), v.max())
        assert abs(r.distinct - v.nunique()) <= sketches.DISTINCT_ERROR * v.nunique() + 1
        for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            assert (v < r[name]).mean() <= q + sketches.RANK_ERROR and (v <= r[name]).mean() >= q - sketches.RANK_ERROR
    assert (got["none"]["count"], got["none"].missing, got["none"]["mean"]) == (0, len(pdf), None)


def test_a_new_day_reads_and_writes_only_itself(spark, tmp_path):
    df, pdf = frame(spark)
    path = str(tmp_path / "s")
    sketches.store_day(df.where("d < 5"), ["x", "y"], "d", path)
    before = {f: os.path.getmtime(f"{path}/{f}") for f in os.listdir(path) if f.startswith("day=")}
    sketches.store_day(df.where("d = 5"), ["x", "y"], "d", path)
    sketches.store_day(df.where("d = 5"), ["x", "y"], "d", path)  # once more: it replaces itself
    assert {f: os.path.getmtime(f"{path}/{f}") for f in before} == before
    days = sketches.stored_days(spark, path)
    assert {r.column: r["count"] for r in sketches.summary(days).collect()}["x"] == len(pdf)
    got = {r.column: r for r in sketches.ks_between(days.where("day < 5"), days.where("day = 5")).collect()}
    for c in ("x", "y"):
        a, b = (np.sort(pdf[c][m].dropna()) for m in (pdf.d < 5, pdf.d == 5))
        at = np.concatenate([a, b])
        exact = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
        assert abs(got[c].ks - exact) <= sketches.KS_ERROR
        assert (got[c].reference_rows, got[c].current_rows) == (len(a), len(b))


def test_one_scan_for_all_columns(spark):
    df, _ = frame(spark)
    plan = sketches.day_sketches(df, ["x", "y"], "d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_no_rows(spark):
    df, _ = frame(spark)
    days = sketches.day_sketches(df.limit(0), ["x"], "d")
    assert days.collect() == [] and sketches.summary(days).collect() == []
