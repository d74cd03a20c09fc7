"""Cross-validated lines next to least squares on the rows themselves."""

from itertools import combinations

import numpy as np
import pytest

from airframe.operators import crossval
from airframe.plans import regress

FEATURES = ["a", "b", "c", "d"]


def frame(spark, seed=1, n=400, offset=1e6):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4)) * [1, 10, 0.1, 5] + offset
    x[:, 3] = x[:, 0] * 2 - 1e6 + 0.001 * rng.standard_normal(n)  # nearly the same as the first
    y = 3 * x[:, 0] - 0.5 * x[:, 1] + rng.standard_normal(n)
    rows = [(*map(float, r), float(t), int(i * 5 // n)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    rows += [(None, 1.0, 1.0, 1.0, 5.0, 0), (1.0, 1.0, 1.0, 1.0, None, 4)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int"), x, y, np.arange(n) * 5 // n


def plain(x, y, fold, at):
    out = {}
    for k in sorted(set(fold)):
        train = fold != k
        mean = x[train].mean(axis=0)
        design = np.column_stack([(x[train] - mean)[:, at], np.ones(train.sum())])
        beta = np.linalg.lstsq(design, y[train], rcond=None)[0]
        held = np.column_stack([(x[~train] - mean)[:, at], np.ones((~train).sum())])
        out[int(k)] = float(((y[~train] - held @ beta) ** 2).mean())
    return out


def test_every_subset_next_to_least_squares(spark):
    df, x, y, fold = frame(spark)
    sets = {",".join(c): list(c) for n in range(5) for c in combinations(FEATURES, n)}
    got = crossval.cv_lines(df, sets, "y").collect()
    assert len(got) == 16 * 5
    want = {name: plain(x, y, fold, [FEATURES.index(c) for c in cols]) for name, cols in sets.items()}
    assert all(r.mse == pytest.approx(want[r.features][r.fold], rel=1e-5) for r in got)


def test_columns_without_variance_or_that_repeat(spark):
    df, x, y, fold = frame(spark)
    same = df.selectExpr("a", "a AS e", "1.0D AS one", "y", "fold")
    got = {r.fold: r.mse for r in crossval.cv_lines(same, {"s": ["a", "e", "one"]}, "y").collect()}
    assert got == pytest.approx(plain(x, y, fold, [0]), rel=1e-6)
    assert crossval.cv_lines(df.limit(0), {"s": ["a"]}, "y").collect() == []


def test_the_useless_feature_goes_in_one_scan(spark):
    df, x, y, fold = frame(spark)
    kept, compared = crossval.drop_weak(df, ["a", "b", "c"], "y", drop=1)
    row = compared.first()
    full, reduced = ([*plain(x, y, fold, at).values()] for at in ([0, 1, 2], [0, 1]))
    assert kept == ["a", "b"]
    assert (row.full_mse, row.reduced_mse) == (pytest.approx(np.mean(full), rel=1e-6), pytest.approx(np.mean(reduced), rel=1e-6))
    assert row.full_mse_std == pytest.approx(np.std(full), rel=1e-6)


def test_registered_query_next_to_least_squares(spark, sf):
    items = regress._items(spark, sf).toPandas()
    items = items.sort_values(["l_orderkey", *regress._KEYS[1:], *regress._FEATURES, "l_extendedprice"])
    n = len(items)
    fold = np.concatenate([np.full(n // 5 + (k < n % 5), k) for k in range(5)])
    x, y = items[regress._FEATURES].to_numpy(float), items["l_extendedprice"].to_numpy(float)
    row = regress.drop_weak_features(spark, sf).first()
    at = [regress._FEATURES.index(f) for f in row.kept.split(",")]
    assert len(at) == 3
    assert row.full_mse == pytest.approx(np.mean([*plain(x, y, fold, list(range(5))).values()]), rel=1e-8)
    assert row.reduced_mse == pytest.approx(np.mean([*plain(x, y, fold, at).values()]), rel=1e-8)
