"""Fitted trees and boosting next to plain ones; several fits side by side next to one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airframe.operators import models, ordered

FEATURES = ["a", "b"]


def rows(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 2)).astype(float)
    y = 3 * (x[:, 0] > 5) + x[:, 1] * 0.7 + rng.standard_normal(n)
    parts = np.where(rng.random(n) < 0.25, "test", "train")
    data = [(i, *map(float, r), float(t), float(2 - t), str(p)) for i, (r, t, p) in enumerate(zip(x, y, parts, strict=True))]
    return spark.createDataFrame(data, "i long, a double, b double, y double, z double, part string"), x, y


def plain_tree(x, y, depth):
    """Predictions on its own rows of the tree that lowers the squared error most at each split."""
    best, whole = (1e-12, None, None), ((y - y.mean()) ** 2).sum()
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = whole - ((y[left] - y[left].mean()) ** 2).sum() - ((y[~left] - y[~left].mean()) ** 2).sum()
            best = max(best, (gain, f, cut), key=lambda s: s[0])
    if best[1] is None:
        return np.full(len(y), y.mean())
    left, out = x[:, best[1]] <= best[2], np.empty(len(y))
    out[left], out[~left] = plain_tree(x[left], y[left], depth - 1), plain_tree(x[~left], y[~left], depth - 1)
    return out


def predictions(model, df):
    return [r.prediction for r in model.transform(df).orderBy("i").collect()]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_one_tree_without_resampling_is_the_plain_tree(spark, depth):
    df, x, y = rows(spark)
    one = models.train_forest("y", trees=1, depth=depth).setBootstrap(False).setFeatureSubsetStrategy("all")
    assert np.allclose(predictions(models.fit_one(df, FEATURES, one), df), plain_tree(x, y, depth))


def test_boosting_adds_trees_of_what_is_left(spark):
    df, x, y = rows(spark)
    got = predictions(models.fit_one(df, FEATURES, models.train_gbt("y", rounds=4, depth=2, step=0.3)), df)
    total = plain_tree(x, y, 2)
    for _ in range(3):
        total = total + 0.3 * plain_tree(x, 2 * (y - total), 2)
    assert np.allclose(got, total)


def test_a_forest_is_the_mean_of_its_trees_and_repeats(spark):
    df, _, y = rows(spark)
    model = models.fit_one(df, FEATURES, models.train_forest("y", trees=7, depth=3))
    again = models.fit_one(df, FEATURES, models.train_forest("y", trees=7, depth=3))
    assert predictions(model, df) == predictions(again, df)
    features = model.stages[0].transform(df).orderBy("i").collect()
    each = [np.mean([t.predict(r.features) for t in model.stages[-1].trees]) for r in features]
    assert np.allclose(predictions(model, df), each) and np.corrcoef(each, y)[0, 1] > 0.8


def test_side_by_side_equals_one_after_the_other(spark):
    df, _, _ = rows(spark)
    table, fitted = models.train_and_rank(df, FEATURES, ["y", "z"], trees=4, rounds=3)
    train, test = df.filter("part = 'train'"), df.filter("part = 'test'")
    n, spread = models.label_stats(train, ["y", "z"])
    got = {r.model: r for r in table.collect()}
    for t in ("y", "z"):
        for name, estimator in models.model_zoo(t, n, spread[t], 4, 3).items():
            alone = models.fit_one(train.coalesce(1), FEATURES, estimator)
            want = models.regression_metrics(alone.transform(test), {t: (t, "prediction")}).first()
            assert got[name][f"rmse_{t}"] == pytest.approx(want[f"rmse_{t}"], rel=0.2 if name == "Random_Forest" else 1e-9)
            assert fitted[name][t].transform(test).count() == test.count()
    assert sorted(r.ordinal for r in got.values()) == [0, 1, 2, 3]
    assert got["Linear_Regression"].avg_rmse == pytest.approx((got["Linear_Regression"].rmse_y + got["Linear_Regression"].rmse_z) / 2)


def test_trees_on_groups_of_equal_bins_are_those_on_the_rows(spark, monkeypatch):
    df, x, y = rows(spark, 600)
    one = models.train_forest("y", trees=1, depth=4).setBootstrap(False).setFeatureSubsetStrategy("all")
    on_rows = predictions(models.fit_one(df, FEATURES, models.train_gbt("y", rounds=4, depth=2, step=0.3)), df)
    monkeypatch.setattr(models, "GROUPS", 200)
    bins = models.binner(df, FEATURES)
    equal = models.group_equal(df, bins, "y")
    assert equal.count() == len(np.unique(x, axis=0)) and equal.groupBy().sum("_rows").first()[0] == 600
    assert 200 <= models.group_equal(df, bins, "y", 400).count() <= 600
    boosted = models.fit_one(df, FEATURES, models.train_gbt("y", rounds=4, depth=2, step=0.3))
    assert len(boosted.stages) == 3 and np.allclose(predictions(boosted, df), on_rows)
    tree = models.fit_one(df, FEATURES, one)
    assert np.allclose(predictions(tree, df), plain_tree(x, y, 4))
    assert np.allclose([r.prediction for r in models.predict(tree, df).orderBy("i").collect()], predictions(tree, df))
    forest = models.fit_one(df, FEATURES, models.train_forest("y", trees=7, depth=3))
    assert np.corrcoef(predictions(forest, df), y)[0, 1] > 0.8


def test_errors_from_groups_of_equal_bins_are_those_of_the_rows(spark, monkeypatch):
    df, _, _ = rows(spark, 600)
    monkeypatch.setattr(models, "GROUPS", 100)
    model = models.fit_one(df, FEATURES, models.train_gbt("y", rounds=3, depth=2))
    got = {r.feature: r.importance for r in models.permutation_importance(df, ["i"], FEATURES, "y", model).collect()}

    class Rows:  # the same model, scored row by row
        stages = [None]
        transform = staticmethod(model.transform)

    want = {r.feature: r.importance for r in models.permutation_importance(df, ["i"], FEATURES, "y", Rows).collect()}
    assert got == pytest.approx(want) and min(got.values()) > 0
    table, fitted = models.train_and_rank(df, FEATURES, ["y", "z"], trees=3, rounds=3)
    test = df.filter("part = 'test'")
    for r in table.collect():
        told = models.regression_metrics(fitted[r.model]["y"].transform(test), {"y": ("y", "prediction")}).first()
        assert (r.rmse_y, r.mae_y) == pytest.approx((told.rmse_y, told.mae_y))


def test_rows_get_the_columns_of_the_next_one_across_buckets(spark):
    rng = np.random.default_rng(6)
    data = [(int(h), None if v < 3 else int(v), float(n)) for n, (h, v) in enumerate(zip(rng.integers(0, 40, 200), rng.integers(0, 9, 200)))]
    df = spark.createDataFrame(data, "h int, v int, n double").repartition(5)
    bucket = lambda r: r[0] % 7 if r[0] % 7 != 3 else 4  # noqa: E731  one bucket is empty
    first = F.when(F.col("h") % 7 == 3, 4).otherwise(F.col("h") % 7).cast("long")
    # Rows of one h are in the order of their other columns, NULL first.
    line = sorted(data, key=lambda r: (bucket(r), r[0], r[1] is not None, r[1] or 0, r[2]))
    want = {r[2]: (q[1], q[2]) for r, q in zip(line, [*line[1:], line[0]])}
    got = ordered.row_after(df, ["h"], ["v", "n"], first)
    assert {r.n: (r._o_v, r._o_n) for r in got.collect()} == want
    one = ordered.row_after(df.limit(1), ["h"], ["n"], first).first()
    assert one._o_n == one.n and ordered.row_after(df.limit(0), ["h"], ["n"], first).count() == 0


@pytest.mark.parametrize("table", [10_000, 0])
def test_no_copy_of_a_row_is_shuffled_for_importances(spark, monkeypatch, table):
    """Missing features and labels, repeated keys; with a table of predictions and without, as row by row."""
    df, _, _ = rows(spark, 600)
    monkeypatch.setattr(models, "GROUPS", 100)
    model = models.fit_one(df, FEATURES, models.train_gbt("y", rounds=3, depth=2))
    monkeypatch.setattr(models, "TABLE", table)
    odd = df.selectExpr("i", "CASE WHEN i % 17 = 3 THEN NULL WHEN i % 19 = 4 THEN double('NaN') ELSE a END AS a", "IF(i % 23 = 5, NULL, b) AS b", "IF(i % 29 = 6, NULL, y) AS y")
    got = models.permutation_importance(odd, ["i"], FEATURES, "y", model)
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    line = [tuple(r) for r in odd.withColumn("h", F.xxhash64(F.lit(42), "i")).orderBy(F.expr(f"pmod(h, {n})"), "h").select("a", "b", "y").collect()]
    after = [*line[1:], line[0]]
    rmse = []
    for f in (None, 0, 1):
        moved = [(q[0] if f == 0 else r[0], q[1] if f == 1 else r[1], r[2]) for r, q in zip(line, after)]
        scored = model.transform(spark.createDataFrame(moved, "a double, b double, y double").where("y IS NOT NULL"))
        rmse.append(scored.selectExpr("sqrt(avg((y - prediction) * (y - prediction)))").first()[0])
    assert {r.feature: r.importance for r in got.collect()} == pytest.approx({"a": rmse[1] - rmse[0], "b": rmse[2] - rmse[0]})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_p" not in [x.split("#")[0] for x in plan.split("hashpartitioning(")[1:]], plan  # no join on positions
    assert ("explode" in plan) == (not table)
    sent = [x for x in plan.split("Initial Plan")[0].split("\n") if "hashpartitioning(_bucket#" in x and "ReusedExchange" not in x]
    assert len(sent) == 1, plan  # the rows are sent once and read again from there


def test_bins_of_a_feature_with_many_values_hold_about_as_many_rows(spark):
    df = spark.range(10_000).selectExpr("double(id) AS a", "double(id % 3) AS b", "double(7) AS c")
    bins = models.binner(df, ["a", "b", "c"])
    counts = [bins.transform(df).groupBy(f"_bin_{f}").count().collect() for f in "abc"]
    assert [len(c) for c in counts] == [32, 3, 1]
    assert all(250 <= r["count"] <= 375 for r in counts[0])
