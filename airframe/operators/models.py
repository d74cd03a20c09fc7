"""Regression models on MLlib: split, train, compare, rank features, back-test."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airframe.functions.columns import unit_noise
from airframe.operators import ordered
from airframe.session import shared_folder

FEATURES = "features"


def random_split(df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42, name: str = "part") -> DataFrame:
    """Tag rows ``train`` or ``test`` by a hash of their key: the same on every run and partitioning."""
    return df.withColumn(name, F.when(unit_noise(F.lit(seed), *keys) < test_share, "test").otherwise("train"))


def assembler(features: Sequence[str], out: str = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip")


def scaler(source: str = "raw_features", out: str = FEATURES) -> StandardScaler:
    return StandardScaler(inputCol=source, outputCol=out, withMean=True, withStd=True)


def scale_features(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Standard-scaled copies ``scaled_*``: (x - mean) / population deviation; a constant column becomes 0."""
    source = df if fit_on is None else fit_on
    stats = source.agg(
        *[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    joined = df.crossJoin(F.broadcast(stats))  # exactly one row
    scaled = {
        f"scaled_{f}": F.coalesce(F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")), F.col(f) * F.lit(0.0))
        for f in features
    }
    return joined.withColumns(scaled).drop(*[f"_{p}_{f}" for p in "ms" for f in features])


def train_forest(target: str, trees: int = 300, depth: int = 10, seed: int = 42):
    return RandomForestRegressor(featuresCol=FEATURES, labelCol=target, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=512)


def train_gbt(target: str, rounds: int = 300, depth: int = 3, step: float = 0.1, seed: int = 42):
    return GBTRegressor(featuresCol=FEATURES, labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, checkpointInterval=10)


def train_linear(target: str):
    return LinearRegression(featuresCol=FEATURES, labelCol=target, regParam=0.0, solver="normal")


def label_stats(train: DataFrame, targets: Sequence[str]) -> tuple[int, dict[str, float]]:
    """Rows and population deviation per target, in one aggregate."""
    row = train.agg(F.count(F.lit(1)).alias("_n"), *[F.stddev_pop(t).alias(t) for t in targets]).first()
    return row["_n"], {t: row[t] or 1.0 for t in targets}


def train_ridge(target: str, rows: int, label_std: float, alpha: float = 1.0):
    """alpha penalises the sum of squared errors. MLlib's loss is their half mean and its normal solver
    divides the penalty by the deviation of the label, hence alpha · deviation / rows."""
    return LinearRegression(
        featuresCol=FEATURES,
        labelCol=target,
        regParam=alpha * label_std / max(rows, 1),
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
    )


def model_zoo(target: str, rows: int, label_std: float, trees: int = 300, rounds: int = 300) -> dict:
    """Estimators by name, in the order in which ties are decided."""
    return {
        "Random_Forest": train_forest(target, trees),
        "Gradient_Boosting": train_gbt(target, rounds),
        "Linear_Regression": train_linear(target),
        "Ridge_Regression": train_ridge(target, rows, label_std),
    }


#: Bins of a feature, as many as MLlib's trees take by default.
BINS = 32
#: Trees are fitted on rows up to this number; more rows go in as groups of equal bins, and a forest gets about as many groups.
GROUPS = 500_000
TREES = (RandomForestRegressor, GBTRegressor)
#: Combinations of bins whose predictions every task may hold, as a table of so many numbers.
TABLE = 8_000_000
#: Rows that a round of boosting takes in one task at least: its rounds are many and short.
ROUND_ROWS = 50_000


def binner(df: DataFrame, features: Sequence[str], bins: int = BINS) -> Bucketizer:
    """Bins as MLlib's trees cut them, here from all rows: one for each value if there are few, else about equal numbers of rows."""
    rows = df.na.drop(subset=list(features))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(
        *[F.approx_count_distinct(f, 0.05).alias(f"d_{i}") for i, f in enumerate(features)],
        *[F.min(F.col(f).cast("double")).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.percentile_approx(F.col(f).cast("double"), shares, F.lit(10_000)).alias(f"q_{i}") for i, f in enumerate(features)],
    ).first()
    few = [i for i in range(len(features)) if found[f"d_{i}"] <= 2 * bins]
    sets = rows.agg(F.count(F.lit(1)), *[F.sort_array(F.collect_set(F.col(features[i]).cast("double"))).alias(f"s_{i}") for i in few]).first()
    splits = []
    for i in range(len(features)):
        values = sets[f"s_{i}"] if i in few else None
        if values and len(values) <= bins:
            borders = [(a + b) / 2 for a, b in zip(values, values[1:])]
        else:
            borders = [q for q in found[f"q_{i}"] or [] if q > found[f"m_{i}"]]
        splits.append([float("-inf"), *(sorted(set(borders)) or [0.0]), float("inf")])
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=[f"_bin_{f}" for f in features], handleInvalid="skip")


def group_equal(train: DataFrame, bins: Bucketizer, target: str, groups: int = 1) -> DataFrame:
    """One row for each combination of bins: mean of the label and ``_rows``, written once to the shared folder.

    A tree sees a row's bins, its label and nothing else, and the spread of labels within a combination is the same on both
    sides of every split, so trees on weighted means split like trees on the rows. For bags there should be about
    ``groups`` rows: where combinations are fewer, the rows of each are dealt out to several.
    """
    shared_folder(train.sparkSession)
    names = bins.getOutputCols()
    label = F.coalesce(F.col(target).cast("double"), F.lit(float("nan")))  # MLlib refuses a missing label
    # A sum has no metadata: bins are numbers to the trees, not categories.
    rows = bins.transform(train).select(*[(F.col(n) + 0.0).alias(n) for n in names], label.alias(target))
    sums = [F.avg(target).alias(target), F.count(F.lit(1)).cast("double").alias("_rows")]
    out = rows.groupBy(*names).agg(*sums).checkpoint()
    parts = groups // max(out.count(), 1)
    if parts > 1:
        dealt = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("_part")
        out = rows.withColumn("_part", dealt).groupBy(*names, "_part").agg(*sums).drop("_part").checkpoint()
    return out


def fit_trees(train: DataFrame, features: Sequence[str], estimator, bins: Bucketizer) -> PipelineModel:
    """A pipeline of bins, assembler and trees, fitted on groups of rows with equal bins."""
    bags = isinstance(estimator, RandomForestRegressor) and estimator.getBootstrap()
    equal = group_equal(train, bins, estimator.getLabelCol(), GROUPS if bags else 1)
    ready = assembler(bins.getOutputCols())
    rows, cores = equal.count(), train.sparkSession.sparkContext.defaultParallelism
    # Every task of a forest sends the sums of all nodes, the rounds of boosting are many and short: few tasks.
    tasks = cores if bags else min(cores, -(-rows // ROUND_ROWS))
    model = estimator.setWeightCol("_rows").fit(ready.transform(equal).select(FEATURES, estimator.getLabelCol(), "_rows").repartition(max(tasks, 1)))
    return PipelineModel(stages=[bins, ready, model])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with ``prediction``. Trees over bins decide once for each combination of bins, rows look theirs up."""
    if not isinstance(model.stages[0], Bucketizer):
        return model.transform(df)
    names = model.stages[0].getOutputCols()
    binned = model.stages[0].transform(df)
    once = PipelineModel(stages=model.stages[1:]).transform(binned.select(*names).distinct()).select(*names, "prediction")
    return binned.join(once, names).drop(*names)


def fit_one(train: DataFrame, features: Sequence[str], estimator, scaled: bool = False) -> PipelineModel:
    """One pipeline holds assembler, optional scaler and regressor, so that serving cannot differ from training.

    Trees on many rows are fitted on groups of equal bins.
    """
    if not scaled and isinstance(estimator, TREES) and train.count() > GROUPS:
        return fit_trees(train, features, estimator, binner(train, features))
    stages = [assembler(features, "raw_features"), scaler(), estimator] if scaled else [assembler(features), estimator]
    return Pipeline(stages=stages).fit(train)


def _mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(F.try_divide(y - p, y))) * F.lit(100.0)


def regression_metrics(
    df: DataFrame,
    pairs: dict[str, tuple[Column | str, Column | str]],
    keys: Sequence[str] = (),
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """RMSE, MAE and R² per target and their averages, in one aggregate. ``pairs``: target → (truth, prediction);
    ``extra`` adds further aggregates to the same pass."""
    aggs = []
    for name, (y, p) in pairs.items():
        y = F.col(y) if isinstance(y, str) else y
        p = F.col(p) if isinstance(p, str) else p
        y, p = y.cast("double"), p.cast("double")
        e = y - p
        aggs += [
            F.sqrt(F.avg(e * e)).alias(f"rmse_{name}"),
            F.avg(F.abs(e)).alias(f"mae_{name}"),
            (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(y))).alias(f"r2_{name}"),
        ]
    out = df.groupBy(*keys).agg(*aggs, *[c.alias(n) for n, c in (extra or {}).items()])
    for metric in ("rmse", "mae", "r2"):
        total = sum((F.col(f"{metric}_{n}") for n in pairs), F.lit(0.0))
        out = out.withColumn(f"avg_{metric}", total / F.lit(float(len(pairs))))
    return out


def mape(df: DataFrame, truth: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute percentage error over rows with a non-zero truth; rows with truth 0 are counted apart."""
    y, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(*keys).agg(
        _mape(y, p).alias("mape"),
        F.count_if(y == 0).alias("zero_truth"),
    )


def pick_best_model(metrics: DataFrame, score: str = "avg_rmse", name: str = "model", ordinal: str = "ordinal") -> DataFrame:
    """The model with the lowest score; ties go to the one listed first."""
    best = F.struct(F.col(score), F.col(ordinal))
    return metrics.agg(F.min_by(name, best).alias(name), F.min(score).alias(score))


def train_and_rank(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], part: str = "part", trees: int = 300, rounds: int = 300, side_by_side: int = 4
) -> tuple[DataFrame, dict[str, dict[str, PipelineModel]]]:
    """Fit every estimator per target on the train rows and measure it on the test rows.

    Returns the metrics table (one row per model) and the fitted pipelines. The rows are assembled and materialised
    once in the shared folder; every fit reads them from there. Fits don't depend on each other, so a few run at a
    time, each in a scheduler pool of its own, and the short rounds of one fill the gaps of another. All models are
    measured in one pass over the test rows.
    """
    spark = df.sparkSession
    shared_folder(spark)
    ready = assembler(features)
    needed = ready.transform(df.select(*features, *targets, part)).checkpoint()
    train, test = needed.filter(F.col(part) == "train"), needed.filter(F.col(part) == "test")
    rows, spread = label_stats(train, targets)
    few = train.coalesce(max(1, min(train.rdd.getNumPartitions(), -(-rows // ROUND_ROWS))))
    zoos = {t: model_zoo(t, rows, spread[t], trees, rounds) for t in targets}
    names = list(zoos[targets[0]])
    bins = binner(train, features) if rows > GROUPS else None

    def fit(name: str, target: str) -> PipelineModel:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{name}-{target}")
        estimator = zoos[target][name]
        if bins and isinstance(estimator, TREES):
            return fit_trees(train, features, estimator, bins)
        return PipelineModel(stages=[ready, estimator.fit(few if isinstance(estimator, GBTRegressor) else train)])

    # Boosting takes longest, so it starts first.
    work = sorted(((n, t) for n in names for t in targets), key=lambda w: not isinstance(zoos[w[1]][w[0]], GBTRegressor))
    with ThreadPoolExecutor(side_by_side) as pool:
        running = {w: pool.submit(inheritable_thread_target(spark)(fit), *w) for w in work}
        models = {w: f.result() for w, f in running.items()}
    fitted = {n: {t: models[n, t] for t in targets} for n in names}

    def scores(rows: DataFrame, which: list[tuple[str, str]]) -> DataFrame:
        for n, t in which:
            last = models[n, t].stages[-1]
            rows = last.setPredictionCol(f"p_{n}_{t}").transform(rows)
            last.setPredictionCol("prediction")
        return rows

    binned = [w for w in models if bins and isinstance(models[w].stages[0], Bucketizer)]
    scored = scores(test, [w for w in models if w not in binned]).drop(FEATURES)
    if binned:
        # Trees over bins decide once for each combination of bins.
        keys = bins.getOutputCols()
        scored = bins.transform(scored)
        once = scores(assembler(keys).transform(scored.select(*keys).distinct()), binned)
        scored = scored.join(once.select(*keys, *[f"p_{n}_{t}" for n, t in binned]), keys)
    scored = scored.select(*targets, *[f"p_{n}_{t}" for n in names for t in targets])
    lines = [F.struct(F.lit(n).alias("model"), F.lit(i).alias("ordinal"), *[F.col(f"p_{n}_{t}").alias(f"p_{t}") for t in targets]) for i, n in enumerate(names)]
    told = scored.select(*targets, F.explode(F.array(*lines)).alias("_l")).select(*targets, "_l.*")
    return regression_metrics(told, {t: (t, f"p_{t}") for t in targets}, ["model", "ordinal"]), fitted


def feature_importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of a fitted tree model, largest first."""
    weights = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    rows = list(zip(features, weights))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most n rows in hash order of the key: a repeatable sample, taken as a top-k."""
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    return df.orderBy(h, *keys).limit(n)


def permutation_importance(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, model: PipelineModel, seed: int = 42
) -> DataFrame:
    """Increase of the RMSE when one column is shuffled.

    The shuffled value of a row is that of the next one in hash order, cyclically: rows are sorted in buckets of the hash and
    shuffled once, so no column is sorted in one task. All features share that step and are scored in one pass. Where
    trees over bins have a table of predictions that a task can hold, a row goes as one number for its combination of bins
    and looks its predictions up; no copy of a row is shuffled.
    """
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])
    buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.col("_h"), F.lit(buckets)).cast("long")
    if isinstance(model.stages[0], Bucketizer):
        radix = [len(s) for s in model.stages[0].getSplitsArray()]  # one more than bins, for missing values
        if math.prod(radix) <= TABLE:
            return _importances(_table_scores(df, h, bucket, features, target, model, radix))
    base = df.select(h.alias("_h"), *features, target)
    both = ordered.row_after(base, ["_h"], features, bucket)
    variants = [F.struct(F.lit("").alias("feature"), *[F.col(f).alias(f) for f in features])]
    for g in features:
        variants.append(
            F.struct(F.lit(g).alias("feature"), *[(F.col(f"_o_{f}") if f == g else F.col(f)).alias(f) for f in features])
        )
    copies = both.select(target, F.explode(F.array(*variants)).alias("_v")).select(target, "_v.*")
    e = F.col(target).cast("double") - F.col("prediction")
    if isinstance(model.stages[0], Bucketizer):
        # Number, mean and variance of the labels tell the error of a combination of bins, whose prediction is one.
        names = model.stages[0].getOutputCols()
        y = F.col(target).cast("double")
        sums = [F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")]
        cells = model.stages[0].transform(copies).groupBy(*names, "feature").agg(*sums)
        once = cells.groupBy(*names).agg(F.collect_list(F.struct("feature", "n", "m", "v")).alias("_c"))  # one per feature
        told = PipelineModel(stages=model.stages[1:]).transform(once).select("prediction", F.explode("_c").alias("_c")).select("prediction", "_c.*")
        miss = F.col("m") - F.col("prediction")
        scores = told.groupBy("feature").agg(F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("v") + miss * miss)), F.sum("n"))).alias("rmse"))
    else:
        scores = model.transform(copies).groupBy("feature").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    return _importances(scores)


def _importances(scores: DataFrame) -> DataFrame:
    """(feature, rmse), with '' for the rows as they are, to (feature, importance)."""
    # One row per feature; a join with the row of '' would score all rows twice.
    every, plain = Window.partitionBy(F.lit(0)), F.col("feature") == ""
    based = scores.select("*", F.max(F.when(plain, F.col("rmse"))).over(every).alias("_base"), F.max(plain).over(every).alias("_any"))
    return based.filter("feature != '' AND _any").select("feature", (F.col("rmse") - F.col("_base")).alias("importance"))


def _table_scores(df: DataFrame, h: Column, bucket: Column, features: Sequence[str], target: str, model: PipelineModel, radix: Sequence[int]) -> DataFrame:
    """(feature, rmse) of trees over bins, whose predictions for all combinations are one table.

    A combination is the number whose digits are the bins; the last value of a digit stands for a missing value, whose
    rows are not scored.
    """
    bins, names = model.stages[0], model.stages[0].getOutputCols()
    steps = [math.prod(radix[i + 1 :]) for i in range(len(radix))]
    grid = df.sparkSession.range(math.prod(radix)).withColumns({n: F.floor(F.col("id") / steps[i]) % radix[i] + 0.0 for i, n in enumerate(names)})
    known = grid.where(" AND ".join(f"`{n}` < {r - 1}" for n, r in zip(names, radix)))
    told = PipelineModel(stages=model.stages[1:]).transform(known).select("id", "prediction").toArrow()
    table = np.full(math.prod(radix), np.nan)
    table[told["id"].to_numpy()] = told["prediction"].to_numpy()

    code = sum((F.coalesce(n, F.lit(radix[i] - 1.0)) * steps[i] for i, n in enumerate(names)), F.lit(0.0)).cast("int")
    coded = bins.copy().setHandleInvalid("keep").transform(df.withColumn("_h", h)).select("_h", code.alias("_code"), F.col(target).cast("double").alias("_y"))
    both = ordered.row_after(coded, ["_h"], ["_code"], bucket).where("_y IS NOT NULL").select("_code", "_o__code", "_y")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of rows and sum of squared errors, of the rows as they are and with each feature of the next row."""
        n, total = np.zeros(len(radix) + 1, np.int64), np.zeros(len(radix) + 1)
        for b in batches:
            own, other, y = (b.column(x).to_numpy().astype(kind) for x, kind in enumerate((np.int64, np.int64, np.float64)))
            for i in range(-1, len(radix)):
                moved = 0 if i < 0 else (other // steps[i] % radix[i] - own // steps[i] % radix[i]) * steps[i]
                p = table[own + moved]
                valid = ~np.isnan(p)
                n[i + 1] += int(valid.sum())
                total[i + 1] += float(((y - p)[valid] ** 2).sum())
        yield pa.RecordBatch.from_pydict({"feature": ["", *features], "n": n, "s": total})

    sums = both.mapInArrow(score, "feature string, n long, s double").where("n > 0")
    return sums.groupBy("feature").agg(F.sqrt(F.try_divide(F.sum("s"), F.sum("n"))).alias("rmse"))


def importance_compare(first: DataFrame, second: DataFrame, n: int = 15) -> DataFrame:
    """Two rankings side by side, the n best by the second."""
    return (
        first.select("feature", F.col("importance").alias("first_importance"))
        .join(second.select("feature", F.col("importance").alias("second_importance")), "feature")
        .orderBy(F.desc("second_importance"), "feature")
        .limit(n)
    )


def weakest(importance: DataFrame, n: int = 2) -> list[str]:
    return [r["feature"] for r in importance.orderBy("importance", "feature").limit(n).collect()]


def cv_scores(df: DataFrame, features: Sequence[str], target: str, make, fold: str = "fold", k: int = 5) -> DataFrame:
    """Mean squared error per held-out fold. ``make(target)`` returns a fresh estimator."""
    out = None
    for i in range(k):
        model = fit_one(df.filter(F.col(fold) != i), features, make(target))
        e = F.col(target).cast("double") - F.col("prediction")
        line = model.transform(df.filter(F.col(fold) == i)).agg(F.lit(i).alias("fold"), F.avg(e * e).alias("mse"))
        out = line if out is None else out.unionByName(line)
    return out


def cv_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the fold errors, its square root and their population deviation."""
    return scores.groupBy(*keys).agg(
        F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"), F.stddev_pop("mse").alias("mse_std")
    )


def cv_compare(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """Full against reduced feature set with the percentage change of the RMSE. One row on each side."""
    a = cv_summary(full).select(*[F.col(c).alias(f"full_{c}") for c in ("mse", "rmse", "mse_std")])
    b = cv_summary(reduced).select(*[F.col(c).alias(f"reduced_{c}") for c in ("mse", "rmse", "mse_std")])
    change = F.lit(100.0) * F.try_divide(F.col("reduced_rmse") - F.col("full_rmse"), F.col("full_rmse"))
    return a.crossJoin(F.broadcast(b)).withColumn("rmse_change_pct", change)


def drop_weak_features(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, make, drop: int = 2, fold: str = "fold", k: int = 5
) -> tuple[list[str], DataFrame]:
    """Remove the least important features by permutation and compare both sets by folds.

    Every fit reads the same rows, so they are materialised once in the shared folder.
    """
    shared_folder(df.sparkSession)
    rows = df.select(*dict.fromkeys([*keys, *features, target, fold])).checkpoint()
    model = fit_one(rows, features, make(target))
    weak = weakest(permutation_importance(rows, keys, features, target, model), drop)
    kept = [f for f in features if f not in weak]
    return kept, cv_compare(cv_scores(rows, features, target, make, fold, k), cv_scores(rows, kept, target, make, fold, k))


def backtest(df: DataFrame, keys: Sequence[str], order: Sequence[str], pairs: dict[str, tuple[str, str]], share: float = 0.8, seconds: int | None = None) -> DataFrame:
    """Metrics of recorded predictions on the last part of each series, with MAPE per target."""
    tail = ordered.positional_split(df, keys, order, share, seconds=seconds).filter(F.col("side") == "current")
    extra = {f"mape_{name}": _mape(F.col(y), F.col(p)) for name, (y, p) in pairs.items()}
    return regression_metrics(tail, pairs, extra=extra)
