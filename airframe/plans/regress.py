"""Model queries on line items and readings. Fitted trees have no SQL twin; straight lines do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe import schemas
from airframe.operators import crossval, forecast, models, ordered
from airframe.plans import base as B
from airframe.plans import runs
from airframe.plans.base import CLEAN_SQL, R, query
from airframe.session import new_path, shared_folder, spread
from airframe.sources import tables as io

_FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice"]
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with part attributes; the part table decides the join by its size."""
    li = spread(B.table(spark, sf, "lineitem")).select(*_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return li.join(part, "l_partkey")


@query(
    "random_split",
    f"""SELECT o_orderkey, CASE WHEN {B.noise_sql("42", "o_orderkey")} < CAST(0.2 AS DOUBLE) THEN 'test' ELSE 'train' END AS part FROM orders""",
)
def random_split(spark: SparkSession, sf: str) -> DataFrame:
    return models.random_split(B.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


def _fit_summary(spark: SparkSession, sf: str, make) -> DataFrame:
    """Fit on the train part, measure on the test part."""
    shared_folder(spark)  # boosting cuts its lineage there
    parts = models.random_split(_items(spark, sf), _KEYS)
    train, test = parts.filter(F.col("part") == "train"), parts.filter(F.col("part") == "test")
    model = models.fit_one(train, _FEATURES, make(train))
    return models.regression_metrics(models.predict(model, test), {"price": ("l_extendedprice", "prediction")})


@query("train_forest")
def train_forest(spark: SparkSession, sf: str, trees: int = 300) -> DataFrame:
    return _fit_summary(spark, sf, lambda _: models.train_forest("l_extendedprice", trees))


@query("train_gbt")
def train_gbt(spark: SparkSession, sf: str, rounds: int = 300) -> DataFrame:
    return _fit_summary(spark, sf, lambda _: models.train_gbt("l_extendedprice", rounds))


_TWO = ["l_quantity", "l_discount"]


def _line_sql(alpha: float) -> str:
    """The normal equations of two centred features, the penalty on their diagonal, applied to every row."""
    x, z, y = (f"(CAST({c} AS DOUBLE) - m{n})" for c, n in ((_TWO[0], "x"), (_TWO[1], "z"), ("l_extendedprice", "y")))
    return f"""WITH s AS (SELECT avg(CAST(l_quantity AS DOUBLE)) AS mx, avg(CAST(l_discount AS DOUBLE)) AS mz, avg(CAST(l_extendedprice AS DOUBLE)) AS my FROM lineitem),
    c AS (SELECT sum({x} * {x}) + {alpha} AS xx, sum({z} * {z}) + {alpha} AS zz, sum({x} * {z}) AS xz, sum({x} * {y}) AS xy, sum({z} * {y}) AS zy FROM lineitem CROSS JOIN s),
    m AS (SELECT (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM c)
    SELECT l_orderkey, l_linenumber, round(a * {x} + b * {z} + my, 2) AS p FROM lineitem CROSS JOIN s CROSS JOIN m"""


def _line(spark: SparkSession, sf: str, make) -> DataFrame:
    """Fit on the line items, predict every one of them."""
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double").alias(c) for c in [*_TWO, "l_extendedprice"]])
    return models.fit_one(li, _TWO, make(li)).transform(li).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("p"))


@query("train_linear", _line_sql(0.0))
def train_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _line(spark, sf, lambda _: models.train_linear("l_extendedprice"))


@query("train_ridge", _line_sql(1.0))
def train_ridge(spark: SparkSession, sf: str) -> DataFrame:
    def make(li: DataFrame):
        rows, spread = models.label_stats(li, ["l_extendedprice"])
        return models.train_ridge("l_extendedprice", rows, spread["l_extendedprice"])

    return _line(spark, sf, make)


@query("train_and_rank")
def train_and_rank(spark: SparkSession, sf: str, trees: int = 300, rounds: int = 300) -> DataFrame:
    """All estimators on two targets, with the best one marked."""
    parts = models.random_split(_items(spark, sf), _KEYS)
    table, _ = models.train_and_rank(parts, ["l_discount", "l_tax", "p_size", "p_retailprice"], ["l_extendedprice", "l_quantity"], trees=trees, rounds=rounds)
    best = models.pick_best_model(table).select(F.col("model").alias("_best"))
    return table.crossJoin(F.broadcast(best)).withColumn("best", F.col("model") == F.col("_best")).drop("_best")  # one row


def _forest(spark: SparkSession, sf: str, trees: int):
    items = _items(spark, sf)
    if B.table(spark, sf, "lineitem").count() > models.GROUPS:
        # Trees on many rows read them several times; each time the line items would be sent to their parts anew.
        path = new_path(spark, "items")
        items.write.option("compression", "zstd").parquet(path)
        items = spark.read.parquet(path)
    return items, models.fit_one(items, _FEATURES, models.train_forest("l_extendedprice", trees))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str, trees: int = 300) -> DataFrame:
    items, model = _forest(spark, sf, trees)
    return models.feature_importance(model, _FEATURES, items)


@query("permutation_importance")
def permutation_importance(spark: SparkSession, sf: str, trees: int = 300) -> DataFrame:
    items, model = _forest(spark, sf, trees)
    return models.permutation_importance(items, _KEYS, _FEATURES, "l_extendedprice", model)


@query("drop_weak_features")
def drop_weak_features(spark: SparkSession, sf: str) -> DataFrame:
    """The two features that lines miss least, and the held-out error with and without them."""
    folded = ordered.contiguous_folds(_items(spark, sf), [], ["l_orderkey", *_KEYS[1:], *_FEATURES, "l_extendedprice"], 5)
    kept, compared = crossval.drop_weak(folded, _FEATURES, "l_extendedprice")
    return compared.withColumn("kept", F.lit(",".join(kept)))


HOURLY = ["temperature_2m", "surface_pressure", "pm10", "no2"]
_SCORE = "temperature_2m * CAST(2 AS DOUBLE) + pm10 * CAST(0.5 AS DOUBLE)"


def closed_scorers() -> dict:
    """A closed-form scorer per target, which SQL can repeat; in quarters, which add up exactly."""
    scores = {
        "aqi_index": F.col("temperature_2m") * 2.0 + F.col("pm10") * 0.5,
        "Calculated_AQI": F.col("no2") + F.col("surface_pressure") * 0.01,
    }
    return {t: F.floor(s * 4.0) / 4.0 for t, s in scores.items()}


def _walked(c: str) -> str:
    noise = B.noise_sql("42", "station", f"'{c}'", "step")
    logs = f"CASE WHEN step > 0 THEN ln(1 + {noise} * CAST(0.06 AS DOUBLE) - CAST(0.03 AS DOUBLE)) ELSE 0 END"
    return f"first_value({c}) OVER w * exp(sum({logs}) OVER w) AS {c}"


FORECAST_SQL = f"""WITH {CLEAN_SQL}, o AS (SELECT station, max(ts) AS t FROM clean GROUP BY station),
    fut AS (SELECT station, CAST(g.step AS BIGINT) AS step, t + INTERVAL 1 HOUR + to_hours(CAST(g.step AS INTEGER)) AS ts FROM o CROSS JOIN (SELECT unnest(generate_series(0, 71)) AS step) g),
    overall AS (SELECT station, {", ".join(f"avg({f}) AS {f}" for f in HOURLY)} FROM clean GROUP BY station),
    byhour AS (SELECT station, hour, {", ".join(f"avg({f}) AS {f}" for f in HOURLY)} FROM clean GROUP BY station, hour),
    x AS (SELECT f.station, f.step, f.ts, {", ".join(f"CASE WHEN b.hour IS NULL THEN g.{f} ELSE b.{f} END AS {f}" for f in HOURLY)} FROM fut f JOIN overall g ON g.station = f.station LEFT JOIN byhour b ON b.station = f.station AND b.hour = hour(f.ts)),
    w AS (SELECT station, step, ts, pm10, no2, {_walked("temperature_2m")}, {_walked("surface_pressure")} FROM x WINDOW w AS (PARTITION BY station ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT station, step, ts, floor(({_SCORE}) * 4) / CAST(4 AS DOUBLE) AS a, floor((no2 + surface_pressure * CAST(0.01 AS DOUBLE)) * 4) / CAST(4 AS DOUBLE) AS b FROM w)"""


@query(
    "score_forecast",
    f"""{FORECAST_SQL} SELECT station, CAST(step AS INTEGER) AS step, strftime(ts, '%Y-%m-%d %H:%M') AS datetime, strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour,
    {R('a')} AS predicted_aqi_index, {R('b')} AS predicted_calculated_aqi, {B.category_sql('a')} AS aqi_category FROM s""",
)
def score_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """72 hours per station with a closed-form scorer per target."""
    r = B.stored_clean(spark, sf, "hour", *HOURLY)
    return runs.predict(r, HOURLY, closed_scorers())


@query("forecast_by_model")
def forecast_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """72 hours with fitted pipelines, one per target, saved and loaded again as a server does."""
    r = B.stored_clean(spark, sf, "hour", *HOURLY, *schemas.TARGETS)
    history = forecast.drop_null_targets(r)
    path, loaded = new_path(spark, "served"), {}
    for t in schemas.TARGETS:
        model = models.fit_one(history, HOURLY, models.train_linear(t), scaled=True)
        io.save_model(model, models.regression_metrics(model.transform(history), {t: (t, "prediction")}), f"{path}/{t}")
        loaded[t] = io.load_model(f"{path}/{t}").transform
    return runs.predict(r, HOURLY, loaded)


