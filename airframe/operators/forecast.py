"""Hour-of-day patterns, the forecast frame and its summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions.columns import aqi_category, round_even, time_labels
from airframe.operators import ordered


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys in which NULL equals NULL, keeping the left key columns."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(named, cond, how).drop(*[f"_r_{k}" for k in keys])


def drop_null_targets(df: DataFrame, targets: Sequence[str] = schemas.TARGETS) -> DataFrame:
    return df.dropna(subset=list(targets))


def recent_baseline(df: DataFrame, keys: Sequence[str], year: int, month: int) -> DataFrame:
    """Rows of the given month; if a series has none, of the month before; else of that month in any year.

    The best tier per series is a partial aggregate with one row per series, joined back; a large
    series is never gathered in one task.
    """
    prev_year, prev_month = (year, month - 1) if month > 1 else (year - 1, 12)
    y, m = F.col("year"), F.col("month")
    tier = (
        F.when((y == year) & (m == month), 1)
        .when((y == prev_year) & (m == prev_month), 2)
        .when(m == month, 3)
    )
    tagged = df.withColumn("tier", tier).filter(F.col("tier").isNotNull())
    best = tagged.groupBy(*keys).agg(F.min("tier").alias("_best"))
    joined = _match(tagged, best, keys, "inner") if keys else tagged.crossJoin(F.broadcast(best))
    return joined.filter(F.col("tier") == F.col("_best")).drop("_best")


def hourly_pattern(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean per hour 0..23; an hour without rows takes the overall mean of the series.

    Series means come from the sums and counts of the 24 hour rows, so history is read once.
    """
    sums = df.groupBy(*keys, "hour").agg(
        *[F.sum(F.col(f).cast("double")).alias(f"_s_{f}") for f in features],
        *[F.count(F.col(f)).alias(f"_c_{f}") for f in features],
    )
    whole = sums.groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"_s_{f}"), F.sum(f"_c_{f}")).alias(f"_g_{f}") for f in features]
    )
    spine = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    joined = _match(spine, sums.withColumn("_seen", F.lit(True)), [*keys, "hour"], "left")
    return joined.select(
        *keys,
        "hour",
        *[
            F.when(F.col("_seen"), F.try_divide(F.col(f"_s_{f}"), F.col(f"_c_{f}"))).otherwise(F.col(f"_g_{f}")).alias(f)
            for f in features
        ],
    )


def hour_pattern_join(future: DataFrame, pattern: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach the pattern of the hour. The pattern has 24 rows per series; its size decides the join."""
    return _match(future, pattern, [*keys, "hour"], "left")


def future_features(
    history: DataFrame,
    keys: Sequence[str],
    origins: DataFrame,
    hours: int,
    features: Sequence[str],
    origin: str = "origin",
    walk: Sequence[str] = schemas.WALK_FEATURES,
    seed: int = 42,
) -> DataFrame:
    """Feature rows for the next hours, as many as asked for: spine, hour pattern, random walk on the weather features.

    Features that the spine has itself, the parts of the time, are those of the coming hour, not means of the history.
    """
    if hours < 1:
        raise ValueError("hours must be at least 1")
    spine = ordered.hour_spine(origins, origin, hours, keep=keys)
    meant = [f for f in features if f not in spine.columns]
    filled = hour_pattern_join(spine, hourly_pattern(history, keys, meant), keys)
    walking = [f for f in walk if f in features]
    return ordered.multiplicative_walk(filled, keys, "step", walking, seed=seed) if walking else filled


def score_forecast(
    features: DataFrame,
    scorers: dict[str, Callable[[DataFrame], DataFrame] | Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Apply one scorer per target and shape the forecast rows.

    A scorer is a Column, or a function adding a ``prediction`` column (a fitted model's transform).
    """
    out = features
    names = []
    for target, scorer in scorers.items():
        name = f"predicted_{target.lower()}"
        names.append(name)
        if isinstance(scorer, Column):
            out = out.withColumn(name, scorer)
        else:
            kept = [c for c in out.columns]
            out = scorer(out).select(*kept, F.col("prediction").alias(name))
    labels = time_labels("ts")
    return out.select(
        *keys,
        "step",
        labels["datetime"].alias("datetime"),
        labels["date"].alias("date"),
        labels["hour"].alias("hour"),
        *[round_even(n).alias(n) for n in names],
    ).withColumn("aqi_category", aqi_category(names[0]))


def daily_minmaxmean(df: DataFrame, keys: Sequence[str], date: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, date).agg(
        *[round_even(fn(v)).alias(f"{n}_{v}") for v in values for n, fn in [("min", F.min), ("max", F.max), ("mean", F.avg)]]
    )


def date_spine_join(df: DataFrame, keys: Sequence[str], date: str, days: int, daily: DataFrame) -> DataFrame:
    """Exactly ``days`` calendar dates from the first one of each series; dates without rows keep NULLs."""
    first = df.groupBy(*keys).agg(F.min(F.col(date)).alias("_first"))
    spine = first.select(
        *keys, F.explode(F.sequence(F.col("_first"), F.date_add("_first", days - 1))).alias(date)
    )
    return _match(spine, daily, [*keys, date], "left")


def daily_summary(df: DataFrame, keys: Sequence[str], ts: str, aqi: str, calculated: str, days: int) -> DataFrame:
    """min/max unrounded, mean to two places, category of the mean, on the exact date spine."""
    dated = df.withColumn("date", F.to_date(ts))
    daily = dated.groupBy(*keys, "date").agg(
        *[
            fn(F.col(v)).alias(f"{n}_{label}")
            for label, v in [("aqi_index", aqi), ("calculated_aqi", calculated)]
            for n, fn in [("min", F.min), ("max", F.max), ("mean", lambda c: round_even(F.avg(c)))]
        ]
    )
    return date_spine_join(dated, keys, "date", days, daily).withColumn("aqi_category", aqi_category("mean_aqi_index"))


def forecast_stats(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """mean, min, max and population deviation, rounded to two places."""
    makers = [("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop)]
    return df.groupBy(*keys).agg(*[round_even(fn(F.col(v))).alias(f"{n}_{v}") for v in values for n, fn in makers])


def forecast_insights(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """mean, min, max, sample deviation, and when the minimum and the maximum first occur."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"),
        F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), F.col(order).alias("t"))))["t"].alias("min_at"),
        (F.min(F.when(v.isNotNull(), F.struct((-v).alias("v"), F.col(order).alias("t"))))["t"]).alias("max_at"),
    )


def good_hours(df: DataFrame, keys: Sequence[str], value: str, order: str, n: int = 5) -> DataFrame:
    """First n rows at or below 50; a series without any gets its first n at or below 100.

    Rows are ranked by (tier, time) and cut to n before tiers are compared, so at most n rows per
    series and partition are shuffled.
    """
    v = F.col(value)
    tiered = df.withColumn("tier", F.when(v <= 50, 1).when(v <= 100, 2)).filter(F.col("tier").isNotNull())
    part = [F.col(k) for k in keys] or [F.lit(0)]
    top = tiered.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("tier", order))).filter(
        F.col("rank") <= n
    )
    return top.withColumn("_best", F.min("tier").over(Window.partitionBy(*part))).filter(
        F.col("tier") == F.col("_best")
    ).drop("_best")


def avoid_hours(df: DataFrame, keys: Sequence[str], value: str, order: str, n: int = 5) -> DataFrame:
    """First n rows above 100 per series."""
    part = [F.col(k) for k in keys] or [F.lit(0)]
    return (
        df.filter(F.col(value) > 100)
        .withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(order)))
        .filter(F.col("rank") <= n)
    )


def downsample_steps(df: DataFrame, step: str, start: int, stop: int, every: int) -> DataFrame:
    """Positions ``start`` (inclusive) to ``stop`` (exclusive), every k-th."""
    s = F.col(step)
    return df.filter((s >= start) & (s < stop) & (F.pmod(s - F.lit(start), F.lit(every)) == 0))


def run_metadata(forecast: DataFrame, features: int, model_type: str, generated_at: str) -> DataFrame:
    """One-row record of a forecast run."""
    return forecast.agg(
        F.min("datetime").alias("prediction_start"),
        F.max("datetime").alias("prediction_end"),
        F.count(F.lit(1)).alias("total_hours"),
    ).select(
        F.lit(generated_at).alias("prediction_timestamp"),
        "prediction_start",
        "prediction_end",
        "total_hours",
        F.lit(features).alias("features_used"),
        F.lit(model_type).alias("model_type"),
    )


