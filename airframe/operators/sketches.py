"""Summaries and drift from stored sketches: each day is read once, ever.

A day's rows become one small row per column: counts and moments, which add up exactly, a KLL sketch for quantiles and
an HLL sketch for distinct values, which merge. Any span of days is summed up, and a new day compared with those
before it, from these rows alone; the data of earlier days is never read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size parameter of the quantile sketch and, for it, a bound on the error of a rank (99 % of the time; the published
#: figure for this size, two-sided); registers of the distinct sketch as a power of two and three deviations of its estimate.
KLL_K, RANK_ERROR = 800, 0.005
HLL_LG, DISTINCT_ERROR = 14, 3 * 0.0082
#: Places per sketch at which two distributions are compared.
GRID = 400
KS_ERROR = 2 * (RANK_ERROR + 1 / GRID)


def day_sketches(df: DataFrame, columns: Sequence[str], day: Column | str) -> DataFrame:
    """``(day, column, rows, n, mean, m2, least, most, quantiles, distinct)``, one row for each day and column, in one scan.

    NULL and NaN are missing: they count in ``rows`` only. ``m2`` is the sum of squared deviations. A day that holds a
    third of all rows costs one partial row for each task.
    """
    day = F.col(day) if isinstance(day, str) else day
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    table = df.select(day.alias("day"), *[x.alias(f"c{i}") for i, x in enumerate(clean.values())])

    def made(i: int) -> list[Column]:
        x = F.col(f"c{i}")
        parts = {"n": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "least": F.min(x), "most": F.max(x)}
        parts |= {"quantiles": F.kll_sketch_agg_double(x, KLL_K), "distinct": F.hll_sketch_agg(x.cast("string"), HLL_LG)}
        return [e.alias(f"c{i}_{k}") for k, e in parts.items()]

    by_day = table.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), *[e for i in range(len(columns)) for e in made(i)])
    fields = ("n", "mean", "m2", "least", "most", "quantiles", "distinct")
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"c{i}_{k}").alias(k) for k in fields]) for i, c in enumerate(columns)]
    return by_day.select("day", "rows", F.explode(F.array(*each)).alias("s")).select("day", "s.column", "rows", *[f"s.{k}" for k in fields])


def store_day(df: DataFrame, columns: Sequence[str], day: Column | str, path: str) -> None:
    """Add the sketches of the days in ``df``, a folder for each; a day that is stored again replaces itself."""
    sketches = day_sketches(df, columns, day)
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merged(days: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Rows of several days as one for each key. Means and deviations add up exactly; a handful of numbers and two sketches of
    bounded size move for each day."""
    w = Window.partitionBy(*by)
    centre = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(w), F.sum("n").over(w))
    off = F.col("mean") - F.col("centre")
    return days.withColumn("centre", centre).groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
    )


def summary(days: DataFrame) -> DataFrame:
    """Count, missing, distinct, mean, deviation, least, quartiles and most per column from stored sketches.

    ``q25``, ``q50`` and ``q75`` are values whose rank is off by at most ``RANK_ERROR``; ``distinct`` is an estimate within
    ``DISTINCT_ERROR``; the others are exact. A column without values has NULLs.
    """
    quart = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(n) for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    std = F.sqrt(F.try_divide("m2", F.col("n") - 1))
    return merged(days).select(
        "column", F.col("n").alias("count"), (F.col("rows") - F.col("n")).alias("missing"), F.hll_sketch_estimate("distinct").alias("distinct"), "mean", std.alias("std"), F.col("least").alias("min"), *quart, F.col("most").alias("max")
    )


def ks_between(reference: DataFrame, current: DataFrame) -> DataFrame:
    """``(column, reference_rows, current_rows, ks)``: the largest difference of the two distributions per column, from sketches.

    Each side is known by ``GRID`` even quantiles, so the result is within ``KS_ERROR`` of the exact statistic.
    """
    places = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])

    def side(days: DataFrame, rows: str, name: str) -> DataFrame:
        return merged(days).where("n > 0").select("column", F.col("n").alias(rows), F.kll_sketch_get_quantile_double("quantiles", places).alias(name))

    def share(quantiles: str, x: Column) -> Column:
        """Share of the rows up to x: the last of the even quantiles that is not above it."""
        return F.greatest(F.size(F.filter(quantiles, lambda q: q <= x)) - 1, F.lit(0)) / F.lit(float(GRID))

    both = side(reference, "reference_rows", "a").join(side(current, "current_rows", "b"), "column")
    gap = F.transform(F.array_union("a", "b"), lambda x: F.abs(share("a", x) - share("b", x)))
    return both.select("column", "reference_rows", "current_rows", F.array_max(gap).alias("ks"))
