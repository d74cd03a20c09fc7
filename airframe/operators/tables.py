"""Whole-table operators: column housekeeping, set operations, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airframe import schemas
from airframe.operators import quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def model_columns(df: DataFrame, targets: Sequence[str] = schemas.TARGETS) -> list[str]:
    """Feature names: everything that is neither a target nor a date or time."""
    timed = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if f.name not in targets and not isinstance(f.dataType, timed)]


def project_columns(df: DataFrame, columns: Sequence[str] = schemas.READING_COLUMNS) -> DataFrame:
    return df.select(*columns)


def null_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) sorted by nulls descending: one scan, one row per column afterwards."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in columns])
    )
    return counted.select(cells.alias("_c")).select("_c.*").orderBy(F.desc("nulls"), "column")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Remove columns that hold no value in any row (one counting pass; one row reaches the driver)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct; NULL equals NULL. Aggregated map-side, so copies never meet in one task."""
    return df.dropDuplicates()


def concat_rows(*frames: DataFrame) -> DataFrame:
    """Append frames by column name; a column missing on one side is NULL there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def required_columns(df: DataFrame, history: DataFrame, required: Sequence[str]) -> DataFrame:
    """Add the required columns the frame lacks, each filled with its mean over the history."""
    lacking = [c for c in required if c not in df.columns and c in history.columns]
    if not lacking:
        return df.select(*required)
    means = history.agg(*[F.avg(c).alias(c) for c in lacking])
    return df.crossJoin(F.broadcast(means)).select(*required)  # the right side is exactly one row


def describe_table(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample deviation, min, quartiles, max per numeric column.

    Exact quartiles shuffle the distinct values of every column. ``exact=False`` takes approximate
    ones within the one pass that makes the other numbers.
    """
    columns = list(columns or numeric_columns(df))
    if not exact:
        quick = [(n, lambda c, q=q: F.percentile_approx(c, q, 10_000)) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        return _moments(df, columns, quick).select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    quarts = quantiles.exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    wide = quarts.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]]
    )
    return _moments(df, columns).join(wide, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def _moments(df: DataFrame, columns: Sequence[str], extra: Sequence[tuple[str, object]] = ()) -> DataFrame:
    aggs, fields = [], []
    makers = [
        ("count", F.count),
        ("mean", F.avg),
        ("std", F.stddev_samp),
        ("min", F.min),
        ("max", F.max),
        *extra,
    ]
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [fn(x).alias(f"{c}__{n}") for n, fn in makers]
        fields.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{n}").alias(n) for n, _ in makers]))
    return df.agg(*aggs).select(F.explode(F.array(*fields)).alias("_r")).select("_r.*")


def data_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, missing, distinct, most common value, min/max/mean/std, quartiles."""
    columns = list(columns or numeric_columns(df))
    borders = quantiles.splitters(df, columns)
    cells = quantiles.unpivot_numeric(df, columns)
    counted = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    common = counted.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.max_by("value", F.struct(F.col("n"), -F.col("value"))).alias("most_common"),
        F.max("n").alias("most_common_count"),
    )
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    quarts = quantiles.exact_quantiles(df, columns, [0.25, 0.5, 0.75], borders)
    wide = quarts.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]]
    )
    return (
        _moments(df, columns)
        .join(common, "column", "left")
        .join(wide, "column", "left")
        .crossJoin(F.broadcast(total))  # exactly one row
        .select(
            "column", "count", (F.col("rows") - F.col("count")).alias("missing"), "distinct",
            "most_common", "most_common_count", "mean", "std", "min", "q25", "q50", "q75", "max",
        )
    )


def top_by(df: DataFrame, order: Column | str, n: int, ascending: bool = False, tie: str | None = None) -> DataFrame:
    """The n best rows (a top-k plan: each partition keeps n rows)."""
    c = F.col(order) if isinstance(order, str) else order
    keys = [c.asc() if ascending else c.desc()] + ([F.col(tie)] if tie else [])
    return df.orderBy(*keys).limit(n)


def head_tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """First and last n rows by the order, tagged; both are top-k plans."""
    first = df.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category, sorted by name; missing names count as ``Unknown``."""
    return (
        df.groupBy(F.coalesce(F.col(column), F.lit("Unknown")).alias(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(column)
    )


def category_breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per category, most frequent first. The share is over the few groups."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))  # exactly one row
        .select(column, "n", (F.col("n") * F.lit(100.0) / F.col("_total")).alias("pct"))
        .orderBy(F.desc("n"), column)
    )
