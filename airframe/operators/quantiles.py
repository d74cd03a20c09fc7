"""Exact ordered statistics of whole columns without collecting a column into one task.

Values are counted first (a partial aggregate), so a value that fills a third of the rows is a single
row afterwards. The distinct values are then cut into ranges by splitters, and running counts are
formed inside the ranges with an offset per range. The splitters only balance the work; they never
influence a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airframe.operators.ordered import running_totals

SEGMENTS = 64


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value) with one row per cell, values as double, NULL and NaN left out."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    out = df.select(*keep, cells.alias("_cell")).select(*keep, "_cell.column", "_cell.value")
    return out.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def splitters(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Approximate borders per column, minimum and maximum included: at most ``SEGMENTS + 1`` numbers
    per column reach the driver."""
    shares = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 1_000).alias(c) for c in columns]).first()
    return {c: sorted({x for x in (row[c] or []) if x == x}) for c in columns}


def range_of(borders: dict[str, list[float]], parts: int = 1) -> Column:
    """Range number of the row's ``value`` for its ``column``, never decreasing in the value.

    The segment between two borders is found by halving the literal borders; a segment is cut
    linearly into ``parts`` ranges, so a large cluster gets many ranges from few borders. Built as SQL
    text: one parsed expression instead of a Column call per node.
    """

    def leaf(points: list[float], i: int) -> str:
        if parts == 1 or i == 0 or i == len(points):
            return str(i * parts)
        low, high = points[i - 1], points[i]
        inner = f"floor((value - ({low!r}D)) * {parts / (high - low)!r}D)"
        return f"({i * parts} + greatest(0, least({parts - 1}, {inner})))"

    def descend(points: list[float], low: int, high: int) -> str:
        if low == high:
            return leaf(points, low)
        mid = (low + high) // 2
        return f"CASE WHEN value < ({points[mid]!r}D) THEN {descend(points, low, mid)} ELSE {descend(points, mid + 1, high)} END"

    arms = " ".join(f"WHEN column = '{name}' THEN {descend(points, 0, len(points))}" for name, points in borders.items())
    return F.expr(f"CAST(CASE {arms} END AS BIGINT)")


def parts_for(df: DataFrame) -> int:
    """Ranges per segment so that the ranges outnumber the shuffle partitions several times."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, 4 * partitions // SEGMENTS)


def cumulative_counts(
    cells: DataFrame,
    borders: dict[str, list[float]],
    sides: dict[str, Column] | None = None,
    keep: Sequence[str] = (),
    following: bool = False,
) -> DataFrame:
    """Per distinct (column, value) and side: own count, inclusive cumulative count ``cum_*`` and the
    column's total ``_all_cum_*``; with ``following`` also the next larger value as ``_next``."""
    sides = sides or {"n": F.lit(True)}
    counted = cells.groupBy(*keep, "column", "value").agg(
        *[F.count_if(flag).alias(name) for name, flag in sides.items()]
    )
    bucket = range_of(borders, parts_for(cells))
    sums = {f"cum_{s}": s for s in sides}
    return running_totals(counted, [*keep, "column"], ["value"], sums, bucket=bucket, following=following)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], borders: dict[str, list[float]] | None = None
) -> DataFrame:
    """(column, q, value): exact quantiles with linear interpolation between neighbouring ranks.

    Each distinct value knows which ranks it covers, so the wanted ones are picked row by row; only
    two rows per column and probability are left to combine.
    """
    borders = borders or splitters(df, columns)
    cum = cumulative_counts(unpivot_numeric(df, columns), borders)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    ranked = cum.select(
        "column", "value", (F.col("cum_n") - F.col("n")).alias("lo"), F.col("cum_n").alias("hi"), F.col("_all_cum_n").alias("all"), wanted.alias("q")
    ).withColumn("rank", F.col("q") * (F.col("all") - 1))
    covers = lambda r: (r >= F.col("lo")) & (r < F.col("hi"))
    below, above = F.floor("rank"), F.ceil("rank")
    ends = ranked.filter(covers(below) | covers(above)).select(
        "column",
        "q",
        (F.col("rank") - below).alias("part"),
        F.when(covers(below), F.col("value")).alias("below"),
        F.when(covers(above), F.col("value")).alias("above"),
    )
    low, high = F.max("below"), F.max("above")
    return ends.groupBy("column", "q").agg((low + (high - low) * F.max("part")).alias("value"))
