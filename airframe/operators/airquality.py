"""Index and category operators that need a dimension table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions.columns import calculated_aqi, round_even


def with_calculated_aqi(df: DataFrame, name: str = "Calculated_AQI") -> DataFrame:
    present = {p: p for p in schemas.INDEXED_POLLUTANTS if p in df.columns}
    return df.withColumn(name, calculated_aqi(present))


def sub_index_by_table(df: DataFrame, bands: DataFrame, keep: Sequence[str], pollutants: Sequence[str]) -> DataFrame:
    """(keep…, pollutant, concentration, sub_index) with the bands of each pollutant's own table.

    The band table (a few rows per pollutant) is broadcast; the match is by pollutant and range.
    """
    cells = df.select(
        *keep,
        F.explode(
            F.array(*[F.struct(F.lit(p).alias("pollutant"), F.col(p).cast("double").alias("concentration")) for p in pollutants])
        ).alias("_c"),
    ).select(*keep, "_c.*")
    b = bands.withColumnRenamed("pollutant", "_pollutant")
    matched = cells.join(
        F.broadcast(b),
        (F.col("pollutant") == F.col("_pollutant")) & F.col("concentration").between(F.col("c_low"), F.col("c_high")),
        "left",
    )
    slope = (F.col("i_high") - F.col("i_low")) / (F.col("c_high") - F.col("c_low"))
    value = F.bround(slope * (F.col("concentration") - F.col("c_low")) + F.col("i_low")).cast("int")
    return matched.select(*keep, "pollutant", "concentration", value.alias("sub_index"))


def category_display(df: DataFrame, category: str = "category") -> DataFrame:
    """Attach the display attributes; an unknown category is shown like the first one."""
    table = schemas.category_table(df.sparkSession)
    first = schemas.CATEGORY_DISPLAY[0]
    named = table.withColumnRenamed("category", "_category")
    joined = df.join(F.broadcast(named), F.col(category) == F.col("_category"), "left")  # six rows
    fields = ["color", "bg_color", "text_color", "description", "value_range"]
    return joined.select(
        *[df[c] for c in df.columns],
        *[F.coalesce(F.col(f), F.lit(first[i + 1])).alias(f) for i, f in enumerate(fields)],
    )


def rounded(df: DataFrame, columns: Sequence[str], places: int = 2) -> DataFrame:
    return df.withColumns({c: round_even(c, places) for c in columns})
