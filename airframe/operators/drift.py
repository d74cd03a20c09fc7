"""Distribution shift between a reference part and a current part of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airframe.operators import quantiles

SIDE = "side"


def _side_flags(side: str) -> dict[str, Column]:
    return {"n_ref": F.col(side) == "reference", "n_cur": F.col(side) == "current"}


def _ecdf(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    """(column, value, _next, f_ref, f_cur, t_ref, t_cur) over the distinct values of both sides."""
    borders = quantiles.splitters(df, columns)
    cells = quantiles.unpivot_numeric(df, columns, [side])
    cum = quantiles.cumulative_counts(cells, borders, _side_flags(side), following=True)
    return cum.select(
        "column",
        "value",
        "_next",
        F.try_divide(F.col("cum_n_ref").cast("double"), F.col("_all_cum_n_ref")).alias("f_ref"),
        F.try_divide(F.col("cum_n_cur").cast("double"), F.col("_all_cum_n_cur")).alias("f_cur"),
        F.col("_all_cum_n_ref").alias("t_ref"),
        F.col("_all_cum_n_cur").alias("t_cur"),
    )


def ks_p_value(d: Column, n: Column, m: Column, terms: int = 20) -> Column:
    """Asymptotic two-sample p-value: twice the alternating series of exp(-2 k² λ²)."""
    lam = d * F.sqrt(n * m / (n + m))
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + F.lit(float((-1) ** (k - 1))) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    p = F.lit(2.0) * total
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def ks_statistic(df: DataFrame, columns: Sequence[str], side: str = SIDE) -> DataFrame:
    """Largest gap between the two empirical distributions per column, with its p-value."""
    return (
        _ecdf(df, columns, side)
        .groupBy("column")
        .agg(
            F.max(F.abs(F.col("f_ref") - F.col("f_cur"))).alias("statistic"),
            F.max("t_ref").cast("double").alias("_n"),
            F.max("t_cur").cast("double").alias("_m"),
        )
        .select("column", "statistic", ks_p_value(F.col("statistic"), F.col("_n"), F.col("_m")).alias("p_value"))
    )


def wasserstein(df: DataFrame, columns: Sequence[str], side: str = SIDE) -> DataFrame:
    """Earth-mover distance, and the same divided by the deviation of the reference part."""
    gap = F.abs(F.col("f_ref") - F.col("f_cur")) * (F.col("_next") - F.col("value"))
    distance = _ecdf(df, columns, side).groupBy("column").agg(F.sum(gap).alias("distance"))
    spread = df.filter(F.col(side) == "reference").agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns])
    spread = spread.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("spread")) for c in columns])).alias("_s")
    ).select("_s.*")
    return distance.join(F.broadcast(spread), "column").select(  # one row per column name
        "column", "distance", F.try_divide(F.col("distance"), F.col("spread")).alias("normalised")
    )


def category_drift(df: DataFrame, columns: Sequence[str], side: str = SIDE) -> DataFrame:
    """Jensen–Shannon distance (natural logarithm) between the category shares of the two parts."""
    cells = df.select(
        side,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
        ).alias("_c"),
    ).select(side, "_c.*")
    flags = _side_flags(side)
    counts = cells.groupBy("column", "value").agg(*[F.count_if(f).alias(n) for n, f in flags.items()])
    totals = counts.groupBy("column").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    p = F.try_divide(F.col("n_ref").cast("double"), F.col("t_ref"))
    q = F.try_divide(F.col("n_cur").cast("double"), F.col("t_cur"))
    m = (F.col("p") + F.col("q")) / 2

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))

    shares = counts.join(F.broadcast(totals), "column").select("column", "value", p.alias("p"), q.alias("q"))
    return shares.groupBy("column").agg(
        F.count(F.lit(1)).alias("categories"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum(term(F.col("p")) + term(F.col("q"))) / 2)).alias("distance"),
    )


def dataset_drift(scores: DataFrame, score: str, threshold: float, share_limit: float = 0.5, below: bool = False) -> DataFrame:
    """Number and share of drifted columns and whether the table as a whole has drifted."""
    drifted = F.col(score) < threshold if below else F.col(score) >= threshold
    return scores.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if(drifted).alias("drifted"),
    ).select(
        "columns",
        "drifted",
        F.try_divide(F.col("drifted").cast("double"), F.col("columns")).alias("share"),
        F.coalesce(F.try_divide(F.col("drifted").cast("double"), F.col("columns")) >= share_limit, F.lit(False)).alias(
            "dataset_drift"
        ),
    )


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """Character and word counts of each text."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: F.length(w) > 0))
    return df.withColumn("char_count", F.length(text)).withColumn("word_count", words)


def corpus_drift(df: DataFrame, text: str, side: str = SIDE) -> DataFrame:
    """Shift of text length and word count between two corpora."""
    return ks_statistic(text_statistics(df, text).select(side, "char_count", "word_count"), ["char_count", "word_count"], side)


def embedding_drift(df: DataFrame, vector: str, components: int = 5, side: str = SIDE) -> DataFrame:
    """Vectors reduced to principal components fitted on the reference part, compared per component."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    typed = df.select(side, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    model = PCA(k=components, inputCol="_v", outputCol="_p").fit(typed.filter(F.col(side) == "reference"))
    parts = model.transform(typed).withColumn("_a", vector_to_array("_p"))
    named = parts.select(side, *[F.col("_a")[i].alias(f"component_{i}") for i in range(components)])
    return ks_statistic(named, [f"component_{i}" for i in range(components)], side)


def usage_drift(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], side: str = SIDE) -> DataFrame:
    """Shift of request measurements and labels between two parts of a request log."""
    num = ks_statistic(df, numeric, side).select(
        "column", F.lit("ks").alias("method"), F.col("statistic").alias("score")
    )
    cat = category_drift(df, categorical, side).select(
        "column", F.lit("jensen_shannon").alias("method"), F.col("distance").alias("score")
    )
    return num.unionByName(cat)
