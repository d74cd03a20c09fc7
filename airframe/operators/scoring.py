"""Scores of generated text and the evaluation gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airframe import schemas
from airframe.functions.columns import as_col, cosine_similarity, labels_where
from airframe.functions.stem import stems


def tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    parts = F.split(F.regexp_replace(F.lower(as_col(text)), "[^a-z0-9]+", " "), " ")
    return F.filter(parts, lambda w: w != "")


@F.pandas_udf(T.LongType())
def _common_subsequence(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest common subsequence length, one machine-word-parallel sweep per pair."""

    def one(a, b) -> int:
        where: dict[str, int] = {}
        for i, word in enumerate(a):
            where[word] = where.get(word, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for word in b:
            hit = row & where.get(word, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    return pd.Series([one(a, b) for a, b in zip(left, right)], dtype="int64")


def rouge_l(df: DataFrame, generated: str, reference: str, name: str = "rouge_l", stemmed: bool = True) -> DataFrame:
    """Add the F1 of the longest common token subsequence; 0 when either text has no token.

    Tokens over three letters are compared by their stems, unless ``stemmed`` is off.
    """

    def words(c: str) -> Column:
        found = F.coalesce(tokens(c), F.array().cast("array<string>"))
        return stems(found) if stemmed else found

    toks = df.withColumns({"_g": words(generated), "_r": words(reference)})
    scored = toks.withColumn("_lcs", _common_subsequence("_g", "_r").cast("double"))
    p = F.try_divide(F.col("_lcs"), F.size("_g"))
    r = F.try_divide(F.col("_lcs"), F.size("_r"))
    return scored.withColumn(name, F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))).drop("_g", "_r", "_lcs")


def precaution_overlap(generated: Column | str, expected: Column | str, threshold: float = 0.6) -> Column:
    """Share of the expected vectors whose best cosine with any generated vector reaches the threshold.

    Both lists belong to one row, so the comparison stays inside the row.
    """
    g, e = as_col(generated), as_col(expected)
    best = F.transform(e, lambda x: F.array_max(F.transform(g, lambda y: cosine_similarity(x, y))))
    hits = F.size(F.filter(best, lambda s: s >= threshold))
    usable = (F.size(g) > 0) & (F.size(e) > 0)
    return F.when(usable, hits / F.size(e)).otherwise(F.lit(0.0))


def fit_text_vectors(texts: DataFrame, text: str, features: int = 256):
    """Hashed term weights for tables that carry no embedding column: a fitted MLlib pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts.select(tokens(text).alias("_tokens")))


def text_vectors(df: DataFrame, text: str, model, name: str = "vector") -> DataFrame:
    """Add the dense unit vector of the text as an array column."""
    from pyspark.ml.functions import vector_to_array

    toks = df.withColumn("_tokens", F.coalesce(tokens(text), F.array().cast("array<string>")))
    return model.transform(toks).withColumn(name, vector_to_array("_unit")).drop("_tokens", "_tf", "_weights", "_unit")


def strategy_cross(df: DataFrame, strategies: Sequence[str] = schemas.STRATEGIES) -> DataFrame:
    """Every strategy with every example, as a row expansion by the fixed list (no join)."""
    return df.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))


def eval_by_strategy(results: DataFrame, strategy: str = "strategy", error: str = "error") -> DataFrame:
    """Averages over the rows without error, population deviation of two scores, and the error rate."""
    ok = F.col(error).isNull() | (F.col(error) == "")
    good = lambda c: F.when(ok, F.col(c))
    return (
        results.groupBy(strategy)
        .agg(
            F.avg(good("rouge_l")).alias("avg_rouge_l"),
            F.avg(good("cosine_similarity")).alias("avg_cosine_similarity"),
            F.avg(good("precaution_overlap")).alias("avg_precaution_overlap"),
            F.avg(good("latency_seconds")).alias("avg_latency"),
            F.stddev_pop(good("rouge_l")).alias("std_rouge_l"),
            F.stddev_pop(good("cosine_similarity")).alias("std_cosine_similarity"),
            F.count(F.lit(1)).alias("num_examples"),
            F.count_if(ok).alias("num_successful"),
        )
        .withColumn("error_rate", (F.col("num_examples") - F.col("num_successful")) / F.col("num_examples"))
        .withColumn("error", F.when(F.col("num_successful") == 0, F.lit("All examples failed")))
    )


def quality_gate(metrics: DataFrame, check_latency: bool = False) -> DataFrame:
    """Add ``passed`` and ``failed_checks``; a strategy without a successful row fails."""
    labels = {"rouge_l": "ROUGE-L", "cosine_similarity": "Cosine", "precaution_overlap": "Overlap"}

    def text(name: str, value: Column, sign: str, limit: float) -> Column:
        return F.concat(F.lit(f"{name} "), F.format_string("%.2f", value), F.lit(f" {sign} {limit}"))

    checks = []
    for score, limit in schemas.GATE_MINIMUMS.items():
        value = F.coalesce(F.col(f"avg_{score}"), F.lit(0.0))
        checks.append((value < limit, text(labels[score], value, "<", limit)))
    rate = F.coalesce(F.col("error_rate"), F.lit(1.0))
    checks.append((rate > schemas.GATE_MAX_ERROR_RATE, text("Error rate", rate, ">", schemas.GATE_MAX_ERROR_RATE)))
    if check_latency:
        late = F.coalesce(F.col("avg_latency"), F.lit(0.0))
        checks.append((late > schemas.GATE_MAX_LATENCY_SECONDS, text("Latency", late, ">", schemas.GATE_MAX_LATENCY_SECONDS)))
    failed = reduce(lambda a, b: a | b, [flag for flag, _ in checks])
    return metrics.withColumns({"passed": ~failed, "failed_checks": F.array_join(labels_where(checks), "; ")})


def gate_summary(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("strategies"))


REQUIRED_FIELDS = ["aqi", "category", "expected_summary", "expected_precautions"]


def eval_set_issues(examples: DataFrame, row: str, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """(row, issue, order) for each broken rule: missing field, index outside 0..500, unknown category."""
    names = [n for _, n in schemas.CATEGORY_BOUNDS]
    number = F.col(row).cast("string")
    made = [
        F.when(F.col(f).isNull(), F.concat(F.lit("Example "), number, F.lit(f": missing '{f}'"))) for f in fields
    ]
    made.append(
        F.when(
            ~F.col("aqi").between(0, 500),
            F.concat(F.lit("Example "), number, F.lit(": invalid AQI value "), F.col("aqi").cast("string")),
        )
    )
    made.append(
        F.when(
            ~F.col("category").isin(names),
            F.concat(F.lit("Example "), number, F.lit(": invalid category '"), F.col("category"), F.lit("'")),
        )
    )
    return examples.select(F.col(row), F.posexplode(F.array(*made)).alias("order", "issue")).filter(
        F.col("issue").isNotNull()
    )


def eval_set_checks(examples: DataFrame, row: str, minimum: int = 5) -> DataFrame:
    """One row: number of examples and issues, and whether the set may be used."""
    issues = eval_set_issues(examples, row).agg(F.count(F.lit(1)).alias("issues"))
    total = examples.agg(F.count(F.lit(1)).alias("examples"))
    return total.crossJoin(F.broadcast(issues)).withColumn(  # one row on each side
        "valid", (F.col("examples") >= minimum) & (F.col("issues") == 0)
    )


def first_issues(issues: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n issues with the number of further ones; the rest is counted, not collected."""
    top = issues.orderBy(*order).limit(n)
    more = issues.agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("more"))
    return top.crossJoin(F.broadcast(more))  # exactly one row


def template_checks(templates: DataFrame, name: str = "name", content: str = "content", required: Sequence[str] = schemas.STRATEGIES) -> DataFrame:
    """Present, at least 50 characters, mentions json, mentions the index; one row per required template."""
    spine = templates.sparkSession.createDataFrame([(r,) for r in required], "required string")
    text = F.col(content)
    joined = spine.join(
        templates.select(F.col(name).alias("_name"), text.alias("_text")), F.col("required") == F.col("_name"), "left"
    )
    low = F.lower("_text")
    return joined.select(
        F.col("required").alias("name"),
        F.col("_text").isNotNull().alias("present"),
        F.coalesce(F.length("_text") >= 50, F.lit(False)).alias("long_enough"),
        F.coalesce(F.contains(low, F.lit("json")), F.lit(False)).alias("mentions_json"),
        F.coalesce(F.contains(low, F.lit("aqi")), F.lit(False)).alias("mentions_aqi"),
    ).withColumn("valid", F.col("present") & F.col("long_enough"))
