"""The scalar rules as temporary SQL functions, so that SQL text can use them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from airframe.functions.columns import aqi_category_text, sub_index_text


def register(spark: SparkSession) -> list[str]:
    """Define ``sub_index(x)``, ``aqi_category(x)``, ``round_even2(x)`` and ``token_cost(...)``."""
    bodies = {
        "sub_index(x DOUBLE) RETURNS INT": sub_index_text("x"),
        "aqi_category(x DOUBLE) RETURNS STRING": aqi_category_text("x"),
        "round_even2(x DOUBLE) RETURNS DOUBLE": "rint(x * 100D) / 100D",
        "token_cost(t_in BIGINT, t_out BIGINT, p_in DOUBLE, p_out DOUBLE) RETURNS DOUBLE": "t_in / 1000000D * p_in + t_out / 1000000D * p_out",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in bodies]
