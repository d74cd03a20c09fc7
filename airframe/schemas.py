"""Declared schemas and the small dimension tables (all of fixed, known size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POLLUTANTS = ["co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3"]
WEATHER = [
    "temperature_2m",
    "relative_humidity_2m",
    "precipitation",
    "wind_speed_10m",
    "wind_direction_10m",
    "surface_pressure",
    "dew_point_2m",
    "apparent_temperature",
    "shortwave_radiation",
    "et0_fao_evapotranspiration",
]
CALENDAR = ["year", "month", "day", "hour"]
TARGETS = ["aqi_index", "Calculated_AQI"]
READING_COLUMNS = ["aqi_index", *POLLUTANTS, *WEATHER, *CALENDAR]

#: Pollutants whose sub-index takes part in the overall index.
INDEXED_POLLUTANTS = ["pm2_5", "pm10", "no2", "o3", "so2", "co"]

#: Weather features that follow a random walk in the forecast.
WALK_FEATURES = [
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "wind_speed_10m",
    "wind_direction_10m",
    "surface_pressure",
    "cloud_cover",
    "precipitation",
    "rain",
    "snowfall",
]

# Index breakpoints (c_low, c_high, i_low, i_high).
BREAKPOINTS = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]

# Category upper bounds (the last band is open) and display attributes.
CATEGORY_BOUNDS = [
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
    (None, "Hazardous"),
]
CATEGORY_DISPLAY = [
    ("Good", "#00e400", "#f0f9ff", "#0369a1", "Air quality is satisfactory, and air pollution poses little or no risk.", "0-50"),
    ("Moderate", "#ffff00", "#fef3c7", "#92400e", "Air quality is acceptable. However, there may be a risk for some people.", "51-100"),
    ("Unhealthy for Sensitive Groups", "#ff7e00", "#fed7aa", "#9a3412", "Members of sensitive groups may experience health effects.", "101-150"),
    ("Unhealthy", "#ff0000", "#fecaca", "#dc2626", "Everyone may begin to experience health effects.", "151-200"),
    ("Very Unhealthy", "#8f3f97", "#e9d5ff", "#7c3aed", "Health alert: everyone may experience more serious health effects.", "201-300"),
    ("Hazardous", "#7e0023", "#fee2e2", "#b91c1c", "Health warning of emergency conditions. The entire population is more likely to be affected.", "301+"),
]

# USD per million tokens (model, input, output).
PRICES = [
    ("llama-3.3-70b-versatile", 0.59, 0.79),
    ("llama-3.1-70b-versatile", 0.59, 0.79),
    ("llama-3.1-8b-instant", 0.05, 0.08),
    ("mixtral-8x7b-32768", 0.24, 0.24),
    ("gemma2-9b-it", 0.20, 0.20),
    ("default", 1.00, 1.00),
]

# Histogram upper bounds per metric.
HISTOGRAM_BOUNDS = {
    "llm_request_duration_seconds": [0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 15.0, 30.0],
    "llm_tokens_per_request": [10, 50, 100, 200, 500, 1000, 2000, 5000],
    "llm_cost_per_request_usd": [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1],
    "llm_guardrail_duration_seconds": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5],
    "rag_retrieval_duration_seconds": [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5],
    "rag_documents_retrieved": [1, 2, 3, 5, 10, 20],
    "rag_generation_duration_seconds": [0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 15.0],
    "llm_response_confidence": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0],
}

# Alert limits (indicator, warning, critical, direction).
ALERT_LIMITS = [
    ("p95_latency_seconds", 5.0, 10.0, "above"),
    ("error_rate", 0.01, 0.05, "above"),
    ("violation_rate", 0.05, 0.10, "above"),
    ("avg_confidence", 0.7, 0.5, "below"),
    ("hourly_cost_usd", 1.0, 5.0, "above"),
    ("dataset_drift", 0.2, 0.3, "above"),
]

# Evaluation gate.
GATE_MINIMUMS = {"rouge_l": 0.20, "cosine_similarity": 0.50, "precaution_overlap": 0.30}
GATE_MAX_ERROR_RATE = 0.30
GATE_MAX_LATENCY_SECONDS = 10.0

STRATEGIES = ["zero_shot", "few_shot_k3", "few_shot_k5", "chain_of_thought", "meta_prompt"]
GUARD_EVENT_TYPES = [
    "input_blocked",
    "input_sanitized",
    "input_passed",
    "output_blocked",
    "output_flagged",
    "output_passed",
]

READING = T.StructType(
    [T.StructField("station", T.LongType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField("aqi_index", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in POLLUTANTS + WEATHER]
    + [T.StructField(c, T.IntegerType()) for c in CALENDAR]
)

_COMPONENTS = T.StructType([T.StructField(c, T.DoubleType()) for c in POLLUTANTS])
OBSERVATION = T.StructType(
    [
        T.StructField(
            "aqi",
            T.StructType(
                [
                    T.StructField(
                        "coord",
                        T.StructType(
                            [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
                        ),
                    ),
                    T.StructField(
                        "list",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField(
                                        "main", T.StructType([T.StructField("aqi", T.IntegerType())])
                                    ),
                                    T.StructField("components", _COMPONENTS),
                                    T.StructField("dt", T.LongType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "weather",
            T.StructType(
                [
                    T.StructField(c, T.DoubleType())
                    for c in WEATHER[:6] + ["cloudcover", "visibility"] + WEATHER[6:] + ["timestamp"]
                ]
            ),
        ),
    ]
)

EVAL_EXAMPLE = T.StructType(
    [
        T.StructField("aqi", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("expected_summary", T.StringType()),
        T.StructField("expected_precautions", T.ArrayType(T.StringType())),
    ]
)

ANSWER = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("sources_used", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.StringType()),
    ]
)

EVALUATED = T.StructType([T.StructField("summary", T.StringType()), T.StructField("precautions", T.ArrayType(T.StringType()))])

GUARD_EVENT = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("stage", T.StringType()),
        T.StructField("rule_triggered", T.StringType()),
        T.StructField("violations", T.ArrayType(T.StringType())),
        T.StructField("details", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("query_hash", T.StringType()),
    ]
)


def breakpoint_table(spark: SparkSession, pollutants: list[str] | None = None) -> DataFrame:
    """One row per (pollutant, band). Every pollutant gets the default bands unless replaced."""
    rows = [
        (p, *map(float, band)) for p in (pollutants or INDEXED_POLLUTANTS) for band in BREAKPOINTS
    ]
    return spark.createDataFrame(
        rows, "pollutant string, c_low double, c_high double, i_low double, i_high double"
    )


def category_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CATEGORY_DISPLAY,
        "category string, color string, bg_color string, text_color string, description string, value_range string",
    )


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, price_in double, price_out double")


def alert_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        ALERT_LIMITS, "indicator string, warning double, critical double, direction string"
    )
