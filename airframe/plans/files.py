"""Queries that write a table to the shared folder and read it back: sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airframe import schemas
from airframe.functions import columns as C
from airframe.operators import chunking, forecast, models
from airframe.plans import base as B
from airframe.plans.base import EXAMPLES_SQL, READINGS_SQL, R, query
from airframe.plans.texts import CHUNKS_SQL
from airframe.session import new_path
from airframe.sources import tables as io

_SUMS = ["pm2_5", "pm10", "co", "temperature_2m"]
_STATION_SQL = f"SELECT station, count(*) AS n, count(pm2_5) AS n_pm2_5, {', '.join(f'{R(f'sum({c})')} AS {c}' for c in _SUMS)} FROM readings GROUP BY station"


def _per_station(df: DataFrame) -> DataFrame:
    return df.groupBy("station").agg(F.count(F.lit(1)).alias("n"), F.count("pm2_5").alias("n_pm2_5"), *[F.sum(c).alias(c) for c in _SUMS])


@query("src_readings", f"WITH {READINGS_SQL} {_STATION_SQL}")
def src_readings(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "readings-csv")
    B.readings(spark, sf).write.option("header", True).csv(path)
    return _per_station(io.read_readings(spark, path))


def _observations(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf)
    nested = io.nest_observation(r.columns, F.unix_seconds(F.col("ts").cast("timestamp")))
    return r.select("station", *[c.alias(n) for n, c in nested.items()])


_WITH_STATION = T.StructType([T.StructField("station", T.LongType()), *schemas.OBSERVATION.fields])


@query("src_observations", f"WITH {READINGS_SQL} {_STATION_SQL}")
def src_observations(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "observations")
    io.append_observations(_observations(spark, sf), path)
    back = io.read_observations(spark, path, array_file=False, schema=_WITH_STATION)
    return _per_station(back.select("station", *C.flatten_observation()))


@query(
    "src_documents",
    """WITH n AS (SELECT 'doc' || doc_id || CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.MD' WHEN 'de' THEN '.Txt' ELSE '.html' END AS source, text FROM documents)
    SELECT source, length(text) AS n_chars FROM n WHERE NOT source LIKE '%.html' AND length(text) > 0""",
)
def src_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows count as documents: names get an extension by language, one of them unsupported."""
    d = B.table(spark, sf, "documents")
    ext = F.when(F.col("lang") == "en", ".txt").when(F.col("lang") == "fr", ".MD").when(F.col("lang") == "de", ".Txt").otherwise(".html")
    named = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), ext).alias("source"), "text")
    return io.document_rows(named).select("source", F.length("text").cast("long").alias("n_chars"))


@query(
    "src_eval_jsonl",
    f"WITH {EXAMPLES_SQL} SELECT {R('aqi')} AS aqi, category, md5(expected_summary) AS summary, len(expected_precautions) AS precautions FROM examples",
)
def src_eval_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "examples")
    B.eval_examples(spark, sf).drop("item_id").write.json(path)
    back = io.read_eval_examples(spark, path)
    return back.select("aqi", "category", F.md5("expected_summary").alias("summary"), F.size("expected_precautions").cast("long").alias("precautions"))


@query("sink_append_readings", f"WITH {READINGS_SQL} {_STATION_SQL}")
def sink_append_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends; the first one creates the table."""
    path = new_path(spark, "readings")
    r = B.readings(spark, sf)
    io.append_readings(r.filter(F.col("day") <= 15), path)
    io.append_readings(r.filter(F.col("day") > 15), path)
    return _per_station(io.read_readings(spark, path, "parquet"))


@query("sink_append_raw", f"WITH {READINGS_SQL} {_STATION_SQL}")
def sink_append_raw(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "raw")
    o = _observations(spark, sf)
    hour = F.get(F.col("aqi")["list"], F.lit(0))["dt"] / 3600
    io.append_observations(o.filter(hour % 2 == 0), path)
    io.append_observations(o.filter(hour % 2 == 1), path)
    back = io.read_observations(spark, path, array_file=False, schema=_WITH_STATION)
    return _per_station(back.select("station", *C.flatten_observation()))


@query(
    "sink_table",
    f"WITH {READINGS_SQL} SELECT day, count(*) AS n, {R('sum(CASE WHEN day = 3 THEN pm10 * 2 ELSE pm10 END)')} AS pm10 FROM readings GROUP BY day",
)
def sink_table(spark: SparkSession, sf: str) -> DataFrame:
    """Overwrite the table, then only one of its partitions."""
    path = new_path(spark, "table")
    r = B.readings(spark, sf).select("station", "ts", "pm10", "day")
    io.write_table(r, path, ["day"])
    io.write_table(r.filter(F.col("day") == 3).withColumn("pm10", F.col("pm10") * 2), path, ["day"], replace="partitions")
    return spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("pm10").alias("pm10"))


@query(
    "sink_run_metadata",
    f"""WITH {READINGS_SQL} SELECT '2024-02-01 00:00:00' AS prediction_timestamp, strftime(min(ts), '%Y-%m-%d %H:%M') AS prediction_start, strftime(max(ts), '%Y-%m-%d %H:%M') AS prediction_end,
    count(*) AS total_hours, CAST(22 AS BIGINT) AS features_used, 'closed_form' AS model_type FROM readings""",
)
def sink_run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "runs")
    rows = B.readings(spark, sf).select(C.time_labels("ts")["datetime"].alias("datetime"))
    io.write_run_metadata(forecast.run_metadata(rows, 22, "closed_form", "2024-02-01 00:00:00"), path)
    schema = "prediction_timestamp string, prediction_start string, prediction_end string, total_hours bigint, features_used bigint, model_type string"
    return spark.read.schema(schema).json(path)


#: The line through all line items by normal equations, its metrics once as saved and once as scored again.
_LINE_SQL = """WITH p AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_tax AS DOUBLE) AS z, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
    t AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM p),
    c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM t),
    e AS (SELECT y, y - (a * (x - mx) + b * (z - mz) + my) AS e FROM p CROSS JOIN c),
    m AS (SELECT round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM e)
    SELECT unnest(['saved', 'loaded']) AS origin, rmse AS rmse_price, mae AS mae_price, r2 AS r2_price, rmse AS avg_rmse, mae AS avg_mae, r2 AS avg_r2 FROM m"""


@query("sink_model", _LINE_SQL)
def sink_model(spark: SparkSession, sf: str) -> DataFrame:
    """Save the pipeline and its metrics, load both, and score with the loaded one."""
    li = B.table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_extendedprice")
    model = models.fit_one(li, ["l_quantity", "l_tax"], models.train_linear("l_extendedprice"), scaled=True)
    pairs = {"price": ("l_extendedprice", "prediction")}
    path = new_path(spark, "model")
    io.save_model(model, models.regression_metrics(model.transform(li), pairs), path)
    again = models.regression_metrics(io.load_model(path).transform(li), pairs).withColumn("origin", F.lit("loaded"))
    told = spark.read.parquet(f"{path}/metrics").withColumn("origin", F.lit("saved")).unionByName(again)
    return told.withColumns({c: F.round(c, 6 if c.endswith(("r2", "r2_price")) else 3) for c in told.columns if c != "origin"})


@query(
    "sink_chunks",
    f"""WITH RECURSIVE {CHUNKS_SQL} SELECT d.lang, count(*) AS document_count, count(DISTINCT d.source) AS source_count FROM chunks c JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.lang""",
)
def sink_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Replace the collection, extend it, and count it per language."""
    path = new_path(spark, "chunks")
    d = B.texts(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    io.write_chunks(chunking.chunk_table(d.filter(F.col("lang") == "en")), path)
    io.write_chunks(chunking.chunk_table(d.filter(F.col("lang") != "en")), path, clear=False)
    per_source = spark.read.parquet(path).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("lang").agg(F.sum("n").alias("document_count"), F.count("source").alias("source_count"))
