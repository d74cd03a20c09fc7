"""Readers and writers. Schemas are declared, never inferred; writes append or overwrite, never rewrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airframe import schemas
from airframe.operators.tables import concat_rows

_BROKEN = "_broken"


def read_readings(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = schemas.READING) -> DataFrame:
    """Flat readings from CSV (with header; columns are found by name) or Parquet.

    All CSV files of one call must have the same header; a file with another one fails the read instead of being
    taken by position.
    """
    if fmt == "csv":
        header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
        types = {f.name: f.dataType for f in schema.fields}
        named = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        df = spark.read.schema(named).option("header", True).option("enforceSchema", False).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    present = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_observations(spark: SparkSession, path: str, array_file: bool = True, schema: T.StructType = schemas.OBSERVATION) -> DataFrame:
    """Nested observations. ``array_file`` reads files holding one JSON array; otherwise one object per
    line (splittable, the form for large data). Broken or non-matching records are left out."""
    with_flag = T.StructType(schema.fields + [T.StructField(_BROKEN, T.StringType())])
    df = (
        spark.read.schema(with_flag)
        .option("multiLine", array_file)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN)
        .json(path)
    )
    whole = F.col(_BROKEN).isNull() & (F.col("aqi").isNotNull() | F.col("weather").isNotNull())
    return df.filter(whole).drop(_BROKEN)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source, text) of every .txt or .md file, one row per file; empty files are skipped."""
    raw = (
        spark.read.option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD]}")
        .option("recursiveFileLookup", False)
        .text(path, wholetext=True)
    )
    return document_rows(raw.select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")))


def document_rows(df: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """The rows that count as documents: a supported name and a non-empty text."""
    return df.filter(F.lower(source).rlike(r"\.(txt|md)$") & (F.length(text) > 0))


def read_eval_examples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation examples from JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.EVAL_EXAMPLE).json(path).filter(
        F.coalesce(*[F.col(f.name).cast("string") for f in schemas.EVAL_EXAMPLE.fields]).isNotNull()
    )


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of every prompt template file."""
    raw = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return raw.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("name"), F.col("value").alias("content"))


def append_readings(df: DataFrame, path: str, partitions: Sequence[str] = ("year", "month")) -> None:
    """Add rows to the table, creating it when absent. Existing files are not touched."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def append_observations(df: DataFrame, path: str) -> None:
    """Add nested observations as JSON lines."""
    df.write.mode("append").json(path)


def aligned(history: DataFrame, new: DataFrame) -> DataFrame:
    return concat_rows(history, new)


def write_table(df: DataFrame, path: str, partitions: Sequence[str] = (), replace: str = "all", fmt: str = "parquet") -> None:
    """Overwrite the table, or with ``replace="partitions"`` only the partitions present in the frame."""
    writer = df.write.mode("overwrite").format(fmt)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.option("partitionOverwriteMode", "dynamic" if replace == "partitions" else "static").save(path)


def write_run_metadata(record: DataFrame, path: str) -> None:
    """Append a one-row run record as JSON."""
    record.coalesce(1).write.mode("append").json(path)


def save_model(model: PipelineModel, metrics: DataFrame, path: str) -> None:
    """The fitted pipeline and its metrics table, side by side."""
    model.write().overwrite().save(f"{path}/model")
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def write_chunks(chunks: DataFrame, path: str, clear: bool = True) -> None:
    """Replace or extend the chunk collection."""
    chunks.write.mode("overwrite" if clear else "append").option("compression", "zstd").parquet(path)


def nest_observation(columns: Sequence[str], epoch: Column) -> dict[str, Column]:
    """Build the nested ``aqi`` and ``weather`` structs from flat columns (absent ones are NULL)."""
    has = set(columns)
    num = lambda c: (F.col(c) if c in has else F.lit(None)).cast("double").alias(c)
    entry = F.struct(
        F.struct((F.col("aqi_index") if "aqi_index" in has else F.lit(None)).cast("int").alias("aqi")).alias("main"),
        F.struct(*[num(p) for p in schemas.POLLUTANTS]).alias("components"),
        epoch.cast("long").alias("dt"),
    )
    coord = F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    weather = [f.name for f in schemas.OBSERVATION["weather"].dataType.fields]
    return {
        "aqi": F.struct(coord.alias("coord"), F.array(entry).alias("list")),
        "weather": F.struct(*[num(w) for w in weather]),
    }
