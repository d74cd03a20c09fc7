"""The reference workflows end to end: ingest documents, train, forecast, answer guarded questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions.columns import cosine_similarity, parse_answer, parse_evaluation, render_prompt, strip
from airframe.operators import airquality, chunking, forecast, guards, models, ordered, retrieval, scoring, telemetry
from airframe.session import new_path, shared_folder
from airframe.sources import tables as io

KEY, ORDER = ["station"], ["ts"]


def ingest(documents: DataFrame, path: str, clear: bool = True) -> DataFrame:
    """Chunk the documents into the collection at ``path`` and return the collection's numbers."""
    io.write_chunks(chunking.chunk_table(documents), path, clear)
    return chunking.collection_stats(documents.sparkSession.read.parquet(path))


def clean(readings: DataFrame, keys: Sequence[str] = KEY, order: Sequence[str] = ORDER, seconds: int = 86_400) -> DataFrame:
    """Repeated rows dropped, gaps filled by column, index computed."""
    return airquality.with_calculated_aqi(ordered.impute_readings(readings.dropDuplicates(), keys, order, seconds=seconds))


def train(
    readings: DataFrame,
    features: Sequence[str],
    path: str,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = ORDER,
    trees: int = 300,
    rounds: int = 300,
) -> DataFrame:
    """Clean table, split, all estimators, best one saved per target. Returns the metrics table.

    The clean table and the metrics are written once and read back by every later step.
    """
    spark = readings.sparkSession
    io.write_table(clean(readings, keys, order), f"{path}/clean")
    rows = forecast.drop_null_targets(spark.read.parquet(f"{path}/clean"))
    parts = models.random_split(rows, [*keys, *order])
    measured, fitted = models.train_and_rank(parts, features, schemas.TARGETS, trees=trees, rounds=rounds)
    io.write_table(measured, f"{path}/metrics")
    metrics = spark.read.parquet(f"{path}/metrics")
    best = models.pick_best_model(metrics).first()["model"]
    for target, model in fitted[best].items():
        io.save_model(model, metrics, f"{path}/{target}")
    return metrics


def predict(
    history: DataFrame,
    features: Sequence[str],
    scorers: dict[str, Callable[[DataFrame], DataFrame] | Column],
    hours: int = 72,
    keys: Sequence[str] = KEY,
    origins: DataFrame | None = None,
) -> DataFrame:
    """Hourly forecast after the last reading of each series (or after given origins)."""
    starts = history.groupBy(*keys).agg(F.max("ts").alias("origin")) if origins is None else origins
    return forecast.score_forecast(forecast.future_features(history, keys, starts, hours, features), scorers, keys)


def serve(spark: SparkSession, path: str, features: Sequence[str], hours: int = 72, keys: Sequence[str] = KEY) -> DataFrame:
    """Hourly forecast by the models that ``train`` saved at ``path``, from the clean table it left there."""
    history = spark.read.parquet(f"{path}/clean")
    return predict(history, features, {t: io.load_model(f"{path}/{t}").transform for t in schemas.TARGETS}, hours, keys)


def evaluate(examples: DataFrame, templates: dict[str, str], responses: DataFrame, row: str = "item_id", features: int = 256) -> DataFrame:
    """Scored results of recorded responses: one row per example and strategy.

    examples: (row, aqi, category, expected_summary, expected_precautions); templates: prompt text per strategy;
    responses: (row, strategy, response, latency_seconds). A response that is no JSON object, or is
    missing, is an error. Vectors come from hashed term weights fitted on the expected texts; an example's few
    precautions are compared inside their row.
    """
    shared_folder(examples.sparkSession)
    ids = [row, "strategy"]
    texts = F.create_map(*[F.lit(x) for pair in templates.items() for x in pair])
    crossed = scoring.strategy_cross(examples, list(templates)).withColumn(
        "prompt", render_prompt(F.element_at(texts, F.col("strategy")), "aqi", "category")
    )
    parsed = responses.select(*ids, "latency_seconds", parse_evaluation("response").alias("_p")).select(*ids, "latency_seconds", "_p.*")
    # Read by the scores and by the vectors of the precautions.
    both = crossed.join(parsed, ids, "left").withColumn("failed", F.coalesce("parse_error", F.lit(True))).checkpoint()
    model = scoring.fit_text_vectors(examples.where("expected_summary IS NOT NULL"), "expected_summary", features)
    scored = scoring.rouge_l(both, "summary", "expected_summary")
    for side in ("summary", "expected_summary"):
        scored = scoring.text_vectors(scored, side, model, f"_{side}")
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.col(n).alias("items")) for n in ("precautions", "expected_precautions")]))
    phrases = both.where("NOT failed").select(*ids, sides.alias("_s")).select(*ids, "_s.side", F.explode("_s.items").alias("phrase"))
    vectors = scoring.text_vectors(phrases, "phrase", model).groupBy(*ids)
    lists = vectors.agg(*[F.collect_list(F.when(F.col("side") == n, F.col("vector"))).alias(f"_{n}") for n in ("precautions", "expected_precautions")])
    good = lambda c: F.when(~F.col("failed"), c)
    return scored.join(lists, ids, "left").select(
        *ids,
        "prompt",
        good(F.col("rouge_l")).alias("rouge_l"),
        good(cosine_similarity("_summary", "_expected_summary")).alias("cosine_similarity"),
        good(F.coalesce(scoring.precaution_overlap("_precautions", "_expected_precautions"), F.lit(0.0))).alias("precaution_overlap"),
        "latency_seconds",
        F.when(F.col("failed"), F.lit("Failed to parse JSON")).alias("error"),
    )


def predict_daily(hourly: DataFrame, days: int = 3, keys: Sequence[str] = KEY) -> DataFrame:
    """Exactly ``days`` calendar days per series from a forecast."""
    timed = hourly.withColumn("ts", F.to_timestamp("datetime", "yyyy-MM-dd HH:mm"))
    return forecast.daily_summary(timed, keys, "ts", "predicted_aqi_index", "predicted_calculated_aqi", days)


def index_chunks(chunks: DataFrame, path: str, features: int = 256, clear: bool = True):
    """Store the chunks at ``path`` and the index of their vectors beside them; returns the fitted vector model for the
    questions, and the index. Vectors are kept once, in single precision."""
    io.write_chunks(chunks, path, clear)
    stored = chunks.sparkSession.read.parquet(path)
    model = scoring.fit_text_vectors(stored, "chunk", features)
    return model, retrieval.build_index(_single(scoring.text_vectors(stored, "chunk", model), "cid"), f"{path}-index", "cid", "vector")


def _single(df: DataFrame, id: str) -> DataFrame:
    return df.select(id, F.col("vector").cast("array<float>").alias("vector"))


def answer_questions(
    questions: DataFrame, collection: DataFrame, model, index: retrieval.Index, responses: DataFrame, k: int = retrieval.TOP_K
) -> DataFrame:
    """Outcome of recorded questions: guard, retrieve, parse the recorded response, guard again.

    questions: (qid, question); collection: (cid, source, chunk) as stored by ``index_chunks``, with its model and index;
    responses: (qid, response, tokens). Joins are equi-joins on qid and cid; both guards are projections.
    """
    shared_folder(questions.sparkSession)
    # Verdicts are read by retrieval and by the final join.
    q = (
        guards.input_guard(questions, "question")
        .select(
            "qid",
            F.col("passed").alias("input_passed"),
            F.col("violations").alias("input_violations"),
            F.coalesce("sanitized", "question").alias("asked"),
        )
        .checkpoint()
    )
    # Equal questions are looked up once, under a number that the checkpoint keeps.
    same = q.filter("input_passed").select("asked").distinct().withColumn("query_id", F.monotonically_increasing_id()).checkpoint()
    asked = _single(scoring.text_vectors(same, "asked", model), "query_id").withColumnRenamed("vector", "query_vector")
    # Written first, so that hits of a known small size go to the chunks, and the chunks stay where they are.
    path = new_path(questions.sparkSession, "hits")
    retrieval.knn_topk(asked, None, k, index=index, home=False).write.parquet(path)
    hits = questions.sparkSession.read.parquet(path)
    found = hits.join(collection.select(F.col("cid").alias("chunk_id"), "source", "chunk"), "chunk_id")
    # At most k rows per question.
    packed = F.sort_array(F.collect_list(F.struct("rank", "source", "chunk")))
    context = found.groupBy("query_id").agg(packed.alias("_hits")).select(
        "query_id",
        F.size("_hits").alias("documents"),
        F.array_join(F.transform("_hits", lambda h: h["chunk"]), " ").alias("context"),
        F.transform("_hits", lambda h: h["source"]).alias("sources"),
    )
    parsed = responses.select("qid", "tokens", parse_answer(strip("response")).alias("_p")).select("qid", "tokens", "_p.*")
    # A sanitized question may equal one that the guard stopped, which gets no documents.
    known = context.join(same, "query_id").select(F.col("asked").alias("_same"), "documents", "context", "sources")
    joined = q.join(known, F.col("asked").eqNullSafe(F.col("_same")) & F.col("input_passed"), "left").join(parsed, "qid", "left")
    ready = joined.withColumns(
        {
            "documents": F.coalesce("documents", F.lit(0)),
            "answer": F.coalesce("answer", F.lit("")),
            "context": F.coalesce("context", F.lit("")),
            "generated": ~F.coalesce("parse_error", F.lit(True)),
        }
    )
    checked = guards.output_guard(ready, "answer", "context", "sources", "sources_used", "confidence")
    status = telemetry.query_status("input_passed", "documents", "generated", "passed")
    return checked.select(
        "qid",
        status.alias("status"),
        "documents",
        "input_violations",
        F.when(F.col("input_passed") & F.col("generated"), F.col("violations")).alias("output_violations"),
        F.when(F.col("input_passed") & F.col("generated"), F.col("confidence_score")).alias("confidence_score"),
        "tokens",
    )

