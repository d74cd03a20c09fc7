"""The continuous side: arrivals, repeated hours, rates, guard counts, safety status, latency quantiles."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from airframe.functions.columns import flatten_observation
from airframe.operators import telemetry


def table_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder (or glob) as a stream with a declared schema."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_readings(observations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Arriving nested observations as flat readings."""
    return observations.select(*keep, *flatten_observation())


def stream_dedup(readings: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """Drop repeats of the same series and hour that arrive within the delay; older state is forgotten."""
    return readings.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def stream_rates(events: DataFrame, ts: str, by: Sequence[str], amount: Column | None = None, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Sum (or count) per sliding window: one stateful aggregate with partial sums in every task."""
    total = F.sum(amount) if amount is not None else F.count(F.lit(1))
    windows = events.withWatermark(ts, delay).groupBy(F.window(ts, window, slide).alias("window"), *by)
    return telemetry.per_window(windows.agg(total.cast("double").alias("increase")), by)


def stream_pairs(answers: DataFrame, questions: DataFrame, follows: str, ts: str = "ts", within: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Answers (side ``a``) with the question (side ``u``) they follow within a time, whichever of the two arrives first.

    State on both sides is bounded by the watermarks: a question is forgotten when no answer in time can still
    come, an answer that arrives after that meets nothing and is left out.
    """
    a, u = answers.withWatermark(ts, delay).alias("a"), questions.withWatermark(ts, delay).alias("u")
    return a.join(u, F.expr(f"{follows} AND a.{ts} >= u.{ts} AND a.{ts} <= u.{ts} + INTERVAL {within}"))


def stream_guard_counts(records: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Per tumbling window and stage: checks by result, and violations by type, in one stateful aggregate.

    ``records`` are log records of both stages. A row is exploded into one for its result and one for each violation
    before partial sums are made, so that a busy stage costs a few rows a task.
    """
    result = F.when(F.col("event_type").endswith("_blocked"), "blocked").when(F.col("event_type").endswith("_sanitized"), "sanitized").otherwise("passed")
    violations = F.transform(F.coalesce("violations", F.array().cast("array<string>")), lambda v: F.struct(F.lit("violation").alias("kind"), v.alias("value")))
    facts = F.concat(F.array(F.struct(F.lit("result").alias("kind"), result.alias("value"))), violations)
    counted = (
        records.withWatermark(ts, delay)
        .select(F.window(ts, window).alias("window"), "stage", F.explode(facts).alias("fact"))
        .groupBy("window", "stage", "fact")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(F.col("window.start").alias("window_start"), "stage", "fact.kind", "fact.value", "n")


def stream_latency_buckets(events: DataFrame, ts: str, value: str, bounds: Sequence[float], window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Cumulative latency buckets per tumbling window; quantiles are read off the finished windows."""
    v = F.col(value).cast("double")
    counted = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("window"))
        .agg(
            *[F.count_if(v <= float(b)).alias(f"_b{i}") for i, b in enumerate(bounds)],
            F.count(v).alias("_all"),
        )
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cum")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("cum")))
    return counted.select(F.col("window.start").alias("window_start"), F.explode(F.array(*rows)).alias("_r")).select(
        "window_start", "_r.le", "_r.cum"
    )


def stream_safety(events: DataFrame, stage: str = "stage", at: str = "at", blocked: str = "blocked", reset: str = "reset") -> DataFrame:
    """Sticky status per stage: 1 until a block, 0 until a reset, for events without a time and as long as the stream runs.

    The latest block and the latest reset are all the state there is, which makes the result independent of the order of
    arrival and leaves only partial maxima to shuffle. Stages are never forgotten; ``stream_safety_state`` forgets them.
    """
    last_block = F.max(F.when(F.col(blocked), F.col(at)))
    last_reset = F.max(F.when(F.col(reset), F.col(at)))
    agg = events.groupBy(F.col(stage).alias("stage")).agg(last_block.alias("_b"), last_reset.alias("_r"))
    bad = F.col("_b").isNotNull() & (F.col("_r").isNull() | (F.col("_b") > F.col("_r")))
    return agg.select("stage", F.when(bad, 0).otherwise(1).alias("status"))


STATUS = "stage string, status int, events long, recent array<long>, expired boolean"


class SafetyState(StatefulProcessor):
    """Per stage: the last block, the last reset, the number of events and the last few of them.

    Kept in the state store as three values and a list of at most ``size`` entries, whatever the number of events. A
    timer at ``retention`` after the newest event drops a stage that went quiet.
    """

    def __init__(self, size: int = 10, retention: int = 86_400) -> None:
        self.size, self.retention = size, retention

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "blocked long, reset long, newest long, events long")
        self.buffer = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows, timerValues):
        blocked, reset, newest, events = self.seen.get() if self.seen.exists() else (None, None, None, 0)
        ats = [a for (a,) in self.buffer.get()] if self.buffer.exists() else []
        before = newest
        for frame in rows:
            at = frame["at"].astype("int64")
            blocked = latest(blocked, at[frame["blocked"].fillna(False).astype(bool)])
            reset = latest(reset, at[frame["reset"].fillna(False).astype(bool)])
            newest = latest(newest, frame["millis"].dropna().astype("int64"))
            events += len(frame)
            ats = sorted([*ats, *at.nlargest(self.size).tolist()], reverse=True)[: self.size]
        self.seen.update((blocked, reset, newest, events))
        self.buffer.put([(a,) for a in ats])
        if newest is not None and newest != before:
            if before is not None:
                self.handle.deleteTimer(before + 1000 * self.retention)
            self.handle.registerTimer(newest + 1000 * self.retention)
        bad = blocked is not None and (reset is None or blocked > reset)
        yield self.row(key, 0 if bad else 1, events, ats, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        events = self.seen.get()[3]
        self.seen.clear()
        self.buffer.clear()
        yield self.row(key, None, events, [], True)

    def row(self, key, status, events, ats, expired) -> pd.DataFrame:
        return pd.DataFrame({"stage": [key[0]], "status": pd.array([status], "Int32"), "events": [events], "recent": [ats], "expired": [expired]})


def latest(known: int | None, new: pd.Series) -> int | None:
    return known if new.empty else int(new.max()) if known is None else max(known, int(new.max()))


def stream_safety_state(events: DataFrame, stage: str = "stage", at: str = "at", blocked: str = "blocked", reset: str = "reset", ts: str = "ts", delay: str = "10 minutes", size: int = 10, retention: int = 86_400) -> DataFrame:
    """Sticky status per stage, 1 until a block and 0 until a reset, with the last ``size`` events, newest first.

    The status is the last block against the last reset, so it does not depend on the order of arrival. State is
    bounded for each stage and forgotten ``retention`` seconds of event time after the stage's newest event; a row with ``expired``
    says so. Needs the RocksDB state store (``with_rocksdb``). NULL stages are left out.
    """
    rows = events.where(F.col(stage).isNotNull()).select(F.col(stage).alias("stage"), F.col(at).cast("long").alias("at"), F.col(blocked).alias("blocked"), F.col(reset).alias("reset"), F.col(ts).alias("ts"), F.unix_millis(ts).alias("millis"))
    keyed = rows.withWatermark("ts", delay).groupBy("stage")
    return keyed.transformWithStateInPandas(SafetyState(size, retention), STATUS, "Update", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which keyed state needs; the setting before is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_folder(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partitions: Sequence[str] = ()) -> None:
    """Process everything available, append to Parquet, and stop. Restarting continues from the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.trigger(availableNow=True).start().awaitTermination()


def run_updates_to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Update-mode results as a change table: every batch adds its changed rows under its own number, so
    that a repeated batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    # A batch without rows, so that a stream that never had any leaves an empty table.
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")
    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        save
    ).start().awaitTermination()


def latest_updates(stream: DataFrame, path: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The current row per key of a change table written by ``run_updates_to_folder`` for ``stream``."""
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    changes = stream.sparkSession.read.schema(schema).parquet(path)
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def append_arrivals(observations: DataFrame, raw_path: str, flat_path: str, checkpoint: str, keep: Sequence[str] = ()) -> None:
    """Arrivals to the raw and the flat table in one run; a repeated batch overwrites its own files."""

    def save(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").json(f"{raw_path}/batch={number}")
        batch.select(*keep, *flatten_observation()).write.mode("overwrite").parquet(f"{flat_path}/batch={number}")
        batch.unpersist()

    observations.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        save
    ).start().awaitTermination()


