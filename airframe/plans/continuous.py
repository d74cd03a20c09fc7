"""Streaming queries: each runs a stream over the table with everything available and returns its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe import schemas
from airframe.operators import guards, telemetry
from airframe.plans import base as B
from airframe.plans.base import EVENTS_SQL, READINGS_SQL, REQUESTS_SQL, R, TS, query
from airframe.plans.files import _STATION_SQL, _WITH_STATION, _observations, _per_station
from airframe.plans.texts import EVENTS_OF_GUARDS_SQL
from airframe.session import new_path
from airframe.sources import tables as io
from airframe.streaming import streams


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a file stream with the table's own schema."""
    schema = B.table(spark, sf, name).schema
    # A pattern, because the path of a stream itself must be a folder.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The request log as a stream, by the same rules as in batch."""
    ev = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        k.alias("k"),
        B._choice(F.pmod("user_id", F.lit(len(B.MODELS))), B.MODELS).alias("model"),
        (F.col("value") / 16.0).alias("latency_seconds"),
        ((k + 1) * 53).cast("long").alias("tokens"),
    )


@query("stream_readings", f"WITH {READINGS_SQL} {_STATION_SQL}")
def stream_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Nested files arrive; raw and flat tables are appended in one run."""
    arrivals, raw, flat, mark = (new_path(spark, n) for n in ("arrivals", "raw", "flat", "mark"))
    io.append_observations(_observations(spark, sf), arrivals)
    incoming = streams.table_stream(spark, arrivals, _WITH_STATION, "json")
    streams.append_arrivals(incoming, raw, flat, mark, keep=["station"])
    return _per_station(spark.read.parquet(flat))


@query(
    "stream_dedup",
    f"WITH {EVENTS_SQL} SELECT station, {TS('hr')} AS ts FROM ev GROUP BY station, hr",
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The same hour of a station reported by every event: one row per hour is let through."""
    ev = _stream(spark, sf, "events")
    hourly = ev.select(F.pmod("user_id", F.lit(B.STATIONS)).alias("station"), F.date_trunc("hour", "ts").alias("ts"))
    out, mark = new_path(spark, "hours"), new_path(spark, "mark")
    streams.run_to_folder(streams.stream_dedup(hourly, ["station"]), out, mark)
    return spark.read.parquet(out)


@query(
    "stream_rates",
    f"""WITH {REQUESTS_SQL}, s AS (SELECT model, tokens, date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS t0 FROM requests CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS i)),
    g AS (SELECT t0, model, CAST(sum(tokens) AS DOUBLE) AS inc FROM s GROUP BY t0, model)
    SELECT {TS('t0')} AS window_start, model, {R('inc')} AS increase, {R('inc / CAST(300 AS DOUBLE)')} AS rate FROM g""",
)
def stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = streams.stream_rates(_log(spark, sf), "ts", ["model"], F.col("tokens"))
    out, mark = new_path(spark, "rates"), new_path(spark, "mark")
    streams.run_updates_to_folder(rates, out, mark)
    return streams.latest_updates(rates, out, ["window_start", "model"], ["increase", "rate"])


_AT = "TIMESTAMP '2024-01-01' + to_seconds(CAST(300 * conv_id + turn AS INTEGER))"
RECORDS_SQL = f"""{EVENTS_OF_GUARDS_SQL}, records AS (SELECT e.*, {_AT.replace('conv_id', 'e.conv_id').replace('turn', 'e.turn')} AS ts, sha256(q.question) AS query_hash
  FROM gevents e JOIN questions q ON q.conv_id = e.conv_id AND q.turn = CASE WHEN e.stage = 'input' THEN e.turn ELSE e.turn - 1 END)"""


def _records(spark: SparkSession, turns: DataFrame, pair) -> DataFrame:
    """Log records of both stages from conversation turns, table or stream; five minutes for each conversation."""
    turns = turns.select("*", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 300 + F.col("turn")).alias("ts"))
    u, a = turns.filter(F.col("role") == "user"), turns.filter(F.col("role") == "assistant")
    questions = guards.input_guard(u.select("conv_id", "turn", "ts", B.asked().alias("question")), "question")
    asked = guards.event_record(guards.guard_event(questions, "input", sanitized="sanitized"), "ts", "question")
    both = pair(a, u).select(*B.answer_columns(), F.col("a.ts").alias("ts"), B.asked("u.").alias("question"))
    judged = guards.output_guard(both, "answer", "context", "sources", "claimed", "confidence")
    return asked.unionByName(guards.event_record(guards.guard_event(judged, "output"), "ts", "question"))


@query(
    "guard_event_log",
    f"""WITH {RECORDS_SQL} SELECT event_type, {TS('ts')} AS ts, stage, split_part(violations, '|', 1) AS rule_triggered, violations,
    replace(details, '|', '; ') AS details, {R('confidence_score')} AS confidence_score, query_hash FROM records""",
)
def guard_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Questions and answers arrive as two streams; every check of either is appended to one log."""
    log = spark.read.schema(schemas.GUARD_EVENT).parquet(_logged(spark, sf))
    return log.withColumn("violations", F.array_join("violations", "|"))


def _logged(spark: SparkSession, sf: str) -> str:
    """The folder of the log."""
    records = _records(spark, _stream(spark, sf, "conversations"), lambda a, u: streams.stream_pairs(a, u, B.FOLLOWS))
    out, mark = new_path(spark, "guard-log"), new_path(spark, "mark")
    streams.run_to_folder(records, out, mark)
    return out


@query(
    "stream_guard_counts",
    f"""WITH {RECORDS_SQL}, facts AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS t0, stage, 'result' AS kind, CASE WHEN NOT passed THEN 'blocked' WHEN sanitized THEN 'sanitized' ELSE 'passed' END AS value FROM records
    UNION ALL SELECT time_bucket(INTERVAL 5 MINUTE, ts), stage, 'violation', unnest(string_split(violations, '|')) FROM records WHERE violations <> '')
    SELECT {TS('t0')} AS window_start, stage, kind, value, count(*) AS n FROM facts GROUP BY 1, 2, 3, 4""",
)
def stream_guard_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The log of both stages, itself read as a stream, counted by result and by violation."""
    records = streams.table_stream(spark, _logged(spark, sf), schemas.GUARD_EVENT)
    out, mark = new_path(spark, "guards"), new_path(spark, "mark")
    changes = streams.stream_guard_counts(records)
    streams.run_updates_to_folder(changes, out, mark)
    return streams.latest_updates(changes, out, ["window_start", "stage", "kind", "value"], ["n"])


@query(
    "stream_safety",
    f"""WITH {EVENTS_SQL}, m AS (SELECT 'stage-' || CAST(user_id % 40 AS VARCHAR) AS stage, max(event_id) FILTER (WHERE event_type = 'error' AND k < 50) AS b, max(event_id) FILTER (WHERE event_type = 'signup' AND k < 50) AS r,
      count(*) AS events, list(event_id ORDER BY event_id DESC)[1:10] AS recent FROM ev GROUP BY 1)
    SELECT stage, CASE WHEN b IS NOT NULL AND (r IS NULL OR b > r) THEN 0 ELSE 1 END AS status, events, array_to_string(recent, ',') AS recent FROM m""",
)
def stream_safety(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed state: status, number of events and the last ten of each stage."""
    log = _log(spark, sf)
    ev = log.select(
        F.concat(F.lit("stage-"), (F.col("user_id") % 40).cast("string")).alias("stage"),
        "ts",
        F.col("event_id").alias("at"),
        ((F.col("event_type") == "error") & (F.col("k") < 50)).alias("blocked"),
        ((F.col("event_type") == "signup") & (F.col("k") < 50)).alias("reset"),
    )
    out, mark = new_path(spark, "safety"), new_path(spark, "mark")
    changes = streams.stream_safety_state(ev, retention=10 * 366 * 86_400)  # stages of the whole table are asked for
    with streams.with_rocksdb(spark):
        streams.run_updates_to_folder(changes, out, mark)
    now = streams.latest_updates(changes, out, ["stage"], ["status", "events", "recent"])
    return now.withColumn("recent", F.array_join(F.col("recent").cast("array<string>"), ","))


_BOUNDS = schemas.HISTOGRAM_BOUNDS["llm_request_duration_seconds"]


def _window_quantile_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT t0, CAST({float(b)} AS DOUBLE) AS le, count(*) FILTER (WHERE latency_seconds <= CAST({float(b)} AS DOUBLE)) AS cum FROM s GROUP BY t0" for b in _BOUNDS
    )
    return f"""WITH {REQUESTS_SQL}, s AS (SELECT latency_seconds, time_bucket(INTERVAL 5 MINUTE, ts) AS t0 FROM requests),
    b AS ({rows} UNION ALL SELECT t0, CAST('inf' AS DOUBLE), count(*) FROM s GROUP BY t0),
    n AS (SELECT t0, max(cum) AS n FROM b GROUP BY t0), q AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in (0.5, 0.9, 0.99))}]) AS q),
    hit AS (SELECT n.t0, q.q, q.q * n.n AS rank, min(b.le) AS le, min(b.cum) AS cum FROM n CROSS JOIN q JOIN b ON b.t0 = n.t0 AND b.cum >= q.q * n.n GROUP BY n.t0, q.q, n.n),
    low AS (SELECT h.t0, h.q, max(b.le) AS lo, max(b.cum) AS locum FROM hit h JOIN b ON b.t0 = h.t0 AND b.le < h.le GROUP BY h.t0, h.q)
    SELECT {TS('h.t0')} AS window_start, {R('h.q')} AS q, {R('CASE WHEN isinf(h.le) THEN coalesce(lo, 0) ELSE coalesce(lo, 0) + (h.le - coalesce(lo, 0)) * (h.rank - coalesce(locum, 0)) / (h.cum - coalesce(locum, 0)) END')} AS value
    FROM hit h LEFT JOIN low l ON l.t0 = h.t0 AND l.q = h.q"""


@query("stream_latency_quantiles", _window_quantile_sql())
def stream_latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Buckets per five minutes from the stream, quantiles from the finished table."""
    buckets = streams.stream_latency_buckets(_log(spark, sf), "ts", "latency_seconds", _BOUNDS)
    out, mark = new_path(spark, "latency"), new_path(spark, "mark")
    streams.run_updates_to_folder(buckets, out, mark)
    latest = streams.latest_updates(buckets, out, ["window_start", "le"], ["cum"])
    return telemetry.histogram_quantile(latest, [0.5, 0.9, 0.99], ["window_start"])
