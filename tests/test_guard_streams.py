"""Guard records, question–answer pairs and keyed safety state as streams."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from airframe import schemas
from airframe.operators import guards, ordered, telemetry
from airframe.streaming import streams

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def arrivals(spark, folder, batches, schema):
    """One file for each batch, read one file at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def second(n):
    return START + timedelta(seconds=n)


def test_answers_meet_their_question_within_the_time(spark, tmp_path):
    schema = "conv_id long, turn long, ts timestamp, text string"
    q = arrivals(spark, tmp_path / "q", [[(1, 0, second(0), "q1"), (2, 0, second(10), "q2")], [(3, 0, second(7200), "q3")], [(4, 0, second(7300), "q4")]], schema)
    a = arrivals(spark, tmp_path / "a", [[(1, 1, second(60), "in time")], [(3, 1, second(7210), "a3"), (2, 1, second(700), "out of time")], [(4, 3, second(7310), "not the next turn")], [(2, 1, second(20), "late")]], schema)
    pairs = streams.stream_pairs(a, q, "a.conv_id = u.conv_id AND a.turn = u.turn + 1")
    got, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    streams.run_to_folder(pairs.select("a.conv_id", F.col("a.text").alias("answer"), F.col("u.text").alias("question")), got, mark)
    assert sorted(spark.read.parquet(got).collect()) == [(1, "in time", "q1"), (3, "a3", "q3")]


def test_records_carry_a_digest_and_no_text(spark):
    verdicts = spark.createDataFrame([(START, "my card", False, ["pii", "pii"], ["a", "b"], "x"), (START, None, True, [], [], None)], "at timestamp, question string, passed boolean, violations array<string>, details array<string>, sanitized string")
    records = guards.event_record(guards.guard_event(verdicts, "input", sanitized="sanitized"), "at", "question")
    assert [(f.name, f.dataType) for f in records.schema] == [(f.name, f.dataType) for f in schemas.GUARD_EVENT]
    rows = records.collect()
    assert rows[0].details == "a; b" and len(rows[0].query_hash) == 64 and rows[1].query_hash is None and rows[1].event_type == "input_passed"
    assert "card" not in str(rows)


def test_counts_by_result_and_violation(spark, tmp_path):
    rows = [("input_blocked", second(1), "input", ["a", "b", "a"]), ("input_passed", second(2), "input", []), ("output_flagged", second(3), "output", ["c"]), ("input_sanitized", second(400), "input", None)]
    records = arrivals(spark, tmp_path / "r", [rows[:2], rows[2:]], "event_type string, ts timestamp, stage string, violations array<string>")
    changes = streams.stream_guard_counts(records)
    out = str(tmp_path / "out")
    streams.run_updates_to_folder(changes, out, str(tmp_path / "mark"))
    got = streams.latest_updates(changes, out, ["window_start", "stage", "kind", "value"], ["n"]).select(F.unix_seconds("window_start") - int(START.timestamp()), "stage", "kind", "value", "n")
    assert sorted(map(tuple, got.collect())) == [
        (0, "input", "result", "blocked", 1), (0, "input", "result", "passed", 1), (0, "input", "violation", "a", 2), (0, "input", "violation", "b", 1),
        (0, "output", "result", "passed", 1), (0, "output", "violation", "c", 1), (300, "input", "result", "sanitized", 1),
    ]


def safety(spark, tmp_path, batches, **kw):
    schema = "stage string, at long, blocked boolean, reset boolean, ts timestamp"
    events = arrivals(spark, tmp_path / "e", batches, schema)
    changes = streams.stream_safety_state(events, **kw)
    out = str(tmp_path / "out")
    with streams.with_rocksdb(spark):
        streams.run_updates_to_folder(changes, out, str(tmp_path / "mark"))
    return spark.read.parquet(out), streams.latest_updates(changes, out, ["stage"], ["status", "events", "recent", "expired"])


def test_keyed_state_equals_the_batch_query_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice([True, False, None]), rng.random() < 0.3, second(rng.randint(0, 500))) for i in range(400)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    _, now = safety(spark, tmp_path, [rows[:150], rows[150:160], rows[160:]], delay="1 hour")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    table = spark.createDataFrame([r for r in rows if r[0]], "stage string, at long, blocked boolean, reset boolean, ts timestamp")
    want = {r.stage: r.status for r in telemetry.safety_status(table, ts="at").collect()}
    last = ordered.recent(table, ["at"], 10, ["stage"]).groupBy("stage").agg(F.sort_array(F.collect_list("at"), False).alias("l")).collect()
    got = {r.stage: r for r in now.collect()}
    assert {s: r.status for s, r in got.items()} == want
    assert {s: r.recent for s, r in got.items()} == {r.stage: r.l for r in last}
    assert sum(r.events for r in got.values()) == table.count()


def test_a_quiet_stage_is_forgotten(spark, tmp_path):
    day = 86_400
    batches = [[("a", 1, True, False, second(0))], [("b", 2, False, False, second(3 * day))], [("b", 3, False, False, second(3 * day + 1))], [("a", 4, False, False, second(3 * day + 2))]]
    changes, now = safety(spark, tmp_path, batches, retention=day)
    assert [(r.stage, r.events) for r in changes.where("expired").collect()] == [("a", 1)]
    got = {r.stage: (r.status, r.events, r.recent) for r in now.collect()}
    assert got == {"a": (1, 1, [4]), "b": (1, 2, [3, 2])}  # the block of three days ago is gone
