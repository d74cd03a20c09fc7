"""Queries over texts: chunks, guards, retrieval, scores, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions import columns as C
from airframe.operators import airquality, chunking, guards, retrieval, scoring, tables, telemetry, textsim
from airframe.plans import base as B
from airframe.plans.base import ANSWERS_SQL, EXAMPLES_SQL, QUESTIONS_SQL, READINGS_SQL, R, query

# ---------------------------------------------------------------- chunks

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
CHUNKS_SQL = f"""d AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS t FROM documents),
win AS (
  SELECT doc_id, 0 AS s, 0 AS i, substring(t, 1, 500) AS w, length(t) AS n, t FROM d WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, s2, i + 1, substring(t, s2 + 1, 500), n, t FROM (
    SELECT doc_id, n, t, i, s + CASE WHEN s + 500 < n AND b > 250 THEN b + 1 ELSE 500 END - 50 AS s2 FROM (
      SELECT *, greatest(CASE WHEN contains(w, '. ') THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END,
                         CASE WHEN contains(w, chr(10)) THEN length(w) - instr(reverse(w), chr(10)) ELSE -1 END) AS b FROM win)) WHERE s2 < n),
cut AS (SELECT doc_id, i, CASE WHEN s + 500 < n AND b > 250 THEN substring(w, 1, CAST(b + 1 AS BIGINT)) ELSE w END AS c FROM (
  SELECT *, greatest(CASE WHEN contains(w, '. ') THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END,
                     CASE WHEN contains(w, chr(10)) THEN length(w) - instr(reverse(w), chr(10)) ELSE -1 END) AS b FROM win)),
pieces AS (SELECT doc_id, i, regexp_replace(regexp_replace(c, '^{_SPACE}+', ''), '{_SPACE}+$', '') AS chunk FROM cut),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, chunk
  FROM pieces WHERE chunk <> '')"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_table(B.texts(spark, sf, "documents").select("doc_id", "source", "text"))


@query("chunk_text", f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk FROM chunks")
def chunk_text(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "chunk_index", "chunk")


@query(
    "chunk_position",
    f"""WITH RECURSIVE {CHUNKS_SQL} SELECT 'doc_' || CAST(c.doc_id AS VARCHAR) || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id, d.source, CAST(chunk_index AS INTEGER) AS chunk_index,
    CAST(total_chunks AS INTEGER) AS total_chunks, CAST(length(chunk) AS INTEGER) AS n_chars FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""",
)
def chunk_position(spark: SparkSession, sf: str) -> DataFrame:
    """The id is (document, position), which needs no global numbering."""
    return _chunks(spark, sf).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "source",
        "chunk_index",
        "total_chunks",
        F.length("chunk").alias("n_chars"),
    )


@query("collection_stats", f"WITH RECURSIVE {CHUNKS_SQL} SELECT count(*) AS document_count, count(DISTINCT d.source) AS source_count FROM chunks c JOIN documents d ON d.doc_id = c.doc_id")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.collection_stats(_chunks(spark, sf))


@query("distinct_sources", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def distinct_sources(spark: SparkSession, sf: str) -> DataFrame:
    return tables.distinct_values(B.table(spark, sf, "documents"), "source")


# ---------------------------------------------------------------- input checks


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hit(text: str, pattern: str) -> str:
    """RE2 knows no look-ahead: the last topic rule becomes two tests on the first line."""
    if pattern.startswith("^(?!"):
        line = f"string_split({text}, chr(10))[1]"
        return f"(NOT regexp_matches({line}, {_q('(?i)(' + guards.ON_TOPIC_TERMS + ')')}) AND regexp_matches({line}, {_q(r'(?i)\b(' + guards.OFF_TOPIC_TERMS + r')\b')}))"
    return f"regexp_matches({text}, {_q('(?i)' + pattern)})"


def _joined(text: str, rules: list[tuple[str, str]]) -> str:
    """Labels of the matching (pattern, label) rules, joined by |."""
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {_hit(text, p)} THEN {_q(label)} END" for p, label in rules) + ")"


def _any(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(_hit(text, p) for p in patterns) + ")"


_PII_V = [(p, v) for v, p, _, _ in guards.PII]
_PII_D = [(p, d) for _, p, d, _ in guards.PII]


def _redacted(text: str) -> str:
    for _, pattern, _, mark in guards.PII:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(mark)}, 'gi')"
    return text


@query("pii_detect", f"SELECT doc_id, {_joined('text', _PII_V)} AS violations, {_joined('text', _PII_D)} AS details FROM documents")
def pii_detect(spark: SparkSession, sf: str) -> DataFrame:
    found = guards.pii_detect("text")
    return B.texts(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in found.items()])


@query("pii_redact", f"SELECT doc_id, md5({_redacted('text')}) AS redacted, {_redacted('text')} <> text AS changed FROM documents")
def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    red = B.texts(spark, sf, "documents").select("doc_id", "text", guards.pii_redact("text").alias("r"))
    return red.select("doc_id", F.md5("r").alias("redacted"), (F.col("r") != F.col("text")).alias("changed"))


@query("injection_detect", f"WITH {QUESTIONS_SQL} SELECT conv_id, turn, {_joined('question', guards.INJECTION)} AS details FROM questions")
def injection_detect(spark: SparkSession, sf: str) -> DataFrame:
    return B.questions(spark, sf).select("conv_id", "turn", guards.injection_detect("question").alias("details"))


@query("off_topic_detect", f"WITH {QUESTIONS_SQL} SELECT conv_id, turn, {_joined('question', guards.OFF_TOPIC)} AS details FROM questions")
def off_topic_detect(spark: SparkSession, sf: str) -> DataFrame:
    return B.questions(spark, sf).select("conv_id", "turn", guards.off_topic_detect("question").alias("details"))


_INJ = [p for p, _ in guards.INJECTION]
_TOP = [p for p, _ in guards.OFF_TOPIC]
INPUT_SQL = f"""{QUESTIONS_SQL},
flags AS (SELECT *, {_any('question', _INJ)} AS inj, {_any('question', [p for p, _ in _PII_V])} AS pii, {_any('question', _TOP)} AS top FROM questions),
verdicts AS (SELECT conv_id, turn, question, NOT (inj OR top) AS passed,
  CASE WHEN inj THEN {_joined('question', [(p, 'prompt_injection') for p in _INJ])}
       ELSE concat_ws('|', nullif({_joined('question', _PII_V)}, ''), nullif({_joined('question', [(p, 'topic_off_limits') for p in _TOP])}, '')) END AS violations,
  CASE WHEN inj THEN {_joined('question', guards.INJECTION)}
       ELSE concat_ws('|', nullif({_joined('question', _PII_D)}, ''), nullif({_joined('question', guards.OFF_TOPIC)}, '')) END AS details,
  CASE WHEN NOT inj AND NOT top AND pii THEN nullif({_redacted('question')}, question) END AS sanitized
  FROM flags)"""


@query("input_guard", f"WITH {INPUT_SQL} SELECT conv_id, turn, passed, violations, details, sanitized FROM verdicts")
def input_guard(spark: SparkSession, sf: str) -> DataFrame:
    return guards.input_guard(B.questions(spark, sf), "question").drop("question")


@query(
    "input_guard_blocking",
    f"""WITH {INPUT_SQL} SELECT v.conv_id, v.turn, NOT (f.inj OR f.pii OR f.top) AS passed,
    CASE WHEN f.inj THEN v.violations WHEN f.pii THEN {_joined('f.question', _PII_V)} ELSE {_joined('f.question', [(p, 'topic_off_limits') for p in _TOP])} END AS violations
    FROM verdicts v JOIN flags f ON f.conv_id = v.conv_id AND f.turn = v.turn""",
)
def input_guard_blocking(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data blocks instead of being redacted."""
    return guards.input_guard(B.questions(spark, sf), "question", sanitize=False).select("conv_id", "turn", "passed", "violations")


# ---------------------------------------------------------------- output checks

_TOX_V = [(p, v) for v, p, _ in guards.TOXICITY]
_TOX_D = [(p, d) for _, p, d in guards.TOXICITY]
_COUNT = "(" + " + ".join(f"CAST({_hit('answer', p)} AS INTEGER)" for p in guards.CLAIM_PHRASES) + ")"


@query("toxicity_detect", f"WITH {ANSWERS_SQL} SELECT conv_id, turn, {_joined('answer', _TOX_V)} AS violations, {_joined('answer', _TOX_D)} AS details FROM answers")
def toxicity_detect(spark: SparkSession, sf: str) -> DataFrame:
    return B.answers(spark, sf).select("conv_id", "turn", *[c.alias(n) for n, c in guards.toxicity_detect("answer").items()])


@query(
    "toxicity_confusion",
    f"""WITH t AS (SELECT l.toxic, {_any('d.text', [p for _, p, _ in guards.TOXICITY])} AS flagged FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT toxic, flagged, count(*) AS n FROM t GROUP BY toxic, flagged""",
)
def toxicity_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Flags against the labels."""
    d = B.texts(spark, sf, "documents").select("doc_id", (F.size(guards.toxicity_detect("text")["violations"]) > 0).alias("flagged"))
    return B.table(spark, sf, "labels").join(d, "doc_id").groupBy("toxic", "flagged").agg(F.count(F.lit(1)).alias("n"))


@query("indicator_count", f"WITH {ANSWERS_SQL} SELECT conv_id, turn, {_COUNT} AS n FROM answers")
def indicator_count(spark: SparkSession, sf: str) -> DataFrame:
    return B.answers(spark, sf).select("conv_id", "turn", guards.indicator_count("answer").alias("n"))


_FAB = r"""list_filter(claimed, lambda s: NOT list_bool_or(list_transform(list_concat(sources, list_transform(sources, lambda x: regexp_replace(x, '\.[^.]*$', ''))),
  lambda a: contains(lower(a), lower(trim(s))) OR contains(lower(trim(s)), lower(a)))))"""


@query("fabricated_sources", f"WITH {ANSWERS_SQL} SELECT conv_id, turn, array_to_string({_FAB}, '|') AS fabricated FROM answers")
def fabricated_sources(spark: SparkSession, sf: str) -> DataFrame:
    return B.answers(spark, sf).select("conv_id", "turn", guards.fabricated_sources("claimed", "sources").alias("fabricated"))


def _lacking(pattern: str, before: str, after: str) -> str:
    p = _q("(?i)" + pattern)
    return (
        f"list_transform(list_filter(regexp_extract_all(answer, {p}, 1), lambda x: NOT list_contains(regexp_extract_all(lower(context), {p}, 1), x)), "
        f"lambda x: {_q(before)} || x || {_q(after)})"
    )


_UNS = (
    "list_slice(list_concat("
    + _lacking(guards.PERCENT_FIGURE, "Statistic '", "%' not found in source context")
    + ", "
    + _lacking(guards.COUNT_FIGURE, "Numeric claim '", "' not found in source context")
    + "), 1, 3)"
)


@query("unsupported_claims", f"WITH {ANSWERS_SQL} SELECT conv_id, turn, array_to_string({_UNS}, '|') AS issues FROM answers")
def unsupported_claims(spark: SparkSession, sf: str) -> DataFrame:
    return B.answers(spark, sf).select("conv_id", "turn", guards.unsupported_claims("answer", "context").alias("issues"))


_DBL = lambda x: f"CAST({x} AS DOUBLE)"
GROUNDED_SQL = f"""{ANSWERS_SQL},
parts AS (SELECT *, {_FAB} AS fab, {_UNS} AS uns, {_COUNT} AS ind, lower(confidence) AS conf, {_any('answer', [p for _, p, _ in guards.TOXICITY])} AS toxic FROM answers),
scored AS (SELECT *, (len(fab) > 0 OR len(uns) > 0 OR conf = 'low' OR ind >= 3) AS any_violation,
  CASE WHEN len(fab) > 0 THEN {_DBL(0.5)} ELSE {_DBL(1)} END * CASE WHEN len(uns) > 0 THEN {_DBL(0.7)} ELSE {_DBL(1)} END
  * CASE conf WHEN 'low' THEN {_DBL(0.5)} WHEN 'medium' THEN {_DBL(0.8)} ELSE {_DBL(1)} END * CASE WHEN ind >= 2 THEN {_DBL(0.8)} ELSE {_DBL(1)} END AS product,
  concat_ws('|', CASE WHEN len(fab) > 0 THEN 'hallucination_fabricated_source' END, CASE WHEN len(uns) > 0 THEN 'hallucination_unsupported' END,
    CASE WHEN conf = 'low' THEN 'hallucination_low_confidence' END, CASE WHEN ind >= 3 THEN 'hallucination_unsupported' END) AS gv,
  concat_ws('|', CASE WHEN len(fab) > 0 THEN 'Referenced non-existent sources: [' || array_to_string(list_transform(fab, lambda f:
      CASE WHEN contains(f, '''') THEN '"' || f || '"' ELSE '''' || f || '''' END), ', ') || ']' END,
    CASE WHEN len(uns) > 0 THEN array_to_string(uns, '|') END, CASE WHEN conf = 'low' THEN 'Model reported low confidence in response' END,
    CASE WHEN ind >= 3 THEN 'Multiple unverified claim indicators (' || CAST(ind AS VARCHAR) || ')' END) AS gd FROM parts),
verdicts AS (SELECT conv_id, turn, any_violation, product, toxic, CASE WHEN any_violation THEN product ELSE {_DBL(1)} END AS score, gv, gd,
  NOT toxic AND (CASE WHEN any_violation THEN product ELSE {_DBL(1)} END) >= {_DBL(0.3)} AS passed,
  CASE WHEN toxic THEN {_joined('answer', _TOX_V)} ELSE gv END AS violations, CASE WHEN toxic THEN {_joined('answer', _TOX_D)} ELSE gd END AS details,
  CASE WHEN toxic THEN {_DBL(1)} WHEN any_violation THEN product ELSE {_DBL(1)} END AS confidence_score FROM scored)"""


@query("grounding_score", f"WITH {GROUNDED_SQL} SELECT conv_id, turn, gv AS g_violations, gd AS g_details, {R('score')} AS g_score FROM verdicts")
def grounding_score(spark: SparkSession, sf: str) -> DataFrame:
    g = guards.grounding_score(B.answers(spark, sf), "answer", "context", "sources", "claimed", "confidence")
    return g.select("conv_id", "turn", "g_violations", "g_details", "g_score")


def _output(spark: SparkSession, sf: str) -> DataFrame:
    return guards.output_guard(B.answers(spark, sf), "answer", "context", "sources", "claimed", "confidence")


@query("output_guard", f"WITH {GROUNDED_SQL} SELECT conv_id, turn, passed, violations, details, {R('confidence_score')} AS confidence_score FROM verdicts")
def output_guard(spark: SparkSession, sf: str) -> DataFrame:
    return _output(spark, sf).select("conv_id", "turn", "passed", "violations", "details", "confidence_score")


# ---------------------------------------------------------------- guard events

EVENTS_OF_GUARDS_SQL = f"""{INPUT_SQL.replace('verdicts AS', 'iv AS')}, {GROUNDED_SQL.replace('verdicts AS', 'ov AS')},
gevents AS (
  SELECT conv_id, turn, 'input' AS stage, CASE WHEN NOT passed THEN 'input_blocked' WHEN sanitized IS NOT NULL AND sanitized <> '' THEN 'input_sanitized' ELSE 'input_passed' END AS event_type,
    violations, details, CAST(NULL AS DOUBLE) AS confidence_score, passed, sanitized IS NOT NULL AS sanitized FROM iv
  UNION ALL
  SELECT conv_id, turn, 'output', CASE WHEN NOT passed THEN 'output_blocked' WHEN violations <> '' THEN 'output_flagged' ELSE 'output_passed' END,
    violations, details, confidence_score, passed, false FROM ov)"""


def guard_events(spark: SparkSession, sf: str) -> DataFrame:
    """The event log of both stages: one row per question and per answer."""
    q = guards.guard_event(guards.input_guard(B.questions(spark, sf), "question"), "input", sanitized="sanitized")
    a = guards.guard_event(_output(spark, sf), "output")
    shared = ["conv_id", "turn", "stage", "event_type", "rule_triggered", "rule", "event_details", "violations", "passed"]
    left = q.select(*shared, F.lit(None).cast("double").alias("confidence_score"), F.col("sanitized").isNotNull().alias("was_sanitized"))
    return left.unionByName(a.select(*shared, "confidence_score", F.lit(False).alias("was_sanitized")))


@query(
    "guard_event",
    f"""WITH {EVENTS_OF_GUARDS_SQL} SELECT conv_id, turn, stage, event_type, split_part(violations, '|', 1) AS rule_triggered,
    CASE WHEN violations = '' THEN 'none' ELSE split_part(violations, '|', 1) END AS rule, replace(details, '|', '; ') AS event_details, {R('confidence_score')} AS confidence_score FROM gevents""",
)
def guard_event(spark: SparkSession, sf: str) -> DataFrame:
    return guard_events(spark, sf).select("conv_id", "turn", "stage", "event_type", "rule_triggered", "rule", "event_details", "confidence_score")


@query(
    "guard_event_counts",
    f"""WITH {EVENTS_OF_GUARDS_SQL}, kinds(event_type) AS (VALUES {", ".join(f"('{t}')" for t in schemas.GUARD_EVENT_TYPES)}),
    seen AS (SELECT event_type, count(*) AS n FROM gevents GROUP BY event_type)
    SELECT k.event_type, coalesce(s.n, 0) AS n FROM kinds k LEFT JOIN seen s ON s.event_type = k.event_type""",
)
def guard_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.guard_event_counts(guard_events(spark, sf))


@query(
    "guard_event_stats",
    f"""WITH {EVENTS_OF_GUARDS_SQL} SELECT count(*) AS total_events, count(*) FILTER (WHERE NOT passed) AS total_blocked,
    {R("count(*) FILTER (WHERE NOT passed) / CAST(count(*) AS DOUBLE)")} AS block_rate FROM gevents""",
)
def guard_event_stats(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.guard_event_stats(guard_events(spark, sf))


@query(
    "violation_counts",
    f"""WITH {EVENTS_OF_GUARDS_SQL}, v AS (SELECT unnest(string_split(violations, '|')) AS violation FROM gevents WHERE violations <> '')
    SELECT violation, count(*) AS n FROM v GROUP BY violation""",
)
def violation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.violation_counts(guard_events(spark, sf))


@query(
    "guard_check_counts",
    f"""WITH {EVENTS_OF_GUARDS_SQL} SELECT stage, CASE WHEN NOT passed THEN 'blocked' WHEN sanitized THEN 'sanitized' ELSE 'passed' END AS result, count(*) AS n FROM gevents GROUP BY 1, 2""",
)
def guard_check_counts(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.guard_check_counts(guard_events(spark, sf), sanitized="was_sanitized")


@query(
    "safety_status",
    f"""WITH {EVENTS_OF_GUARDS_SQL}, t AS (SELECT stage || '-' || CAST(conv_id % 5 AS VARCHAR) AS stage, conv_id * 100 + turn AS ts, NOT passed AS blocked, (conv_id + turn) % 3 = 0 AS reset FROM gevents),
    m AS (SELECT stage, max(ts) FILTER (WHERE blocked) AS b, max(ts) FILTER (WHERE reset) AS r FROM t GROUP BY stage)
    SELECT stage, CASE WHEN b IS NOT NULL AND (r IS NULL OR b > r) THEN 0 ELSE 1 END AS status FROM m""",
)
def safety_status(spark: SparkSession, sf: str) -> DataFrame:
    """Stages split in five, with a reset at every third event."""
    g = guard_events(spark, sf).select(
        F.concat("stage", F.lit("-"), (F.col("conv_id") % 5).cast("string")).alias("stage"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
        (~F.col("passed")).alias("blocked"),
        ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("reset"),
    )
    return telemetry.safety_status(g)


# ---------------------------------------------------------------- prompts and answers

#: Short templates by strategy, with doubled braces where the prompt shows JSON.
TEMPLATES = {
    "zero_shot": 'Index {aqi_value} is "{aqi_category}". Reply as JSON {{"summary": "...", "precautions": []}}.',
    "few_shot_k3": 'Example: 35 Good {{"summary": "clean"}}. Now: {aqi_value} {aqi_category}.',
    "few_shot_k5": 'Examples {{{{nested}}}}. Now: {aqi_value} ({aqi_category}).',
    "chain_of_thought": "Think about {aqi_value}, that is {aqi_category}, step by step; {aqi_value} again. JSON at the end.",
    "meta_prompt": "# ROLE\nadvisor\n# INPUT\n{aqi_value}\n{aqi_category}\n# OUTPUT\n{{ }}",
}


def _template_sql() -> str:
    rows = ", ".join(f"('{n}', {_q(t)})" for n, t in TEMPLATES.items())
    return f"templates(name, content) AS (VALUES {rows})"


_RENDER = "replace(replace(replace(replace(content, '{{', chr(1)), '}}', chr(2)), '{aqi_value}', CAST(aqi AS VARCHAR)), '{aqi_category}', category)"


@query(
    "render_prompt",
    f"""WITH {READINGS_SQL}, {_template_sql()}, a AS (SELECT station, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {B.CALCULATED_SQL} AS aqi FROM readings),
    c AS (SELECT *, {B.category_sql('aqi')} AS category FROM a WHERE aqi IS NOT NULL)
    SELECT station, ts, name AS strategy, replace(replace({_RENDER}, chr(1), '{{'), chr(2), '}}') AS prompt FROM c CROSS JOIN templates""".replace("'{{'), chr(2), '}}')", "'{'), chr(2), '}')"),
)
def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    r = airquality.with_calculated_aqi(B.readings(spark, sf), "aqi").filter(F.col("aqi").isNotNull())
    crossed = scoring.strategy_cross(r.select("station", "ts", "aqi").withColumn("category", C.aqi_category("aqi")))
    texts = F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair])
    return crossed.select("station", "ts", "strategy", C.render_prompt(F.element_at(texts, F.col("strategy")), "aqi", "category").alias("prompt"))


@query(
    "parse_fenced_json",
    """SELECT conv_id, turn, turn % 8 = 7 AS parse_error, CASE WHEN turn % 8 <> 7 THEN text END AS answer,
      CASE WHEN turn % 8 = 7 THEN NULL WHEN turn % 8 = 1 THEN 'unknown' ELSE 'high' END AS confidence,
      CASE WHEN turn % 8 = 7 THEN NULL WHEN turn % 8 = 3 THEN 'a.txt|b.txt' ELSE '' END AS sources_used FROM conversations WHERE role = 'assistant'""",
)
def parse_fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    c = B.table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    kind = F.col("turn") % 8
    body = F.to_json(
        F.struct(
            F.col("text").alias("answer"),
            F.when(kind != 1, F.lit("high")).alias("confidence"),
            F.when(kind == 3, F.array(F.lit("a.txt"), F.lit("b.txt"))).alias("sources_used"),
        )
    )
    raw = (
        F.when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 3, F.concat(F.lit("```\n"), body, F.lit("```")))
        .when(kind == 7, F.concat(F.lit("```json\n"), F.col("text"), F.lit("{\n```")))
        .otherwise(F.concat(F.lit("  "), body, F.lit("\n")))
    )
    parsed = c.select("conv_id", "turn", C.parse_answer(raw).alias("p"))
    return parsed.select("conv_id", "turn", "p.parse_error", "p.answer", "p.confidence", "p.sources_used")


# ---------------------------------------------------------------- retrieval

_KNN_SQL = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
  FROM embeddings a CROSS JOIN embeddings b),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs)"""


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "embeddings")
    return retrieval.knn_topk(
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")),
        e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vector")),
    )


@query("knn_topk", f"WITH {_KNN_SQL} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, {R('distance')} AS distance FROM knn WHERE rank <= 3")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector against every vector, exactly."""
    return _knn(spark, sf)


@query(
    "format_context",
    f"""WITH {_KNN_SQL}, h AS (SELECT query_id, rank, coalesce(d.source, 'Unknown') AS source, coalesce(d.text, '') AS text FROM knn LEFT JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 3)
    SELECT query_id, md5(string_agg('[Source ' || CAST(rank AS VARCHAR) || ': ' || source || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM h GROUP BY query_id""",
)
def format_context(spark: SparkSession, sf: str) -> DataFrame:
    d = B.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")
    hits = _knn(spark, sf).join(d, "chunk_id", "left")
    return retrieval.format_context(hits, "query_id").select("query_id", F.md5("context").alias("context"))


@query(
    "cosine_similarity",
    f"""SELECT a.vec_id, {R('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_similarity(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", C.cosine_similarity("embedding", "other").alias("cosine"))


@query(
    "precaution_overlap",
    f"""WITH p AS (SELECT vec_id // 5 AS example, vec_id % 5 < 3 AS expected, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT e.example, e.vec_id, max(list_cosine_similarity(e.v, g.v)) AS best FROM p e JOIN p g ON g.example = e.example AND NOT g.expected WHERE e.expected GROUP BY e.example, e.vec_id)
    SELECT example, {R('avg(CASE WHEN best >= CAST(0.6 AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS overlap FROM s GROUP BY example""",
)
def precaution_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Five neighbouring vectors form an example: three expected, two generated."""
    e = B.table(spark, sf, "embeddings")
    n = F.col("vec_id") % 5
    grouped = e.groupBy(F.floor(F.col("vec_id") / 5).alias("example")).agg(
        F.collect_list(F.when(n < 3, F.col("embedding"))).alias("expected"), F.collect_list(F.when(n >= 3, F.col("embedding"))).alias("generated")
    )
    return grouped.select("example", scoring.precaution_overlap("generated", "expected", 0.6).alias("overlap"))


@query("rouge_l")
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer against its question, whole texts. Too slow in SQL; checked against a plain table in the tests."""
    return scoring.rouge_l(B.answers(spark, sf).select("conv_id", "turn", "raw_answer", "raw_question"), "raw_answer", "raw_question").select("conv_id", "turn", "rouge_l")


#: Real terms of both texts with their weights; ASCII letters and digits, as ROUGE-L takes them.
_TERMS = """w AS (SELECT conv_id, turn, unnest(['a', 'b']) AS side, unnest([raw_answer, raw_question]) AS t FROM answers),
    k AS (SELECT conv_id, turn, side, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM w),
    c AS (SELECT conv_id, turn, side, term, count(*) AS tf FROM k GROUP BY ALL),
    i AS (SELECT term, 1 + ln((2 * (SELECT count(*) FROM answers) + 1) / CAST(1 + count(*) AS DOUBLE)) AS w FROM c GROUP BY term),
    x AS (SELECT conv_id, turn, side, term, tf * w AS x FROM c JOIN i USING (term)),
    n AS (SELECT conv_id, turn, side, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
    d AS (SELECT a.conv_id, a.turn, sum(a.x * b.x) AS dot FROM x a JOIN x b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.term = b.term AND a.side = 'a' AND b.side = 'b' GROUP BY ALL)"""


@query(
    "text_cosine",
    f"""WITH {ANSWERS_SQL}, {_TERMS} SELECT s.conv_id, s.turn, {R('coalesce(dot / (p.norm * q.norm), 0)')} AS cosine FROM answers s LEFT JOIN d USING (conv_id, turn)
    LEFT JOIN n p ON p.conv_id = s.conv_id AND p.turn = s.turn AND p.side = 'a' LEFT JOIN n q ON q.conv_id = s.conv_id AND q.turn = s.turn AND q.side = 'b'""",
)
def text_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer against its question, over all their terms."""
    a = B.answers(spark, sf).select(F.struct("conv_id", "turn").alias("key"), "raw_answer", "raw_question")
    return textsim.text_cosine(a, "key", "raw_answer", "raw_question").select("key.*", "cosine")


@query(
    "similar_texts",
    """WITH k AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents
      UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM benchmark),
    c AS (SELECT side, id, term, count(*) AS tf FROM k GROUP BY ALL),
    i AS (SELECT term, 1 + ln(((SELECT count(*) FROM documents) + 1) / CAST(1 + count(*) FILTER (WHERE side = 'd') AS DOUBLE)) AS w FROM c GROUP BY term),
    x AS (SELECT side, id, term, tf * w AS x FROM c JOIN i USING (term)), n AS (SELECT side, id, sqrt(sum(x * x)) AS norm FROM x GROUP BY ALL),
    u AS (SELECT x.side, x.id, term, x / norm AS x FROM x JOIN n ON n.side = x.side AND n.id = x.id),
    m AS (SELECT q.id AS item_id, d.id AS doc_id, sum(q.x * d.x) AS cosine FROM u q JOIN u d ON d.term = q.term AND q.side = 'q' AND d.side = 'd' GROUP BY ALL)
    SELECT item_id, doc_id, """
    + R("cosine")
    + """ AS cosine FROM m WHERE cosine >= 0.3""",
)
def similar_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents about what a benchmark passage is about, by the inverted index."""
    return textsim.similar_texts(B.table(spark, sf, "benchmark"), B.table(spark, sf, "documents"), "item_id", "text", "doc_id", "text", 0.3)


# ---------------------------------------------------------------- evaluation

_STRATEGY_LIST = "[" + ", ".join(f"'{s}'" for s in schemas.STRATEGIES) + "]"
RESULTS_SQL = f"""{EXAMPLES_SQL}, crossed AS (SELECT *, unnest({_STRATEGY_LIST}) AS strategy FROM examples),
results AS (SELECT item_id, strategy, {B.noise_sql("'rouge'", "strategy", "item_id")} * CASE WHEN strategy = 'few_shot_k3' THEN 0.3 ELSE 1.0 END AS rouge_l,
  {B.noise_sql("'cos'", "strategy", "item_id")} AS cosine_similarity, {B.noise_sql("'ov'", "strategy", "item_id")} AS precaution_overlap,
  {B.noise_sql("'lat'", "strategy", "item_id")} * 10 AS latency_seconds,
  CASE WHEN strategy = 'meta_prompt' OR {B.noise_sql("'err'", "strategy", "item_id")} < 0.2 THEN 'Failed to parse JSON' END AS error FROM crossed)"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Scored results per strategy and example; one strategy always fails, one scores low."""
    crossed = scoring.strategy_cross(B.eval_examples(spark, sf).select("item_id"))
    noise = lambda tag: C.unit_noise(F.lit(tag), "strategy", "item_id")
    return crossed.select(
        "item_id",
        "strategy",
        (noise("rouge") * F.when(F.col("strategy") == "few_shot_k3", 0.3).otherwise(1.0)).alias("rouge_l"),
        noise("cos").alias("cosine_similarity"),
        noise("ov").alias("precaution_overlap"),
        (noise("lat") * 10).alias("latency_seconds"),
        F.when((F.col("strategy") == "meta_prompt") | (noise("err") < 0.2), "Failed to parse JSON").alias("error"),
    )


@query("strategy_cross", f"WITH {EXAMPLES_SQL} SELECT item_id, {R('aqi')} AS aqi, unnest({_STRATEGY_LIST}) AS strategy FROM examples")
def strategy_cross(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.strategy_cross(B.eval_examples(spark, sf).select("item_id", "aqi"))


_BY = f"""{RESULTS_SQL}, m AS (SELECT strategy, avg(rouge_l) FILTER (WHERE error IS NULL) AS avg_rouge_l, avg(cosine_similarity) FILTER (WHERE error IS NULL) AS avg_cosine_similarity,
  avg(precaution_overlap) FILTER (WHERE error IS NULL) AS avg_precaution_overlap, avg(latency_seconds) FILTER (WHERE error IS NULL) AS avg_latency,
  stddev_pop(rouge_l) FILTER (WHERE error IS NULL) AS std_rouge_l, stddev_pop(cosine_similarity) FILTER (WHERE error IS NULL) AS std_cosine_similarity,
  count(*) AS num_examples, count(*) FILTER (WHERE error IS NULL) AS num_successful, count(*) FILTER (WHERE error IS NOT NULL) / CAST(count(*) AS DOUBLE) AS error_rate,
  CASE WHEN count(*) FILTER (WHERE error IS NULL) = 0 THEN 'All examples failed' END AS error FROM results GROUP BY strategy)"""
_M = ["avg_rouge_l", "avg_cosine_similarity", "avg_precaution_overlap", "avg_latency", "std_rouge_l", "std_cosine_similarity", "error_rate"]


@query("eval_by_strategy", f"WITH {_BY} SELECT strategy, {', '.join(f'{R(c)} AS {c}' for c in _M)}, num_examples, num_successful, error FROM m")
def eval_by_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.eval_by_strategy(_results(spark, sf))


def _gate_checks() -> str:
    names = {"rouge_l": "ROUGE-L", "cosine_similarity": "Cosine", "precaution_overlap": "Overlap"}
    arms = [
        f"CASE WHEN coalesce(avg_{s}, 0) < {limit} THEN printf('{names[s]} %.2f < {limit}', CAST(coalesce(avg_{s}, 0) AS DOUBLE)) END"
        for s, limit in schemas.GATE_MINIMUMS.items()
    ]
    arms.append(f"CASE WHEN error_rate > {schemas.GATE_MAX_ERROR_RATE} THEN printf('Error rate %.2f > {schemas.GATE_MAX_ERROR_RATE}', error_rate) END")
    return f"concat_ws('; ', {', '.join(arms)})"


@query("quality_gate", f"WITH {_BY}, g AS (SELECT strategy, {_gate_checks()} AS failed_checks FROM m) SELECT strategy, failed_checks = '' AS passed, failed_checks FROM g")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.quality_gate(scoring.eval_by_strategy(_results(spark, sf))).select("strategy", "passed", "failed_checks")


@query("gate_summary", f"WITH {_BY}, g AS (SELECT {_gate_checks()} AS f FROM m) SELECT count(*) FILTER (WHERE f = '') AS passed, count(*) AS strategies FROM g")
def gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.gate_summary(scoring.quality_gate(scoring.eval_by_strategy(_results(spark, sf))))


@query("category_distribution", f"WITH {EXAMPLES_SQL} SELECT coalesce(category, 'Unknown') AS category, count(*) AS n FROM examples GROUP BY 1")
def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return tables.category_counts(B.eval_examples(spark, sf), "category")


_CATS = "(" + ", ".join(f"'{n}'" for _, n in schemas.CATEGORY_BOUNDS) + ")"
ISSUES_SQL = f"""{EXAMPLES_SQL}, issues AS (
  SELECT item_id, 0 AS "order", 'Example ' || item_id || ': missing ''aqi''' AS issue FROM examples WHERE aqi IS NULL
  UNION ALL SELECT item_id, 1, 'Example ' || item_id || ': missing ''category''' FROM examples WHERE category IS NULL
  UNION ALL SELECT item_id, 2, 'Example ' || item_id || ': missing ''expected_summary''' FROM examples WHERE expected_summary IS NULL
  UNION ALL SELECT item_id, 4, 'Example ' || item_id || ': invalid AQI value ' || CAST(aqi AS VARCHAR) FROM examples WHERE NOT aqi BETWEEN 0 AND 500
  UNION ALL SELECT item_id, 5, 'Example ' || item_id || ': invalid category ''' || category || '''' FROM examples WHERE category NOT IN {_CATS})"""


@query("eval_set_issues", f'WITH {ISSUES_SQL} SELECT item_id, "order", issue FROM issues')
def eval_set_issues(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.eval_set_issues(B.eval_examples(spark, sf), "item_id")


@query("eval_set_checks", f"WITH {ISSUES_SQL} SELECT (SELECT count(*) FROM examples) AS examples, count(*) AS issues, count(*) = 0 AND (SELECT count(*) FROM examples) >= 5 AS valid FROM issues")
def eval_set_checks(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.eval_set_checks(B.eval_examples(spark, sf), "item_id")


@query("first_issues", f'WITH {ISSUES_SQL} SELECT item_id, "order", issue, greatest((SELECT count(*) FROM issues) - 5, 0) AS more FROM issues ORDER BY item_id, "order" LIMIT 5')
def first_issues(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.first_issues(scoring.eval_set_issues(B.eval_examples(spark, sf), "item_id"), ["item_id", "order"])


_NAMED = "[" + ", ".join(f"'{s}'" for s in [*schemas.STRATEGIES[:4], "unused"]) + "]"
_TPL_SQL = f"""named AS (SELECT {_NAMED}[CAST(item_id % 5 AS INTEGER) + 1] AS name, item_id, text FROM benchmark),
tpl AS (SELECT name, CASE name WHEN 'zero_shot' THEN arg_min(text, item_id) || ' Reply in JSON about {{aqi_value}}.' WHEN 'few_shot_k3' THEN 'AQI as json' ELSE arg_min(text, item_id) END AS content FROM named GROUP BY name)"""


@query(
    "template_checks",
    (
        f"WITH {_TPL_SQL}, need AS (SELECT unnest({_STRATEGY_LIST}) AS name) SELECT n.name, content IS NOT NULL AS present, coalesce(length(content) >= 50, false) AS long_enough, "
        "coalesce(contains(lower(content), 'json'), false) AS mentions_json, coalesce(contains(lower(content), 'aqi'), false) AS mentions_aqi, "
        "content IS NOT NULL AND length(content) >= 50 AS valid FROM need n LEFT JOIN tpl t ON t.name = n.name"
    ).replace("{{aqi_value}}", "{aqi_value}"),
)
def template_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Templates made of benchmark passages; one is missing and one too short."""
    b = B.table(spark, sf, "benchmark")
    names = F.array(*[F.lit(s) for s in [*schemas.STRATEGIES[:4], "unused"]])
    named = b.groupBy(F.element_at(names, (F.col("item_id") % 5 + 1).cast("int")).alias("name")).agg(F.min_by("text", "item_id").alias("content"))
    content = (
        F.when(F.col("name") == "zero_shot", F.concat("content", F.lit(" Reply in JSON about {aqi_value}.")))
        .when(F.col("name") == "few_shot_k3", F.lit("AQI as json"))
        .otherwise(F.col("content"))
    )
    return scoring.template_checks(named.withColumn("content", content))
