"""Queries on distribution shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe.operators import drift, ordered, sketches
from airframe.plans import base as B
from airframe.plans.base import EVENTS_SQL, REQUESTS_SQL, R, query
from airframe.session import new_path

_SIDED = f"""{EVENTS_SQL}, sided AS (SELECT value, CAST(k AS DOUBLE) AS k, event_type, CAST(station AS VARCHAR) AS station,
  CASE WHEN row_number() OVER (ORDER BY ts, event_id) - 1 < floor(CAST(count(*) OVER () AS DOUBLE) * CAST(0.8 AS DOUBLE)) THEN 'reference' ELSE 'current' END AS side FROM ev)"""


def _sided(spark: SparkSession, sf: str) -> DataFrame:
    """Events, the first 80 % by time as reference and the rest as current."""
    ev = B.events(spark, sf).select("event_id", "ts", "value", "k", "event_type", F.col("station").cast("string").alias("station"))
    return ordered.positional_split(ev, [], ["ts", "event_id"])


def _ks_sql(src: str, column: str, name: str | None = None) -> str:
    """(column, statistic, p_value) of one column of a table with a side."""
    label = name or column
    return f"""SELECT '{label}' AS "column", d AS statistic, CASE WHEN lam < 0.2 THEN CAST(1 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 2 * series)) END AS p_value FROM (
  SELECT d, lam, (SELECT sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(CAST(-2 AS DOUBLE) * j * j * lam * lam)) FROM (SELECT unnest(generate_series(1, 20)) AS j)) AS series FROM (
    SELECT max(abs(fr - fc)) AS d, max(abs(fr - fc)) * sqrt(CAST(max(tr) AS DOUBLE) * max(tc) / (max(tr) + max(tc))) AS lam FROM (
      SELECT v, sum(r) OVER w / CAST(sum(r) OVER () AS DOUBLE) AS fr, sum(c) OVER w / CAST(sum(c) OVER () AS DOUBLE) AS fc, sum(r) OVER () AS tr, sum(c) OVER () AS tc
      FROM (SELECT {column} AS v, count(*) FILTER (WHERE side = 'reference') AS r, count(*) FILTER (WHERE side = 'current') AS c FROM {src} WHERE {column} IS NOT NULL GROUP BY 1)
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))"""


def _rounded(sql: str, columns: list[str]) -> str:
    return 'SELECT "column", ' + ", ".join(f"{R(c)} AS {c}" for c in columns) + f" FROM ({sql})"


@query("ks_statistic", f"WITH {_SIDED} " + " UNION ALL ".join(_rounded(_ks_sql("sided", c), ["statistic", "p_value"]) for c in ("value", "k")))
def ks_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return drift.ks_statistic(_sided(spark, sf), ["value", "k"])


def _wasserstein_sql(src: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", dist AS distance, dist / (SELECT stddev_pop({column}) FROM {src} WHERE side = 'reference') AS normalised FROM (
      SELECT sum(abs(fr - fc) * (nxt - v)) AS dist FROM (
        SELECT v, lead(v) OVER (ORDER BY v) AS nxt, sum(r) OVER w / CAST(sum(r) OVER () AS DOUBLE) AS fr, sum(c) OVER w / CAST(sum(c) OVER () AS DOUBLE) AS fc
        FROM (SELECT {column} AS v, count(*) FILTER (WHERE side = 'reference') AS r, count(*) FILTER (WHERE side = 'current') AS c FROM {src} WHERE {column} IS NOT NULL GROUP BY 1)
        WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


_W = " UNION ALL ".join(_wasserstein_sql("sided", c) for c in ("value", "k"))


@query("wasserstein", f"WITH {_SIDED} {_rounded(_W, ['distance', 'normalised'])}")
def wasserstein(spark: SparkSession, sf: str) -> DataFrame:
    return drift.wasserstein(_sided(spark, sf), ["value", "k"])


def _js_sql(src: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS categories, sqrt(greatest(CAST(0 AS DOUBLE), sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS distance FROM (
      SELECT r / CAST(sum(r) OVER () AS DOUBLE) AS p, c / CAST(sum(c) OVER () AS DOUBLE) AS q FROM (
        SELECT {column} AS v, count(*) FILTER (WHERE side = 'reference') AS r, count(*) FILTER (WHERE side = 'current') AS c FROM {src} GROUP BY 1))"""


@query("category_drift", f"WITH {_SIDED} " + " UNION ALL ".join(f'SELECT "column", categories, {R("distance")} AS distance FROM ({_js_sql("sided", c)})' for c in ("event_type", "station")))
def category_drift(spark: SparkSession, sf: str) -> DataFrame:
    return drift.category_drift(_sided(spark, sf), ["event_type", "station"])


@query(
    "dataset_drift",
    f"""WITH {_SIDED}, w AS ({_W}) SELECT count(*) AS "columns", count(*) FILTER (WHERE normalised >= 0.02) AS drifted,
    {R("count(*) FILTER (WHERE normalised >= 0.02) / CAST(count(*) AS DOUBLE)")} AS share, count(*) FILTER (WHERE normalised >= 0.02) / CAST(count(*) AS DOUBLE) >= 0.5 AS dataset_drift FROM w""",
)
def dataset_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A low threshold, as the two parts hardly differ."""
    return drift.dataset_drift(drift.wasserstein(_sided(spark, sf), ["value", "k"]), "normalised", 0.02)


_CORPUS = """texts AS (SELECT CAST(length(text) AS DOUBLE) AS char_count, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS DOUBLE) AS word_count,
  CASE WHEN lang = 'en' THEN 'reference' ELSE 'current' END AS side FROM documents)"""


@query("corpus_drift", f"WITH {_CORPUS} " + " UNION ALL ".join(_rounded(_ks_sql("texts", c), ["statistic", "p_value"]) for c in ("char_count", "word_count")))
def corpus_drift(spark: SparkSession, sf: str) -> DataFrame:
    """English texts against the others."""
    d = B.table(spark, sf, "documents").select("text", F.when(F.col("lang") == "en", "reference").otherwise("current").alias("side"))
    return drift.corpus_drift(d, "text")


@query("embedding_drift")
def embedding_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Principal components have no SQL twin; checked in the tests."""
    e = B.table(spark, sf, "embeddings").select("embedding", F.when(F.col("label") < 5, "reference").otherwise("current").alias("side"))
    return drift.embedding_drift(e, "embedding", 3)


_USAGE = f"""{REQUESTS_SQL}, usage AS (SELECT latency_seconds, CAST(tokens AS DOUBLE) AS tokens, confidence, event_type, model, CASE WHEN day(ts) <= 20 THEN 'reference' ELSE 'current' END AS side FROM requests)"""


@query(
    "usage_drift",
    f"WITH {_USAGE} "
    + " UNION ALL ".join(f'SELECT "column", \'ks\' AS method, {R("statistic")} AS score FROM ({_ks_sql("usage", c)})' for c in ("latency_seconds", "tokens", "confidence"))
    + " UNION ALL "
    + " UNION ALL ".join(f'SELECT "column", \'jensen_shannon\' AS method, {R("distance")} AS score FROM ({_js_sql("usage", c)})' for c in ("event_type", "model")),
)
def usage_drift(spark: SparkSession, sf: str) -> DataFrame:
    r = B.requests(spark, sf).withColumn("side", F.when(F.dayofmonth("ts") <= 20, "reference").otherwise("current"))
    return drift.usage_drift(r, ["latency_seconds", "tokens", "confidence"], ["event_type", "model"])


# ---------------------------------------------------------------- stored sketches

_SKETCHED = ["value", "k", "user_id"]


def _stored_sketches(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "sketches")
    sketches.store_day(B.events(spark, sf).withColumn("day", F.to_date("ts")), _SKETCHED, "day", path)
    return sketches.stored_days(spark, path)


def _sketch_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min, {R(f'max({c})')} AS max, true AS quartiles_hold, true AS distinct_holds FROM ev"""


@query("sketch_summary", f"WITH {EVENTS_SQL} " + " UNION ALL ".join(_sketch_sql(c) for c in _SKETCHED))
def sketch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of all days from their sketches; the ranks of its quartiles and its distinct counts are held against the rows."""
    told = sketches.summary(_stored_sketches(spark, sf))
    quarts = ["q25", "q50", "q75"]
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in _SKETCHED]))
    rows = B.events(spark, sf).select(values.alias("v")).select("v.*").join(F.broadcast(told.select("column", *quarts)), "column")  # one row per column name
    below = {q: (F.avg((F.col("x") < F.col(q)).cast("double")), F.avg((F.col("x") <= F.col(q)).cast("double"))) for q in quarts}
    room = sketches.RANK_ERROR + 1e-9
    holds = [(lo <= p + room) & (hi >= p - room) for p, (lo, hi) in zip((0.25, 0.5, 0.75), below.values(), strict=True)]
    seen = rows.groupBy("column").agg((holds[0] & holds[1] & holds[2]).alias("quartiles_hold"), F.count_distinct("x").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= sketches.DISTINCT_ERROR * F.col("exact") + 1
    return told.join(seen, "column").select("column", "count", "missing", "mean", "std", "min", "max", "quartiles_hold", near.alias("distinct_holds"))


_LAST_DAY = f"""{EVENTS_SQL}, dayed AS (SELECT *, CASE WHEN CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM ev) THEN 'current' ELSE 'reference' END AS side FROM ev)"""


@query(
    "sketch_drift",
    f"WITH {_LAST_DAY} "
    + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) FILTER (WHERE side = 'reference') AS reference_rows, count({c}) FILTER (WHERE side = 'current') AS current_rows, true AS holds FROM dayed""" for c in _SKETCHED),
)
def sketch_drift(spark: SparkSession, sf: str) -> DataFrame:
    """The newest day against all before it from stored sketches, held against the exact statistic."""
    days = _stored_sketches(spark, sf)
    last = days.agg(F.max("day")).first()[0]
    told = sketches.ks_between(days.where(F.col("day") != last), days.where(F.col("day") == last))
    ev = B.events(spark, sf).withColumn("side", F.when(F.to_date("ts") == F.lit(last), "current").otherwise("reference"))
    exact = drift.ks_statistic(ev.select("side", *[F.col(c).cast("double").alias(c) for c in _SKETCHED]), _SKETCHED).select("column", "statistic")
    holds = F.abs(F.col("ks") - F.col("statistic")) <= sketches.KS_ERROR
    return told.join(exact, "column").select("column", "reference_rows", "current_rows", holds.alias("holds"))
