"""Queries over the request log, metric samples and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions import columns as C
from airframe.operators import crossval, models, ordered, telemetry
from airframe.plans import base as B
from airframe.plans.base import COSTS_SQL, COUNTERS_SQL, REQUESTS_SQL, SAMPLES_SQL, R, TS, query

# ---------------------------------------------------------------- cost and usage


@query(
    "token_cost",
    f"WITH {COSTS_SQL} SELECT event_id, model, input_tokens, output_tokens, {R('cost_usd * 1000')} AS cost_milli FROM costs",
)
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    c = telemetry.with_cost(B.requests(spark, sf))
    return c.select("event_id", "model", "input_tokens", "output_tokens", (F.col("cost_usd") * 1000).alias("cost_milli"))


@query("price_lookup", f"WITH {COSTS_SQL} SELECT event_id, model, {R('price_in')} AS price_in, {R('price_out')} AS price_out FROM priced")
def price_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.price_lookup(B.requests(spark, sf)).select("event_id", "model", "price_in", "price_out")


@query(
    "duration_ms",
    f"WITH {REQUESTS_SQL} SELECT event_id, {R('round_even(latency_seconds * CAST(1000 AS DOUBLE) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)')} AS duration_ms FROM requests",
)
def duration_ms(spark: SparkSession, sf: str) -> DataFrame:
    return B.requests(spark, sf).select("event_id", C.duration_ms("latency_seconds").alias("duration_ms"))


@query(
    "usage_by_model",
    f"""WITH {COSTS_SQL} SELECT model, endpoint, status, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(tokens) AS BIGINT) AS total_tokens, {R('sum(cost_usd)')} AS cost_usd,
    {R('count(*) / CAST((SELECT count(*) FROM costs) AS DOUBLE)')} AS share FROM costs GROUP BY model, endpoint, status""",
)
def usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.usage_by_model(telemetry.with_cost(B.requests(spark, sf)))


@query(
    "usage_totals",
    f"""WITH {COSTS_SQL} SELECT count(*) AS requests_total, CAST(sum(input_tokens) AS BIGINT) AS tokens_input, CAST(sum(output_tokens) AS BIGINT) AS tokens_output,
    {R('sum(cost_usd)')} AS cost_total_usd, {R('avg(latency_seconds)')} AS average_latency_seconds FROM costs""",
)
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.usage_totals(telemetry.with_cost(B.requests(spark, sf)))


_STATUS_SQL = """CASE WHEN k = 99 THEN 'error' WHEN event_type = 'signup' AND k < 20 THEN 'blocked_input' WHEN documents = 0 THEN 'no_documents'
  WHEN event_type = 'error' THEN 'generation_error' WHEN confidence < CAST(0.3 AS DOUBLE) THEN 'blocked_output' ELSE 'success' END"""


@query("query_status_counts", f"WITH {REQUESTS_SQL}, s AS (SELECT {_STATUS_SQL} AS status FROM requests) SELECT status, count(*) AS n FROM s GROUP BY status")
def query_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = B.requests(spark, sf)
    status = telemetry.query_status(
        input_passed=~((F.col("event_type") == "signup") & (F.col("k") < 20)),
        documents="documents",
        generated=F.col("event_type") != "error",
        output_passed=F.col("confidence") >= 0.3,
        failed=F.col("k") == 99,
    )
    return telemetry.status_counts(r.withColumn("status", status))


# ---------------------------------------------------------------- histograms


def _hist_sql(src: str, value: str, bounds, labels: list[str]) -> str:
    cols = "".join(f"{c}, " for c in labels)
    group = f" GROUP BY {', '.join(labels)}" if labels else ""
    rows = [
        f"SELECT {cols}CAST({float(b)} AS DOUBLE) AS le, count(*) FILTER (WHERE {value} <= CAST({float(b)} AS DOUBLE)) AS cum, sum({value}) AS sum, count({value}) AS count FROM {src}{group}"
        for b in bounds
    ]
    rows.append(f"SELECT {cols}CAST('inf' AS DOUBLE) AS le, count({value}) AS cum, sum({value}) AS sum, count({value}) AS count FROM {src}{group}")
    return " UNION ALL ".join(rows)


_METRICS = {
    "llm_request_duration_seconds": ("latency_seconds", ["model"]),
    "llm_tokens_per_request": ("CAST(tokens AS DOUBLE)", ["model"]),
    "llm_cost_per_request_usd": ("cost_usd", ["model"]),
    "llm_guardrail_duration_seconds": ("guard_seconds", []),
    "rag_retrieval_duration_seconds": ("retrieval_seconds", []),
    "rag_documents_retrieved": ("CAST(documents AS DOUBLE)", []),
    "rag_generation_duration_seconds": ("generation_seconds", []),
    "llm_response_confidence": ("confidence", ["model"]),
}


def _all_hist_sql() -> str:
    out = []
    for i, (name, (value, labels)) in enumerate(_METRICS.items()):
        shown = "model" if labels else "'' AS model"
        out.append(
            f"SELECT '{name}' AS metric, {shown}, CAST(le AS VARCHAR) AS le, cum, {R('sum')} AS sum, count FROM ("
            f"{_hist_sql('costs', value, schemas.HISTOGRAM_BOUNDS[name], labels)}) h{i}"
        )
    return f"WITH {COSTS_SQL} " + " UNION ALL ".join(out)


def _histograms(spark: SparkSession, sf: str) -> DataFrame:
    """All eight histograms from one pass over the log; those without a label are summed afterwards."""
    costs = telemetry.with_cost(B.requests(spark, sf))
    metrics = {name: (value, schemas.HISTOGRAM_BOUNDS[name]) for name, (value, _) in _METRICS.items()}
    labelled = telemetry.bucket_histograms(costs, metrics, ["model"])
    plain = [n for n, (_, labels) in _METRICS.items() if not labels]
    return labelled.filter(~F.col("metric").isin(plain)).unionByName(
        telemetry.without_labels(labelled, plain).withColumn("model", F.lit(""))
    )


@query("bucket_histogram", _all_hist_sql().replace("CAST(le AS VARCHAR) AS le", "CASE WHEN isinf(le) THEN -1 ELSE le END AS le"))
def bucket_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """The open bucket is shown as -1."""
    return _histograms(spark, sf).withColumn("le", F.when(F.col("le") == float("inf"), F.lit(-1.0)).otherwise(F.col("le")))


_Q = [0.5, 0.9, 0.99]
_QUANTILE_SQL = f"""WITH {COSTS_SQL},
b AS ({_hist_sql('costs', 'latency_seconds', schemas.HISTOGRAM_BOUNDS['llm_request_duration_seconds'], ['model'])}),
q AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in _Q)}]) AS q),
n AS (SELECT model, max(cum) AS n FROM b GROUP BY model),
hit AS (SELECT n.model, q.q, q.q * n.n AS rank, min(b.le) AS le FROM n CROSS JOIN q JOIN b ON b.model = n.model AND b.cum >= q.q * n.n GROUP BY n.model, q.q, n.n),
parts AS (SELECT h.model, h.q, h.rank, h.le, (SELECT cum FROM b WHERE b.model = h.model AND b.le = h.le) AS cum,
  coalesce((SELECT max(le) FROM b WHERE b.model = h.model AND b.le < h.le), 0) AS lo,
  coalesce((SELECT max(cum) FROM b WHERE b.model = h.model AND b.le < h.le), 0) AS locum FROM hit h)
SELECT model, {R('q')} AS q, {R('CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - locum) / (cum - locum) END')} AS value FROM parts"""


@query("histogram_quantile", _QUANTILE_SQL)
def histogram_quantile(spark: SparkSession, sf: str) -> DataFrame:
    bounds = schemas.HISTOGRAM_BOUNDS["llm_request_duration_seconds"]
    h = telemetry.bucket_histogram(B.requests(spark, sf), "latency_seconds", bounds, ["model"])
    return telemetry.histogram_quantile(h, _Q, ["model"])


@query("mean_response", f"WITH {REQUESTS_SQL} SELECT model, {R('avg(latency_seconds)')} AS mean FROM requests GROUP BY model")
def mean_response(spark: SparkSession, sf: str) -> DataFrame:
    bounds = schemas.HISTOGRAM_BOUNDS["llm_request_duration_seconds"]
    return telemetry.mean_response(telemetry.bucket_histogram(B.requests(spark, sf), "latency_seconds", bounds, ["model"]), ["model"])


# ---------------------------------------------------------------- samples and counters


@query(
    "metric_keep",
    f"WITH {SAMPLES_SQL} SELECT event_id, name, 'host-machine' AS instance FROM samples WHERE regexp_full_match(name, '(llm_.*|rag_.*|guardrail_.*)')",
)
def metric_keep(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.metric_keep(B.samples(spark, sf)).select("event_id", "name", "instance")


@query(
    "sum_by_label",
    f"""WITH {SAMPLES_SQL}, l AS (SELECT name, label, instance, arg_max(dv, ts) AS dv FROM samples GROUP BY name, label, instance)
    SELECT name, label, {R('sum(dv)')} AS total FROM l GROUP BY name, label""",
)
def sum_by_label(spark: SparkSession, sf: str) -> DataFrame:
    out = telemetry.sum_by_label(B.samples(spark, sf), ["name", "label", "instance"], ["name", "label"], value="dv")
    return out.withColumn("total", F.col("total").cast("double"))


_RATE_SQL = f"""WITH {COUNTERS_SQL},
lagged AS (SELECT *, lag(value) OVER s AS pv, lag(ts) OVER s AS pt FROM counters WINDOW s AS (PARTITION BY user_id, event_type ORDER BY ts)),
steps AS (SELECT *, CASE WHEN pv IS NOT NULL THEN CASE WHEN value < pv THEN value ELSE value - pv END END AS delta FROM lagged),
w AS (SELECT *, min(ts) OVER r AS t0, sum(delta) OVER r AS total, first_value(delta) OVER r AS d0,
  epoch_us(ts) AS us, epoch_us(pt) AS pus FROM steps
  WINDOW r AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN t0 < ts THEN total - coalesce(d0, 0) END AS inc, (us - epoch_us(t0)) / CAST(1000000 AS DOUBLE) AS el,
  CASE WHEN pus >= us - 86400000000 THEN delta / nullif((us - pus) / CAST(1000000 AS DOUBLE), 0) END AS ir FROM w)
SELECT event_id, {R('delta')} AS delta, {R('inc')} AS increase, {R('inc / nullif(el, 0) * 3600')} AS per_hour, {R('ir * 3600')} AS instant_per_hour FROM f"""


@query("counter_rate", _RATE_SQL)
def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    """The counters are sampled rarely, so the trailing window is a day."""
    rates = ordered.counter_rate(B.counters(spark, sf), ["user_id", "event_type"], "ts", "value", window_seconds=86_400, bucket_seconds=7 * 86_400)
    return rates.select(
        "event_id", "delta", "increase", (F.col("rate") * 3600).alias("per_hour"), (F.col("irate") * 3600).alias("instant_per_hour")
    )


_CPU_SQL = f"""WITH {COUNTERS_SQL},
lagged AS (SELECT *, lag(value) OVER s AS pv, lag(ts) OVER s AS pt FROM counters WINDOW s AS (PARTITION BY user_id, event_type ORDER BY ts)),
r AS (SELECT user_id, event_type, ts, CASE WHEN epoch_us(pt) >= epoch_us(ts) - 86400000000 THEN
   (CASE WHEN value < pv THEN value ELSE value - pv END) / nullif((epoch_us(ts) - epoch_us(pt)) / CAST(1000000 AS DOUBLE), 0) END AS ir FROM lagged),
l AS (SELECT user_id, event_type, arg_max(ir, ts) FILTER (WHERE ir IS NOT NULL) AS ir FROM r GROUP BY user_id, event_type)
SELECT 'host-' || CAST(user_id % 8 AS VARCHAR) AS instance, {R('100 - avg(ir) * 100')} AS cpu_percent FROM l GROUP BY user_id % 8"""


@query("cpu_percent", _CPU_SQL)
def cpu_percent(spark: SparkSession, sf: str) -> DataFrame:
    c = B.counters(spark, sf).withColumn("instance", F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")))
    return telemetry.cpu_percent(c, ["instance", "user_id", "event_type"], "instance", window_seconds=86_400, bucket_seconds=7 * 86_400)


@query(
    "resource_percent",
    f"""WITH {SAMPLES_SQL}, l AS (SELECT instance, arg_max(value, ts) FILTER (WHERE name = 'llm_requests_total') AS a,
      arg_max(value, ts) FILTER (WHERE name = 'rag_queries_total') AS t FROM samples GROUP BY instance)
    SELECT instance, {R('(1 - a / t) * 100')} AS used_percent FROM l""",
)
def resource_percent(spark: SparkSession, sf: str) -> DataFrame:
    """Memory and disk share this form: (1 - available / total) · 100 of two gauges."""
    return telemetry.used_percent(B.samples(spark, sf), "instance", "name", "llm_requests_total", "rag_queries_total")


@query("recent_events", f"SELECT event_id, {TS('ts')} AS ts, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)")
def recent_events(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.recent(B.table(spark, sf, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 10)


@query(
    "recent_events_by_type",
    f"SELECT event_id, {TS('ts')} AS ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10",
)
def recent_events_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.recent(B.table(spark, sf, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"], 10, ["event_type"])


@query(
    "windowed_rate",
    f"""WITH {REQUESTS_SQL}, s AS (SELECT model, tokens, date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS t0 FROM requests CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS i)),
    g AS (SELECT t0, model, CAST(sum(tokens) AS DOUBLE) AS inc FROM s GROUP BY t0, model)
    SELECT {TS('t0')} AS window_start, {TS("t0 + INTERVAL 5 MINUTE")} AS window_end, model, {R('inc')} AS increase, {R('inc / CAST(300 AS DOUBLE)')} AS rate FROM g""",
)
def windowed_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Five-minute windows every minute: tokens and tokens per second by model."""
    return telemetry.windowed_rate(B.requests(spark, sf), "ts", ["model"], F.col("tokens"))


_INDICATORS = {
    "p95_latency_seconds": "quantile_cont(latency_seconds, 0.95)",
    "error_rate": "avg(CASE WHEN status = 'error' THEN 1.0 ELSE 0.0 END)",
    "violation_rate": "avg(CASE WHEN k < 7 THEN 1.0 ELSE 0.0 END)",
    "avg_confidence": "avg(confidence)",
    "hourly_cost_usd": "sum(cost_usd) / 720",
    "dataset_drift": "avg(CASE WHEN k > 74 THEN 1.0 ELSE 0.0 END)",
}


def _alert_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS indicator, CAST({e} AS DOUBLE) AS value FROM costs" for n, e in _INDICATORS.items())
    limits = ", ".join(f"('{n}', CAST({w} AS DOUBLE), CAST({c} AS DOUBLE), '{d}')" for n, w, c, d in schemas.ALERT_LIMITS)
    return f"""WITH {COSTS_SQL}, v AS ({rows}), limits(indicator, warning, critical, direction) AS (VALUES {limits})
    SELECT indicator, {R('value')} AS value, {R('warning')} AS warning, {R('critical')} AS critical, direction,
      CASE WHEN direction = 'above' THEN CASE WHEN value > critical THEN 'critical' WHEN value > warning THEN 'warning' ELSE 'ok' END
           ELSE CASE WHEN value < critical THEN 'critical' WHEN value < warning THEN 'warning' ELSE 'ok' END END AS level
    FROM v JOIN limits USING (indicator)"""


@query("alert_levels", _alert_sql())
def alert_levels(spark: SparkSession, sf: str) -> DataFrame:
    from airframe.operators.quantiles import exact_quantiles

    c = telemetry.with_cost(B.requests(spark, sf))
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    one = c.agg(
        share(F.col("status") == "error").alias("error_rate"),
        share(F.col("k") < 7).alias("violation_rate"),
        F.avg("confidence").alias("avg_confidence"),
        (F.sum("cost_usd") / 720).alias("hourly_cost_usd"),
        share(F.col("k") > 74).alias("dataset_drift"),
    )
    names = one.columns
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.col(n).alias("value")) for n in names])).alias("_r")).select("_r.*")
    p95 = exact_quantiles(c, ["latency_seconds"], [0.95]).select(F.lit("p95_latency_seconds").alias("indicator"), "value")
    return telemetry.alert_levels(rows.unionByName(p95))


# ---------------------------------------------------------------- metric tables of predictors

#: Closed-form predictors of the price, so that the metrics can be recomputed in SQL.
_PREDICTORS = {"flat": "38000", "per_unit": "l_quantity * 1500", "per_unit_net": "l_quantity * 1520 * (1 - l_discount)", "per_unit_twin": "l_quantity * 1500"}


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select("*", *[F.expr(e).cast("double").alias(f"p_{n}") for n, e in _PREDICTORS.items()], (F.col("l_extendedprice") / 1500).alias("p_qty"))


def _metric_sql(y: str, p: str) -> dict[str, str]:
    e = f"(CAST({y} AS DOUBLE) - CAST({p} AS DOUBLE))"
    return {"rmse": f"sqrt(avg({e} * {e}))", "mae": f"avg(abs({e}))", "r2": f"1 - avg({e} * {e}) / var_pop({y})"}


def _reg_sql() -> str:
    a, b = _metric_sql("l_extendedprice", _PREDICTORS["per_unit"]), _metric_sql("l_quantity", "l_extendedprice / 1500")
    cols = [f"{R(a[m])} AS {m}_price, {R(b[m])} AS {m}_qty, {R(f'({a[m]} + {b[m]}) / 2')} AS avg_{m}" for m in ("rmse", "mae", "r2")]
    return f"SELECT l_returnflag, {', '.join(cols)} FROM lineitem GROUP BY l_returnflag"


@query("regression_metrics", _reg_sql())
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").withColumns({"p1": F.col("l_quantity") * 1500, "p2": F.col("l_extendedprice") / 1500})
    return models.regression_metrics(li, {"price": ("l_extendedprice", "p1"), "qty": ("l_quantity", "p2")}, ["l_returnflag"])


@query(
    "mape",
    f"""WITH z AS (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS y, l_quantity * 1500 AS p FROM lineitem)
    SELECT l_returnflag, {R('avg(abs((y - p) / nullif(y, 0))) * 100')} AS mape, count(*) FILTER (WHERE y = 0) AS zero_truth FROM z GROUP BY l_returnflag""",
)
def mape(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").select(
        "l_returnflag", F.when(F.col("l_linenumber") == 7, 0.0).otherwise(F.col("l_extendedprice")).alias("y"), (F.col("l_quantity") * 1500).alias("p")
    )
    return models.mape(li, "y", "p", ["l_returnflag"])


def _best_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS model, {i} AS ordinal, {_metric_sql('l_extendedprice', e)['rmse']} AS avg_rmse FROM lineitem" for i, (n, e) in enumerate(_PREDICTORS.items())
    )
    return f"SELECT model, {R('avg_rmse')} AS avg_rmse FROM ({rows}) ORDER BY round(avg_rmse, 6), ordinal LIMIT 1"


@query("pick_best_model", _best_sql())
def pick_best_model(spark: SparkSession, sf: str) -> DataFrame:
    """Two of the predictors are equal, so the tie goes to the first."""
    s = _scored(spark, sf)
    pairs = {n: ("l_extendedprice", f"p_{n}") for n in _PREDICTORS}
    wide = models.regression_metrics(s, pairs)
    rows = wide.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(i).alias("ordinal"), F.col(f"rmse_{n}").alias("avg_rmse")) for i, n in enumerate(_PREDICTORS)])).alias("_r")
    ).select("_r.*")
    return models.pick_best_model(rows)


_X, _Z, _Y = "l_quantity", "l_discount", "l_extendedprice"
_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _X, _Z, _Y]
#: Normal equations of one and of two features on the rows of the other folds, applied to the fold held out.
_FOLDED = f"""folded AS (SELECT CAST({_X} AS DOUBLE) AS x, CAST({_Z} AS DOUBLE) AS z, CAST({_Y} AS DOUBLE) AS y, ntile(5) OVER (ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS fold FROM lineitem),
    t AS (SELECT h.fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy
      FROM (SELECT DISTINCT fold FROM folded) h JOIN folded r ON r.fold <> h.fold GROUP BY h.fold),
    c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b, xy / xx AS one FROM t)"""


@query(
    "cv_compare",
    f"""WITH {_FOLDED}, e AS (SELECT fold, y - (a * (x - mx) + b * (z - mz) + my) AS f, y - (one * (x - mx) + my) AS r FROM folded JOIN c USING (fold)),
    s AS (SELECT fold, avg(f * f) AS f, avg(r * r) AS r FROM e GROUP BY fold),
    m AS (SELECT avg(f) AS fm, sqrt(avg(f)) AS fr, stddev_pop(f) AS fs, avg(r) AS rm, sqrt(avg(r)) AS rr, stddev_pop(r) AS rs FROM s)
    SELECT {R('fm / 1e9')} AS full_mse, {R('fr')} AS full_rmse, {R('fs / 1e9')} AS full_mse_std, {R('rm / 1e9')} AS reduced_mse, {R('rr')} AS reduced_rmse, {R('rs / 1e9')} AS reduced_mse_std,
      {R('100 * (rr - fr) / fr')} AS rmse_change_pct FROM m""",
)
def cv_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Lines fitted on four of five contiguous folds, with two features and with one. Squared errors in 1e9."""
    folded = ordered.contiguous_folds(B.table(spark, sf, "lineitem").select(_LINE_ORDER), [], _LINE_ORDER, 5)
    lines = crossval.cv_lines(folded, {"full": [_X, _Z], "reduced": [_X]}, _Y)
    out = models.cv_compare(*[lines.filter(F.col("features") == n) for n in ("full", "reduced")])
    return out.withColumns({c: F.col(c) / 1e9 for c in ("full_mse", "full_mse_std", "reduced_mse", "reduced_mse_std")})


#: The line through the first four fifths of the line items, applied to the last fifth.
_BACK = f"""placed AS (SELECT CAST({_X} AS DOUBLE) AS x, CAST({_Z} AS DOUBLE) AS z, CAST({_Y} AS DOUBLE) AS y, row_number() OVER (ORDER BY {", ".join(_LINE_ORDER)}) - 1 AS i, count(*) OVER () AS n FROM lineitem),
    h AS (SELECT *, i < floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS head FROM placed),
    t AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy FROM h WHERE head),
    c AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM t),
    p AS (SELECT y, a * (x - mx) + b * (z - mz) + my AS p FROM h CROSS JOIN c WHERE NOT head)"""


@query(
    "backtest",
    f"""WITH {_BACK}
    SELECT {R(_metric_sql('y', 'p')['rmse'])} AS rmse_price, {R(_metric_sql('y', 'p')['mae'])} AS mae_price, {R(_metric_sql('y', 'p')['r2'])} AS r2_price,
      {R(_metric_sql('y', 'p')['rmse'])} AS avg_rmse, {R(_metric_sql('y', 'p')['mae'])} AS avg_mae, {R(_metric_sql('y', 'p')['r2'])} AS avg_r2,
      {R('avg(abs((y - p) / y)) * 100')} AS mape_price FROM p""",
)
def backtest(spark: SparkSession, sf: str) -> DataFrame:
    """A line fitted on the first four fifths, measured on the rest."""
    items = B.table(spark, sf, "lineitem").select(_LINE_ORDER)
    head = ordered.positional_split(items, [], _LINE_ORDER, 0.8).filter(F.col("side") != "current")
    (moments,) = crossval.fold_moments(head.withColumn("fold", F.lit(0)), [_X, _Z], _Y).values()
    coefficients, intercept = crossval.line(moments, [0, 1])
    p = sum((F.col(c).cast("double") * float(b) for c, b in zip((_X, _Z), coefficients, strict=True)), F.lit(intercept))
    told = items.withColumns({"y": F.col(_Y).cast("double"), "p": p})
    return models.backtest(told, [], _LINE_ORDER, {"price": ("y", "p")})


