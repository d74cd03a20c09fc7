"""Usage, cost, guard and metric-sample roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions.columns import as_col, token_cost, token_split
from airframe.operators import ordered

METRIC_NAMES = r"^(llm_.*|rag_.*|guardrail_.*)$"


def metric_keep(samples: DataFrame, name: str = "name", instance: str = "host-machine") -> DataFrame:
    """Keep the service's own metrics (the whole name must match) and relabel the instance."""
    return samples.filter(F.col(name).rlike(METRIC_NAMES)).withColumn("instance", F.lit(instance))


def price_lookup(df: DataFrame, model: str = "model", prices: DataFrame | None = None) -> DataFrame:
    """Attach the prices of the model; unknown models take the default row."""
    table = schemas.price_table(df.sparkSession) if prices is None else prices
    named = table.select(F.col("model").alias("_m"), F.col("price_in").alias("_in"), F.col("price_out").alias("_out"))
    fallback = table.filter(F.col("model") == "default").select(
        F.col("price_in").alias("_din"), F.col("price_out").alias("_dout")
    )
    # Both sides are the fixed price list: six rows and one row.
    joined = df.join(F.broadcast(named), df[model] == F.col("_m"), "left").crossJoin(F.broadcast(fallback))
    return joined.select(
        *[df[c] for c in df.columns],
        F.coalesce("_in", "_din").alias("price_in"),
        F.coalesce("_out", "_dout").alias("price_out"),
    )


def with_cost(df: DataFrame, total: str = "tokens", model: str = "model", prices: DataFrame | None = None) -> DataFrame:
    """Split total tokens, look up the price and add the request's cost."""
    split = token_split(total)
    out = price_lookup(df, model, prices).withColumns(split)
    return out.withColumn("cost_usd", token_cost("input_tokens", "output_tokens", "price_in", "price_out"))


def usage_by_model(df: DataFrame, model: str = "model", endpoint: str = "endpoint", status: str = "status") -> DataFrame:
    """Requests, tokens and cost per label set, with the share of all requests."""
    grouped = df.groupBy(model, endpoint, status).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("input_tokens") + F.sum("output_tokens")).alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    total = grouped.agg(F.sum("requests").alias("_all"))
    return (
        grouped.crossJoin(F.broadcast(total))  # exactly one row
        .withColumn("share", F.try_divide(F.col("requests").cast("double"), F.col("_all")))
        .drop("_all")
    )


def usage_totals(df: DataFrame, latency: str = "latency_seconds") -> DataFrame:
    """Totals over the whole log; the average latency of an empty log is 0."""
    return df.agg(
        F.count(F.lit(1)).alias("requests_total"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens_input"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("tokens_output"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_total_usd"),
        F.coalesce(F.try_divide(F.sum(latency), F.count(latency)), F.lit(0.0)).alias("average_latency_seconds"),
    )


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def query_status(input_passed: Column | str, documents: Column | str, generated: Column | str, output_passed: Column | str, failed: Column | str | None = None) -> Column:
    """Outcome of a guarded question, in the order the steps run."""
    first = F.when(as_col(failed), "error") if failed is not None else F.when(F.lit(False), "error")
    return (
        first.when(~as_col(input_passed), "blocked_input")
        .when(as_col(documents) == 0, "no_documents")
        .when(~as_col(generated), "generation_error")
        .when(~as_col(output_passed), "blocked_output")
        .otherwise("success")
    )


def bucket_histograms(df: DataFrame, metrics: dict[str, tuple[str, Sequence[float]]], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets of several values in one pass: (metric, labels…, le, cum, sum, count).

    ``metrics``: name → (numeric column, upper bounds); the last bucket is infinity. One conditional
    count per bound inside a single aggregate, so rows are never multiplied. Written as SQL text, as
    eight metrics are about a hundred expressions.
    """
    aggs, rows = [], []
    for m, (value, bounds) in enumerate(metrics.values()):
        v = f"CAST({value} AS DOUBLE)"
        aggs += [f"count_if({v} <= {float(b)!r}D) AS _m{m}_{i}" for i, b in enumerate(bounds)]
        aggs += [f"count({v}) AS _m{m}_n", f"coalesce(sum({v}), 0D) AS _m{m}_s"]
    for m, (name, (_, bounds)) in enumerate(metrics.items()):
        points = [(f"{float(b)!r}D", f"_m{m}_{i}") for i, b in enumerate(bounds)] + [("DOUBLE('Infinity')", f"_m{m}_n")]
        rows += [f"named_struct('metric', '{name}', 'le', {le}, 'cum', {c}, 'sum', _m{m}_s, 'count', _m{m}_n)" for le, c in points]
    counted = df.groupBy(*labels).agg(*[F.expr(a) for a in aggs])
    shown = [f"`{c}`" for c in labels]
    return counted.selectExpr(*shown, f"explode(array({', '.join(rows)})) AS _r").selectExpr(
        "_r.metric", *shown, "_r.le", "_r.cum", "_r.sum", "_r.count"
    )


def bucket_histogram(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative buckets of one value: one row per label set and upper bound."""
    return bucket_histograms(df, {"value": (value, bounds)}, labels).drop("metric")


def without_labels(hist: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The histograms of the named metrics summed over their labels."""
    return (
        hist.filter(F.col("metric").isin(list(metrics)))
        .groupBy("metric", "le")
        .agg(F.sum("cum").alias("cum"), F.sum("sum").alias("sum"), F.sum("count").alias("count"))
    )


def histogram_quantile(buckets: DataFrame, quantiles: Sequence[float], labels: Sequence[str] = (), le: str = "le", cum: str = "cum") -> DataFrame:
    """Quantile by linear interpolation inside the first bucket reaching the rank.

    The lowest bucket starts at 0; a rank in the open bucket yields the largest finite bound. A label
    set holds one row per bound, so the whole computation is an array fold within one aggregated row.
    """
    pts = F.array_sort(F.collect_list(F.struct(F.col(le).cast("double").alias("le"), F.col(cum).cast("double").alias("cum"))))
    grouped = buckets.groupBy(*labels).agg(pts.alias("_pts"))
    inf = F.lit(float("inf"))
    total = F.element_at("_pts", -1)["cum"]
    exploded = grouped.select(
        *labels, "_pts", total.alias("_n"), F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    ).withColumn("_rank", F.col("q") * F.col("_n"))
    reach = F.filter("_pts", lambda p: p["cum"] >= F.col("_rank"))
    below = F.filter("_pts", lambda p: p["cum"] < F.col("_rank"))
    hit, prev = F.get(reach, F.lit(0)), F.try_element_at(below, F.lit(-1))
    finite = F.filter("_pts", lambda p: p["le"] < inf)
    lo_le = F.coalesce(prev["le"], F.lit(0.0))
    lo_cum = F.coalesce(prev["cum"], F.lit(0.0))
    inner = lo_le + (hit["le"] - lo_le) * F.try_divide(F.col("_rank") - lo_cum, hit["cum"] - lo_cum)
    value = (
        F.when(F.col("_n") == 0, F.lit(None).cast("double"))
        .when(hit["le"] == inf, F.try_element_at(finite, F.lit(-1))["le"])
        .otherwise(inner)
    )
    return exploded.select(*labels, "q", value.alias("value"))


def mean_response(hist: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """sum / count of a histogram."""
    one = hist.select(*labels, "sum", "count").distinct()
    return one.select(*labels, F.try_divide(F.col("sum"), F.col("count")).alias("mean"))


def latest_samples(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    return samples.groupBy(*series).agg(F.max_by(value, ts).alias(value))


def sum_by_label(samples: DataFrame, series: Sequence[str], by: Sequence[str] = (), ts: str = "ts", value: str = "value") -> DataFrame:
    """Sum over series of their latest sample, per label."""
    return latest_samples(samples, series, ts, value).groupBy(*by).agg(F.sum(value).alias("total"))


def cpu_percent(
    samples: DataFrame,
    series: Sequence[str],
    instance: str,
    ts: str = "ts",
    value: str = "value",
    window_seconds: int = 300,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """100 minus the average instant idle rate in percent, at each series' latest sample."""
    rates = ordered.counter_rate(samples, series, ts, value, window_seconds, bucket_seconds)
    last = rates.groupBy(*series).agg(F.max_by("irate", F.when(F.col("irate").isNotNull(), F.col(ts))).alias("irate"))
    return last.groupBy(instance).agg((F.lit(100.0) - F.avg("irate") * F.lit(100.0)).alias("cpu_percent"))


def used_percent(samples: DataFrame, instance: str, name: str, available: str, total: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(1 - available / total) · 100 from the latest samples of two gauges."""
    pick = lambda metric: F.max_by(F.when(F.col(name) == metric, F.col(value)), F.when(F.col(name) == metric, F.col(ts)))
    both = samples.groupBy(instance).agg(pick(available).alias("_a"), pick(total).alias("_t"))
    return both.select(instance, ((F.lit(1.0) - F.try_divide(F.col("_a"), F.col("_t"))) * F.lit(100.0)).alias("used_percent"))


def alert_levels(indicators: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """ok / warning / critical per (indicator, value)."""
    table = schemas.alert_table(indicators.sparkSession) if limits is None else limits
    joined = indicators.join(F.broadcast(table), "indicator")  # one row per indicator name
    v, above = F.col("value"), F.col("direction") == "above"

    def beyond(limit: str) -> Column:
        return F.when(above, v > F.col(limit)).otherwise(v < F.col(limit))

    return joined.withColumn(
        "level", F.when(beyond("critical"), "critical").when(beyond("warning"), "warning").otherwise("ok")
    )


def guard_check_counts(verdicts: DataFrame, stage: str = "stage", passed: str = "passed", sanitized: str = "sanitized") -> DataFrame:
    result = F.when(~F.col(passed), "blocked").when(F.coalesce(F.col(sanitized), F.lit(False)), "sanitized").otherwise("passed")
    return verdicts.groupBy(stage, result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def guard_event_counts(events: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Rows per event type; types that never occurred appear with 0."""
    spine = events.sparkSession.createDataFrame([(t,) for t in schemas.GUARD_EVENT_TYPES], "event_type string")
    counted = events.groupBy(F.col(event_type).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).alias("n"))


def guard_event_stats(events: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Total, blocked and block rate (0 without events)."""
    blocked = F.count_if(F.col(event_type).isin("input_blocked", "output_blocked"))
    return events.agg(F.count(F.lit(1)).alias("total_events"), blocked.alias("total_blocked")).select(
        "*",
        F.coalesce(F.try_divide(F.col("total_blocked").cast("double"), F.col("total_events")), F.lit(0.0)).alias("block_rate"),
    )


def violation_counts(events: DataFrame, violations: str = "violations") -> DataFrame:
    """Occurrences per violation; repeats within one event count each time."""
    return events.select(F.explode(violations).alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def safety_status(events: DataFrame, stage: str = "stage", ts: str = "ts", blocked: str = "blocked", reset: str = "reset") -> DataFrame:
    """1 until a block, then 0 until a reset: the last block against the last reset, a plain aggregate."""
    last_block = F.max(F.when(F.col(blocked), F.col(ts)))
    last_reset = F.max(F.when(F.col(reset), F.col(ts)))
    agg = events.groupBy(stage).agg(last_block.alias("_b"), last_reset.alias("_r"))
    bad = F.col("_b").isNotNull() & (F.col("_r").isNull() | (F.col("_b") > F.col("_r")))
    return agg.select(stage, F.when(bad, 0).otherwise(1).alias("status"))


def per_window(windowed: DataFrame, by: Sequence[str]) -> DataFrame:
    """(window_start, window_end, by…, increase, rate per second) of summed windows."""
    start, end = F.col("window.start"), F.col("window.end")
    seconds = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return windowed.select(
        start.alias("window_start"), end.alias("window_end"), *by, "increase", (F.col("increase") / seconds).alias("rate")
    )


def windowed_rate(events: DataFrame, ts: str, by: Sequence[str], amount: Column | None = None, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sum (or count) per sliding window and the same per second.

    Events are first summed per slide, so that only those sums are multiplied by the number of
    windows they belong to. The window must be a multiple of the slide.
    """
    total = F.sum(amount) if amount is not None else F.count(F.lit(1))
    slices = events.groupBy(F.window(ts, slide).alias("_slice"), *by).agg(total.alias("_sum"))
    slices = slices.select(F.col("_slice.start").alias("_at"), *by, "_sum")
    summed = slices.groupBy(F.window("_at", window, slide).alias("window"), *by).agg(F.sum("_sum").cast("double").alias("increase"))
    return per_window(summed, by)
