"""Operators that need row order.

A window over a whole series puts that series into one task, and a single series may hold a large
part of the table. Everything here therefore works in two steps: rows are grouped into *time buckets*
``(keys, bucket)`` and handled by a window inside the bucket; what has to cross a bucket border is
carried by a frame with one row per bucket and joined back. The rows themselves are shuffled once,
on ``(keys, bucket)``; the join back reuses that partitioning. The order columns must tell the rows of
a series apart. Positions, splits and folds have no natural time width: unless a caller names a bucket or a
width, their buckets are ranges of (keys, order) with about equal numbers of rows (``ranged``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airframe.functions.columns import as_col, unit_noise
from airframe.session import new_path

BUCKET, RANGE = "_bucket", "_range"
#: Ranges per shuffle partition, so that the tasks which get several ranges are even.
RANGES = 4

#: Stand-ins for a NULL key, so that joins on keys are plain equalities and keep the partitioning.
_STAND_IN = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _time_bucket(order: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(order).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def _keyed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None, seconds: int
) -> tuple[DataFrame, list[str]]:
    """Add the bucket (by default the leading order column, a time, cut every ``seconds``) and, for keys
    that may be NULL, a never-NULL pair of columns. Returns the frame and the names that partition it."""
    added: dict[str, Column] = {}
    names: list[str] = []
    for k in keys:
        field = df.schema[k]
        if not field.nullable:
            names.append(k)
            continue
        kind = field.dataType.simpleString()
        stand_in = F.lit(_STAND_IN.get(kind, 0)).cast(field.dataType)
        added[f"_v_{k}"] = F.coalesce(F.col(k), stand_in)
        added[f"_n_{k}"] = F.col(k).isNull()
        names += [f"_v_{k}", f"_n_{k}"]
    added[BUCKET] = F.coalesce(_time_bucket(order[0], seconds) if bucket is None else bucket, F.lit(0).cast("long"))
    return df.withColumns(added), [*names, BUCKET]


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their range, ``_range``, which never decreases in (keys, order).

    Spark samples the rows to cut them evenly, so a busy day or a series with most of the rows is many ranges. The
    result is written to the shared folder: the numbers hold for every later reader, and the rows are
    computed once.
    """
    spark = df.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(ranges, *keys, *order).withColumn(RANGE, F.spark_partition_id().cast("long"))
    path = new_path(spark, "ranges")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def within(parts: Sequence[str], order: Sequence[str]):
    """Frames inside a bucket: start to here, and end to here. Both are running frames; a frame that
    reaches ahead would be evaluated anew for every row."""
    w = Window.partitionBy(*parts)
    here = (Window.unboundedPreceding, Window.currentRow)
    return w.orderBy(*order).rowsBetween(*here), w.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*here)


def across(parts: Sequence[str]):
    """Frames over the one-row-per-bucket summary: earlier buckets, later buckets, all buckets."""
    series = [F.col(p) for p in parts if p != BUCKET] or [F.lit(0)]
    w = Window.partitionBy(*series)
    return (
        w.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1),
        w.orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1),
        w.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing),
    )


def join_carry(rows: DataFrame, carry: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Equi-join on the partitioning columns; the carry side has one row per bucket."""
    named = carry.select(*[F.col(p).alias(f"_c{p}") if p in parts else F.col(p) for p in carry.columns])
    cond = None
    for p in parts:
        c = F.col(p) == F.col(f"_c{p}")
        cond = c if cond is None else cond & c
    return rows.join(named, cond, "left").drop(*[f"_c{p}" for p in parts])


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column | str],
    bucket: Column | None = None,
    seconds: int = 86_400,
    whole: dict[str, Column] | None = None,
    following: bool = False,
) -> DataFrame:
    """Inclusive running sum of each expression, named by the dictionary key.

    The bucket summary also yields, without another pass: ``_size`` (rows of the series), ``_all_*``
    (the sum over the whole series), the maximum over the series of every expression in ``whole``, and
    with ``following`` the next row's leading order column as ``_next``.
    """
    whole = whole or {}
    src, parts = _keyed(df, keys, order, bucket, seconds)
    back, _ = within(parts, order)
    ahead = [F.lead(order[0]).over(Window.partitionBy(*parts).orderBy(*order)).alias("_lead")] if following else []
    rows = src.select("*", *[F.sum(as_col(c)).over(back).alias(f"_in_{n}") for n, c in totals.items()], *ahead)
    per_bucket = src.groupBy(*parts).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(as_col(c)).alias(f"_sum_{n}") for n, c in totals.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in whole.items()],
        *([F.min(order[0]).alias("_min")] if following else []),
    )
    before, after, everywhere = across(parts)
    carry = per_bucket.select(
        *parts,
        F.sum("_rows").over(everywhere).alias("_size"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_off_{n}") for n in totals],
        *[F.sum(f"_sum_{n}").over(everywhere).alias(f"_all_{n}") for n in totals],
        *[F.max(f"_max_{n}").over(everywhere).alias(n) for n in whole],
        *([F.min("_min").over(after).alias("_later")] if following else []),
    )
    out = join_carry(rows, carry, parts)

    def total(n: str) -> Column:
        here, off = F.col(f"_in_{n}"), F.col(f"_off_{n}")
        return F.when(
            here.isNotNull() | off.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(off, F.lit(0))
        ).alias(n)

    return out.select(
        *[F.col(c) for c in df.columns],
        *[total(n) for n in totals],
        "_size",
        *[f"_all_{n}" for n in totals],
        *whole,
        *([F.coalesce("_lead", "_later").alias("_next")] if following else []),
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    bucket: Column | None = None,
    seconds: int | None = None,
    size: str | None = None,
) -> DataFrame:
    """0-based row number per series (and its row count), without sorting a series in one task.

    Buckets are ranges of even size, or those of ``bucket``, or ``seconds`` wide.
    """
    even = bucket is None and seconds is None
    src = ranged(df, keys, order) if even else df
    bucket = F.col(RANGE) if even else bucket
    out = running_totals(src, keys, order, {name: F.lit(1).cast("long")}, bucket, seconds or 0)
    extra = [F.col("_size").alias(size)] if size else []
    return out.select(*[F.col(c) for c in df.columns], (F.col(name) - F.lit(1)).alias(name), *extra)


def row_after(df: DataFrame, order: Sequence[str], columns: Sequence[str], bucket: Column, prefix: str = "_o_") -> DataFrame:
    """Each row with the ``columns`` of the row after it in the order of (bucket, order), the last row with those of the first.

    The rows are shuffled once and never joined on a position: only the first row of each bucket goes to the bucket
    before. Ties are ordered by all other columns, so both readers of the rows need the same columns, in the same order, and share the exchange.
    """
    by = [*order, *[c for c in df.columns if c not in order]]
    src = df.withColumn(BUCKET, bucket)
    w = Window.partitionBy(BUCKET).orderBy(*by)
    rows = src.select("*", F.lead(F.lit(True)).over(w).alias("_more"), *[F.lead(c).over(w).alias(f"_lead_{c}") for c in columns])
    first = src.select("*", F.lag(F.lit(True)).over(w).alias("_less")).where("_less IS NULL")
    along = Window.partitionBy(F.lit(0)).orderBy(BUCKET)  # one row a bucket
    ends = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_first = lambda c: F.when(F.lead(F.lit(True)).over(along), F.lead(c).over(along)).otherwise(F.first(c).over(ends))
    carry = first.select(BUCKET, *[next_first(c).alias(f"_next_{c}") for c in columns])
    told = [F.when(F.col("_more"), F.col(f"_lead_{c}")).otherwise(F.col(f"_next_{c}")).alias(f"{prefix}{c}") for c in columns]
    return join_carry(rows, carry, [BUCKET]).select(*df.columns, *told)


def _neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    need_next: Sequence[str],
    need_pos: bool,
    bucket: Column | None,
    seconds: int | None,
) -> DataFrame:
    """For each column add ``_prev_c`` (last valid at or before the row) and, for the columns of
    ``need_next``, ``_next_c`` (first valid at or after it). With ``need_pos`` the row's position is
    ``_pos`` and the positions of those neighbours are ``_pp_c`` and ``_np_c``. With neither ``bucket`` nor
    ``seconds`` the buckets are ranges of even size, for series whose rows crowd into some hours.
    """
    even = bucket is None and seconds is None
    rows = ranged(df, keys, order) if even else df
    src, parts = _keyed(rows, keys, order, F.col(RANGE) if even else bucket, seconds or 0)
    running = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    back = f"OVER (PARTITION BY {_names(parts)} ORDER BY {_names(order)} {running})"
    ahead = f"OVER (PARTITION BY {_names(parts)} ORDER BY {', '.join(f'`{c}` DESC' for c in order)} {running})"
    placed = list(need_next) if need_pos else []
    rows = src.selectExpr("*", f"count(1) {back} AS _pos") if need_pos else src
    # Written as SQL text: with twenty columns these are well over a thousand Column calls otherwise.
    rows = rows.selectExpr(
        "*",
        *[f"last_value(`{c}`) IGNORE NULLS {back} AS `_prev_{c}`" for c in columns],
        *[f"last_value(`{c}`) IGNORE NULLS {ahead} AS `_next_{c}`" for c in need_next],
        *[f"max(IF(`{c}` IS NULL, NULL, _pos)) {back} AS `_pp_{c}`" for c in placed],
        *[f"min(IF(`{c}` IS NULL, NULL, _pos)) {ahead} AS `_np_{c}`" for c in placed],
    )

    # One row per bucket, read off the windowed rows. Every value is an aggregate of its own, so that
    # both branches are pruned alike and Spark reuses the one exchange of the rows.
    stamp = "_pos" if need_pos else (f"`{order[0]}`" if len(order) == 1 else f"struct({_names(order)})")
    aggs = ["count(1) AS _n"]
    aggs += [f"max_by(`_prev_{c}`, {stamp}) AS `_l_{c}`" for c in columns]
    aggs += [f"min_by(`_next_{c}`, {stamp}) AS `_f_{c}`" for c in need_next]
    aggs += [f"max(`_pp_{c}`) AS `_lp_{c}`" for c in placed] + [f"min(`_np_{c}`) AS `_fp_{c}`" for c in placed]
    summary = rows.groupBy(*parts).agg(*[F.expr(a) for a in aggs])
    series = _names([p for p in parts if p != BUCKET]) or "0"
    earlier = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    before = f"OVER (PARTITION BY {series} ORDER BY {BUCKET} {earlier})"
    after = f"OVER (PARTITION BY {series} ORDER BY {BUCKET} DESC {earlier})"
    carry = summary.selectExpr("*", f"coalesce(sum(_n) {before}, 0L) AS _off").selectExpr(
        *parts,
        "_off",
        *[f"last_value(`_l_{c}`) IGNORE NULLS {before} AS `_cprev_{c}`" for c in columns],
        *[f"last_value(`_f_{c}`) IGNORE NULLS {after} AS `_cnext_{c}`" for c in need_next],
        *[f"max(`_lp_{c}` + _off) {before} AS `_cpp_{c}`" for c in placed],
        *[f"min(`_fp_{c}` + _off) {after} AS `_cnp_{c}`" for c in placed],
    )
    key = lambda c: f"IF(`_n_{c}`, NULL, `_v_{c}`) AS `{c}`" if f"_n_{c}" in parts else f"`{c}`"
    return join_carry(rows, carry, parts).selectExpr(
        *[key(c) for c in df.columns],
        *[f"coalesce(`_prev_{c}`, `_cprev_{c}`) AS `_prev_{c}`" for c in columns],
        *[f"coalesce(`_next_{c}`, `_cnext_{c}`) AS `_next_{c}`" for c in need_next],
        *(["_pos + _off AS _pos"] if need_pos else []),
        *[f"coalesce(`_pp_{c}` + _off, `_cpp_{c}`) AS `_pp_{c}`" for c in placed],
        *[f"coalesce(`_np_{c}` + _off, `_cnp_{c}`) AS `_np_{c}`" for c in placed],
    )


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def ffill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    bucket: Column | None = None,
    seconds: int | None = 86_400,
) -> DataFrame:
    """Replace a NULL by the last valid value before it; leading NULLs stay."""
    n = _neighbours(df, keys, order, columns, [], False, bucket, seconds)
    return n.select(*[F.col(f"_prev_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def _lerp(c: str) -> str:
    """A missing value lies on the line between its neighbours; at the ends one neighbour is missing."""
    prev, nxt, before, behind = (f"`{side}_{c}`" for side in ("_prev", "_next", "_pp", "_np"))
    inner = f"{prev} + ({nxt} - {prev}) * CAST(_pos - {before} AS DOUBLE) / CAST({behind} - {before} AS DOUBLE)"
    return f"coalesce(`{c}`, CASE WHEN {prev} IS NULL THEN {nxt} WHEN {nxt} IS NULL THEN {prev} ELSE {inner} END) AS `{c}`"


def interpolate_linear(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    bucket: Column | None = None,
    seconds: int | None = 86_400,
) -> DataFrame:
    """Linear by row position; both ends take the nearest valid value; an all-NULL series stays NULL."""
    return fill(df, keys, order, interpolate=columns, carry=[], bucket=bucket, seconds=seconds)


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    interpolate: Sequence[str],
    carry: Sequence[str],
    bucket: Column | None = None,
    seconds: int | None = 86_400,
) -> DataFrame:
    """Interpolate one set of columns and forward-fill another in a single pass (one shuffle, one sort)."""
    typed = df.selectExpr(*[f"CAST(`{c}` AS DOUBLE) AS `{c}`" if c in interpolate else f"`{c}`" for c in df.columns])
    n = _neighbours(typed, keys, order, [*interpolate, *carry], list(interpolate), True, bucket, seconds)
    kept = {c: f"`{c}`" for c in df.columns}
    kept |= {c: f"`_prev_{c}` AS `{c}`" for c in carry} | {c: _lerp(c) for c in interpolate}
    return n.selectExpr(*[kept[c] for c in df.columns])


#: Which column is filled how. Columns absent from a frame are skipped.
INTERPOLATED = [
    "co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3", "aqi_index",
    "temperature_2m", "dew_point_2m", "apparent_temperature",
    "relative_humidity_2m", "surface_pressure", "wind_speed_10m",
]
CARRIED = ["year", "month", "day", "hour", "wind_direction_10m"]
#: Never NULL after the day/night rules; carried along, which leaves them as they are.
RULED = ["shortwave_radiation", "precipitation"]


def night_rules(df: DataFrame) -> DataFrame:
    """Radiation below 1 or missing is 0, evapotranspiration is 0 where radiation is, rain defaults to 0."""
    has = set(df.columns)
    out = df
    if "shortwave_radiation" in has:
        r = F.col("shortwave_radiation")
        out = out.withColumn("shortwave_radiation", F.when(r.isNull() | (r < 1), F.lit(0.0)).otherwise(r.cast("double")))
        if "et0_fao_evapotranspiration" in has:
            out = out.withColumn(
                "et0_fao_evapotranspiration",
                F.when(F.col("shortwave_radiation") == 0, F.lit(0.0)).otherwise(F.col("et0_fao_evapotranspiration")),
            )
    if "precipitation" in has:
        out = out.withColumn("precipitation", F.coalesce(F.col("precipitation").cast("double"), F.lit(0.0)))
    return out


def zero_then_interpolate(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None, seconds: int | None = 86_400
) -> DataFrame:
    """The three day/night columns alone."""
    ruled = night_rules(df)
    cols = [c for c in ["et0_fao_evapotranspiration"] if c in df.columns]
    return fill(ruled, keys, order, cols, [], bucket, seconds) if cols else ruled


def impute_readings(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None, seconds: int | None = 86_400
) -> DataFrame:
    """The whole per-column policy in one shuffle and one sort."""
    protected = set(keys) | set(order)
    lerp = [c for c in [*INTERPOLATED, "et0_fao_evapotranspiration"] if c in df.columns and c not in protected]
    carried = [c for c in [*CARRIED, *RULED] if c in df.columns and c not in protected]
    return fill(night_rules(df), keys, order, lerp, carried, bucket, seconds)


def positional_split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    share: float = 0.8,
    bucket: Column | None = None,
    seconds: int | None = None,
    name: str = "side",
) -> DataFrame:
    """``reference`` for the first ``int(n * share)`` rows of a series, ``current`` for the rest."""
    placed = positions(df, keys, order, "_p", bucket, seconds, size="_n")
    cut = F.floor(F.col("_n").cast("double") * F.lit(share))
    return placed.withColumn(name, F.when(F.col("_p") < cut, "reference").otherwise("current")).drop("_p", "_n")


def contiguous_folds(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    k: int = 5,
    bucket: Column | None = None,
    seconds: int | None = None,
    name: str = "fold",
) -> DataFrame:
    """Unshuffled folds 0..k-1 by position; the first ``n mod k`` folds hold one row more."""
    placed = positions(df, keys, order, "_p", bucket, seconds, size="_n")
    size, extra, p = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_p")
    head = extra * (size + 1)
    fold = F.when(p < head, F.floor(p / (size + 1))).otherwise(extra + F.floor(F.try_divide(p - head, size)))
    return placed.withColumn(name, fold.cast("int")).drop("_p", "_n")


def counter_steps(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    bucket: Column | None = None,
    seconds: int = 86_400,
) -> DataFrame:
    """Add ``_prev_ts``, ``_prev_value`` and ``delta`` (reset-aware increase since the previous sample)."""
    src, parts = _keyed(df, keys, [order], bucket, seconds)
    here = F.struct(F.col(order).alias("t"), F.col(value).alias("v"))
    rows = src.withColumn("_lag", F.lag(here).over(Window.partitionBy(*parts).orderBy(order)))
    summary = src.groupBy(*parts).agg(F.max_by(here, F.col(order)).alias("_end"))
    before, _, _ = across(parts)
    carry = summary.select(*parts, F.last("_end").over(before).alias("_carry"))
    joined = join_carry(rows, carry, parts).withColumn("_lag", F.coalesce("_lag", "_carry"))
    prev, v = F.col("_lag")["v"], F.col(value)
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.col("_lag")["t"].alias("_prev_ts"),
        prev.alias("_prev_value"),
        F.when(prev.isNotNull(), F.when(v < prev, v).otherwise(v - prev)).alias("delta"),
    )


def counter_rate(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    window_seconds: int = 300,
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """``increase``, ``rate`` and ``irate`` of a counter over the trailing window ending at each sample.

    The increase is the sum of reset-aware steps whose two samples both lie in the window; the rate is
    that sum over the time between the first and the last of those samples. Values are not extrapolated
    to the window edges. Totals run over sorted rows, so the cost does not depend on the length of the window. Rows of a bucket's last ``window_seconds`` are also shown to the next bucket,
    so no window has to cross a bucket border.
    """
    if bucket_seconds < window_seconds:
        raise ValueError("a bucket must be at least as long as the window")
    steps = counter_steps(df, keys, order, value)
    micros = F.unix_micros(F.col(order).cast("timestamp"))
    width = bucket_seconds * 1_000_000
    own = F.floor(micros / F.lit(width)).cast("long")
    near_end = micros - own * F.lit(width) >= F.lit((bucket_seconds - window_seconds) * 1_000_000)
    shown = steps.withColumn("_us", micros).withColumn(
        BUCKET,
        F.explode(F.when(near_end, F.array(own, own + F.lit(1))).otherwise(F.array(own))),
    )
    # A probe at the start of every sample's window meets the first sample of that window in a sorted pass.
    parts, running = [*keys, BUCKET], (Window.unboundedPreceding, Window.currentRow)
    rising = Window.partitionBy(*parts).orderBy("_us", F.col("delta").asc_nulls_first()).rowsBetween(*running)
    peers = Window.partitionBy(*parts).orderBy("_us").rangeBetween(*running)
    ranked = shown.withColumn("_here", F.struct(F.col("_us").alias("us"), F.coalesce(F.sum("delta").over(rising), F.lit(0)).alias("total"), (F.count("delta").over(rising) - F.col("delta").isNotNull().cast("long")).alias("before")))
    ranked = ranked.withColumn("_upto", F.sum("delta").over(peers)).withColumn("_known", F.count("delta").over(peers)).withColumn("_prev_us", F.unix_micros(F.col("_prev_ts").cast("timestamp")))
    probed = ranked.withColumn("_probe", F.explode(F.array(F.lit(True), F.lit(False))))
    place = F.when(F.col("_probe"), F.col("_us") - window_seconds * 1_000_000).otherwise(F.col("_us"))
    falling = Window.partitionBy(*parts).orderBy(F.desc("_place"), F.asc("_probe"), F.desc("_here")).rowsBetween(*running)
    met = F.last(F.when(~F.col("_probe"), F.col("_here")), ignorenulls=True).over(falling)
    probed = probed.withColumn("_place", place).withColumn("_met", F.when(F.col("_probe"), met))
    back = Window.partitionBy(*parts).orderBy("_us", F.desc("_probe")).rowsBetween(*running)
    probed = probed.withColumn("_first", F.last("_met", ignorenulls=True).over(back)).filter(~F.col("_probe"))
    # The step that enters the window from outside belongs to the earlier sample and is left out.
    ranked = probed.withColumn("_start", F.col("_first.us")).withColumn(
        "increase", F.when((F.col("_start") < F.col("_us")) & (F.col("_known") > F.col("_first.before")), F.col("_upto") - F.col("_first.total"))
    )
    elapsed = (F.col("_us") - F.col("_start")) / F.lit(1_000_000.0)
    ranked = ranked.withColumn("rate", F.try_divide(F.col("increase").cast("double"), elapsed))
    gap = (F.col("_us") - F.col("_prev_us")) / F.lit(1_000_000.0)
    in_window = F.col("_prev_us") >= F.col("_us") - F.lit(window_seconds * 1_000_000)
    ranked = ranked.withColumn("irate", F.when(in_window, F.try_divide(F.col("delta").cast("double"), gap)))
    return ranked.filter(F.floor(F.col("_us") / F.lit(width)) == F.col(BUCKET)).select(
        *[F.col(c) for c in df.columns], "delta", "increase", "rate", "irate"
    )


def multiplicative_walk(
    df: DataFrame,
    keys: Sequence[str],
    step: str,
    columns: Sequence[str],
    spread: float = 0.03,
    bucket_steps: int = 1_000,
    seed: int = 42,
) -> DataFrame:
    """Row 0 keeps its value; row i is row i-1 times ``1 + u`` with ``u`` in ``[-spread, spread)``.

    Written as ``x0 * exp(sum(log1p(u)))`` so that it is a running sum, not a recursion. The noise is
    a hash of seed, series, column and step.
    """
    logs = {
        f"_w_{c}": F.when(
            F.col(step) > 0,
            F.log1p(unit_noise(F.lit(seed), *keys, F.lit(c), step) * F.lit(2 * spread) - F.lit(spread)),
        ).otherwise(F.lit(0.0))
        for c in columns
    }
    bucket = F.floor(F.col(step) / F.lit(bucket_steps)).cast("long")
    start = {f"_x0_{c}": F.when(F.col(step) == 0, F.col(c)) for c in columns}
    walked = running_totals(df, keys, [step], logs, bucket=bucket, whole=start)
    return walked.select(
        *[
            (F.col(f"_x0_{c}") * F.exp(F.col(f"_w_{c}"))).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def recent(df: DataFrame, order: Sequence[str], n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The last n rows, per key when keys are given. Only n rows per input partition are shuffled."""
    desc = [F.col(c).desc() for c in order]
    if not keys:
        return df.orderBy(*desc).limit(n)
    w = Window.partitionBy(*keys).orderBy(*desc)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hour_spine(origins: DataFrame, origin: str, hours: int, keep: Sequence[str] = ()) -> DataFrame:
    """The next ``hours`` full hours after ``origin`` per row, with step number and calendar parts."""
    start = F.date_trunc("hour", F.col(origin).cast("timestamp")) + F.expr("INTERVAL 1 HOUR")
    last = start + F.make_dt_interval(hours=F.lit(hours - 1))
    steps = origins.select(*keep, F.posexplode(F.sequence(start, last, F.expr("INTERVAL 1 HOUR"))).alias("step", "_t"))
    return steps.select(
        *keep,
        "step",
        F.col("_t").cast("timestamp_ntz").alias("ts"),
        F.year("_t").alias("year"),
        F.month("_t").alias("month"),
        F.dayofmonth("_t").alias("day"),
        F.hour("_t").alias("hour"),
    )
