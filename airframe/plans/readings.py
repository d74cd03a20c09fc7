"""Queries over readings: scalars, filters, ordered operators, aggregates, forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe import schemas
from airframe.functions import columns as C
from airframe.functions import sqlfuncs
from airframe.operators import airquality, forecast, models, ordered, tables
from airframe.plans import base as B
from airframe.plans.base import CLEAN_SQL, D, EVENTS_SQL, R, READINGS_SQL, TS, query
from airframe.sources import tables as io

KEY, ORDER = ["station"], ["ts"]
DOUBLES = [*schemas.POLLUTANTS, *schemas.WEATHER]
_ALL_SQL = ", ".join(["station", f"{TS('ts')} AS ts", "aqi_index", *[f"{R(c)} AS {c}" for c in DOUBLES], *schemas.CALENDAR])

# ---------------------------------------------------------------- scalars


@query(
    "flatten_observation",
    f"""WITH {READINGS_SQL} SELECT station, aqi_index, {", ".join(f"{R(c)} AS {c}" for c in DOUBLES)},
    CAST(NULL AS DOUBLE) AS cloud_cover, year, month, day, hour FROM readings""",
)
def flatten_observation(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf)
    nested = r.select("station", *[c.alias(n) for n, c in io.nest_observation(r.columns, F.unix_seconds(F.col("ts").cast("timestamp"))).items()])
    return nested.select("station", *C.flatten_observation())


_EPOCH = "CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END"


@query(
    "epoch_parts",
    f"""WITH {EVENTS_SQL} SELECT event_id, {", ".join(f"CASE WHEN k > 1 THEN CAST(date_part('{p}', ts) AS INTEGER) END AS {p}" for p in ("year", "month", "day", "hour"))} FROM ev""",
)
def epoch_parts(spark: SparkSession, sf: str) -> DataFrame:
    ev = B.events(spark, sf)
    epoch = F.when(F.col("k") == 0, F.lit(0)).when(F.col("k") > 1, F.unix_seconds(F.col("ts").cast("timestamp")))
    return ev.select("event_id", *[c.alias(n) for n, c in C.epoch_parts(epoch).items()])


@query(
    "make_date_col",
    """SELECT o_orderkey, strftime(try_cast(printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate),
       day(o_orderdate) + o_orderkey % 4) AS DATE), '%Y-%m-%d') AS date FROM orders""",
)
def make_date_col(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    day = F.dayofmonth("o_orderdate") + F.col("o_orderkey") % 4
    return o.select("o_orderkey", C.date_of(F.year("o_orderdate"), F.month("o_orderdate"), day).alias("date"))


@query(
    "project_columns",
    f"WITH {READINGS_SQL} SELECT {', '.join(c if c in ('aqi_index', *schemas.CALENDAR) else f'{R(c)} AS {c}' for c in schemas.READING_COLUMNS)} FROM readings",
)
def project_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tables.project_columns(B.readings(spark, sf))


@query(
    "drop_all_null_columns",
    f"SELECT l_orderkey, l_linenumber, {R('nullif(l_tax, 0)')} AS l_tax, l_returnflag FROM lineitem",
)
def drop_all_null_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    holed = li.select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        "l_returnflag",
        F.nullif("l_linestatus", "l_linestatus").alias("l_void"),
        F.nullif("l_shipdate", "l_shipdate").alias("l_never"),
    )
    return tables.drop_all_null_columns(holed)


@query(
    "model_columns",
    f"WITH {CLEAN_SQL} SELECT station, {', '.join(f'{R(f'max({c})')} AS {c}' for c in DOUBLES)}, {', '.join(f'max({c}) AS {c}' for c in schemas.CALENDAR)} FROM clean GROUP BY station",
)
def model_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which columns are features is read off the schema: no target, no time."""
    r = B.clean_readings(spark, sf)
    features = [c for c in tables.model_columns(r) if c not in KEY]
    return r.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in features])


@query("sub_index", f"SELECT event_id, {B.sub_index_sql('value')} AS sub_index FROM events")
def sub_index(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", C.sub_index("value").alias("sub_index"))


_POLL = ["pm2_5", "pm10", "no2", "o3", "so2", "co"]


@query(
    "sub_index_table",
    f"WITH {READINGS_SQL} "
    + " UNION ALL ".join(
        f"SELECT station, {TS('ts')} AS ts, '{p}' AS pollutant, {R(p)} AS concentration, {B.sub_index_sql(p)} AS sub_index FROM readings"
        for p in _POLL
    ),
)
def sub_index_table(spark: SparkSession, sf: str) -> DataFrame:
    bands = schemas.breakpoint_table(spark, _POLL)
    return airquality.sub_index_by_table(B.readings(spark, sf), bands, ["station", "ts"], _POLL)


@query("calculated_aqi", f'WITH {READINGS_SQL} SELECT station, {TS("ts")} AS ts, {B.CALCULATED_SQL} AS "Calculated_AQI" FROM readings')
def calculated_aqi(spark: SparkSession, sf: str) -> DataFrame:
    return airquality.with_calculated_aqi(B.readings(spark, sf)).select("station", "ts", "Calculated_AQI")


_HOLED = "nullif(value, round(value))"


@query("aqi_category", f"SELECT event_id, {B.category_sql(_HOLED)} AS category FROM events")
def aqi_category(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", C.aqi_category("nullif(value, round(value))").alias("category"))


def _display_sql() -> str:
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in schemas.CATEGORY_DISPLAY)
    return f"display(category, color, bg_color, text_color, description, value_range) AS (VALUES {rows})"


@query(
    "category_display",
    f"""WITH {EVENTS_SQL}, {_display_sql()}, c AS (SELECT event_id, CASE WHEN k = 0 THEN 'Unheard' ELSE {B.category_sql('value')} END AS category FROM ev)
    SELECT c.event_id, c.category, {", ".join(f"coalesce(d.{f}, g.{f}) AS {f}" for f in ("color", "bg_color", "text_color", "description", "value_range"))}
    FROM c LEFT JOIN display d ON c.category = d.category CROSS JOIN (SELECT * FROM display WHERE category = 'Good') g""",
)
def category_display(spark: SparkSession, sf: str) -> DataFrame:
    ev = B.events(spark, sf)
    named = ev.select("event_id", F.when(F.col("k") == 0, "Unheard").otherwise(C.aqi_category("value")).alias("category"))
    return airquality.category_display(named)


@query("round2", f"SELECT event_id, {R('round_even(value / CAST(7 AS DOUBLE) * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE)')} AS value FROM events")
def round2(spark: SparkSession, sf: str) -> DataFrame:
    ev = B.table(spark, sf, "events").select("event_id", (F.col("value") / 7.0).alias("value"))
    return airquality.rounded(ev, ["value"])


@query(
    "format_times",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS datetime, strftime(ts, '%Y-%m-%d') AS date, CAST(date_part('hour', ts) AS INTEGER) AS hour FROM events",
)
def format_times(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in C.time_labels("ts").items()])


_LI_SCALED = ["l_quantity", "l_extendedprice"]


@query(
    "scale_features",
    f"""SELECT l_orderkey, l_linenumber, {", ".join(f"{R(f'({c} - m.a_{c}) / m.s_{c}')} AS scaled_{c}" for c in _LI_SCALED)}
    FROM lineitem CROSS JOIN (SELECT {", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _LI_SCALED)} FROM lineitem) m""",
)
def scale_features(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_LI_SCALED)
    return models.scale_features(li, _LI_SCALED).select("l_orderkey", "l_linenumber", *[f"scaled_{c}" for c in _LI_SCALED])


@query(
    "sql_functions",
    f"SELECT event_id, {B.sub_index_sql('value')} AS sub_index, {B.category_sql('value')} AS category FROM events",
)
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar rules called from SQL text."""
    sqlfuncs.register(spark)
    B.table(spark, sf, "events").createOrReplaceTempView("airframe_events")
    return spark.sql("SELECT event_id, sub_index(value) AS sub_index, aqi_category(value) AS category FROM airframe_events")


# ---------------------------------------------------------------- filters


@query(
    "drop_null_targets",
    f'WITH {READINGS_SQL}, c AS (SELECT *, {B.CALCULATED_SQL} AS "Calculated_AQI" FROM readings) '
    f'SELECT station, {TS("ts")} AS ts, aqi_index, "Calculated_AQI" FROM c WHERE aqi_index IS NOT NULL AND "Calculated_AQI" IS NOT NULL',
)
def drop_null_targets(spark: SparkSession, sf: str) -> DataFrame:
    r = airquality.with_calculated_aqi(B.readings(spark, sf))
    return forecast.drop_null_targets(r).select("station", "ts", "aqi_index", "Calculated_AQI")


@query(
    "recent_baseline",
    """WITH t AS (SELECT o_custkey, o_orderkey,
      CASE WHEN year(o_orderdate) = 1998 AND month(o_orderdate) = 1 THEN 1
           WHEN year(o_orderdate) = 1997 AND month(o_orderdate) = 12 THEN 2
           WHEN month(o_orderdate) = 1 THEN 3 END AS tier FROM orders),
    b AS (SELECT *, min(tier) OVER (PARTITION BY o_custkey) AS best FROM t WHERE tier IS NOT NULL)
    SELECT o_custkey, o_orderkey, tier FROM b WHERE tier = best""",
)
def recent_baseline(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")
    )
    return forecast.recent_baseline(o, ["o_custkey"], 1998, 1).select("o_custkey", "o_orderkey", "tier")


_DAYKEY = f"{D('ts')}"


@query(
    "good_hours",
    f"""WITH {READINGS_SQL}, t AS (SELECT station, {_DAYKEY} AS date, ts, pm10,
       CASE WHEN pm10 <= 50 THEN 1 WHEN pm10 <= 100 THEN 2 END AS tier FROM readings),
    b AS (SELECT *, min(tier) OVER (PARTITION BY station, date) AS best FROM t WHERE tier IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY station, date ORDER BY ts) AS rank FROM b WHERE tier = best)
    SELECT station, date, {TS('ts')} AS ts, {R('pm10')} AS pm10, tier, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def good_hours(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", F.date_format("ts", "yyyy-MM-dd").alias("date"), "ts", "pm10")
    return forecast.good_hours(r, ["station", "date"], "pm10", "ts")


@query(
    "avoid_hours",
    f"""WITH {READINGS_SQL}, r AS (SELECT station, {_DAYKEY} AS date, ts, pm10,
       row_number() OVER (PARTITION BY station, {_DAYKEY} ORDER BY ts) AS rank FROM readings WHERE pm10 > 100)
    SELECT station, date, {TS('ts')} AS ts, {R('pm10')} AS pm10, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def avoid_hours(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", F.date_format("ts", "yyyy-MM-dd").alias("date"), "ts", "pm10")
    return forecast.avoid_hours(r, ["station", "date"], "pm10", "ts")


@query(
    "downsample_steps",
    f"""WITH {READINGS_SQL}, p AS (SELECT station, ts, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS step FROM readings)
    SELECT station, step, {TS('ts')} AS ts FROM p WHERE (step >= 24 AND step < 48 AND (step - 24) % 4 = 0) OR (step >= 48 AND step < 72 AND (step - 48) % 4 = 0)""",
)
def downsample_steps(spark: SparkSession, sf: str) -> DataFrame:
    placed = ordered.positions(B.readings(spark, sf).select("station", "ts"), KEY, ORDER, "step")
    days = [forecast.downsample_steps(placed, "step", a, a + 24, 4) for a in (24, 48)]
    return tables.concat_rows(*days).select("station", "step", "ts")


# ---------------------------------------------------------------- ordered operators


@query(
    "ffill",
    f"""WITH {READINGS_SQL} SELECT station, {TS('ts')} AS ts, {R(B.ffill_sql('wind_direction_10m'))} AS wind_direction_10m,
    {R(B.ffill_sql('co'))} AS co FROM readings {B.WINDOWS_SQL}""",
)
def ffill(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", "ts", "wind_direction_10m", "co")
    return ordered.ffill(r, KEY, ORDER, ["wind_direction_10m", "co"])


_POSED = f"{READINGS_SQL}, posed AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS pos FROM readings)"


@query(
    "interpolate_linear",
    f"WITH {_POSED} SELECT station, {TS('ts')} AS ts, {', '.join(f'{R(B.lerp_sql(c))} AS {c}' for c in ('pm2_5', 'co', 'nh3'))} FROM posed {B.WINDOWS_SQL}",
)
def interpolate_linear(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", "ts", "pm2_5", "co", "nh3")
    return ordered.interpolate_linear(r, KEY, ORDER, ["pm2_5", "co", "nh3"])


@query(
    "zero_then_interpolate",
    f"WITH {CLEAN_SQL} SELECT station, {TS('ts')} AS ts, {', '.join(f'{R(c)} AS {c}' for c in ('shortwave_radiation', 'et0_fao_evapotranspiration', 'precipitation'))} FROM clean",
)
def zero_then_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", "ts", "shortwave_radiation", "et0_fao_evapotranspiration", "precipitation")
    return ordered.zero_then_interpolate(r, KEY, ORDER)


@query(
    "impute_readings",
    f"WITH {CLEAN_SQL} SELECT station, {TS('ts')} AS ts, {', '.join(f'{R(c)} AS {c}' for c in ['aqi_index', *DOUBLES])}, year, month, day, hour, \"Calculated_AQI\" FROM clean",
)
def impute_readings(spark: SparkSession, sf: str) -> DataFrame:
    return B.clean_readings(spark, sf)


_WALKED = ["temperature_2m", "surface_pressure"]


@query(
    "multiplicative_walk",
    f"""WITH {READINGS_SQL}, s AS (SELECT station, CAST(row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS BIGINT) AS step,
       {", ".join(f"coalesce({c}, CAST(1 AS DOUBLE)) AS {c}" for c in _WALKED)} FROM readings)
    SELECT station, step, {", ".join(
        R(f"first_value({c}) OVER w * exp(sum(CASE WHEN step > 0 THEN ln(1 + {B.noise_sql("42", "station", f"'{c}'", "step")} * CAST(0.06 AS DOUBLE) - CAST(0.03 AS DOUBLE)) ELSE 0 END) OVER w)") + f" AS {c}" for c in _WALKED)}
    FROM s WINDOW w AS (PARTITION BY station ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def multiplicative_walk(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", "ts", *_WALKED)
    stepped = ordered.positions(r, KEY, ORDER, "step").select("station", "step", *[F.coalesce(c, F.lit(1.0)).alias(c) for c in _WALKED])
    return ordered.multiplicative_walk(stepped, KEY, "step", _WALKED, bucket_steps=100)


@query(
    "positional_split",
    f"""WITH {READINGS_SQL}, p AS (SELECT station, ts, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY station) AS n FROM readings)
    SELECT station, {TS('ts')} AS ts, CASE WHEN p < floor(CAST(n AS DOUBLE) * CAST(0.8 AS DOUBLE)) THEN 'reference' ELSE 'current' END AS side FROM p""",
)
def positional_split(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.positional_split(B.readings(spark, sf).select("station", "ts"), KEY, ORDER)


@query(
    "contiguous_folds",
    f"WITH {READINGS_SQL} SELECT station, {TS('ts')} AS ts, CAST(ntile(5) OVER (PARTITION BY station ORDER BY ts) - 1 AS INTEGER) AS fold FROM readings",
)
def contiguous_folds(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.contiguous_folds(B.readings(spark, sf).select("station", "ts"), KEY, ORDER)


@query(
    "hour_spine",
    f"""WITH {READINGS_SQL}, o AS (SELECT station, max(ts) AS t FROM readings GROUP BY station),
    s AS (SELECT station, CAST(g.step AS INTEGER) AS step, t + INTERVAL 1 HOUR + to_hours(CAST(g.step AS INTEGER)) AS ts FROM o CROSS JOIN (SELECT unnest(generate_series(0, 71)) AS step) g)
    SELECT station, step, {TS('ts')} AS ts, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM s""",
)
def hour_spine(spark: SparkSession, sf: str) -> DataFrame:
    origins = B.readings(spark, sf).groupBy("station").agg(F.max("ts").alias("origin"))
    return ordered.hour_spine(origins, "origin", 72, keep=KEY)


# ---------------------------------------------------------------- aggregates and joins

_FEATURES = [*schemas.POLLUTANTS, *schemas.WEATHER]
_PATTERN_SQL = f"""{READINGS_SQL},
spine AS (SELECT DISTINCT station, h.hour FROM readings CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS hour) h),
overall AS (SELECT station, {", ".join(f"avg({f}) AS {f}" for f in _FEATURES)} FROM readings GROUP BY station),
byhour AS (SELECT station, hour, {", ".join(f"avg({f}) AS {f}" for f in _FEATURES)} FROM readings GROUP BY station, hour),
pattern AS (SELECT s.station, CAST(s.hour AS INTEGER) AS hour, {", ".join(f"CASE WHEN b.hour IS NULL THEN g.{f} ELSE b.{f} END AS {f}" for f in _FEATURES)}
  FROM spine s JOIN overall g USING (station) LEFT JOIN byhour b ON b.station = s.station AND b.hour = s.hour)"""


@query("hourly_pattern", f"WITH {_PATTERN_SQL} SELECT station, hour, {', '.join(f'{R(f)} AS {f}' for f in _FEATURES)} FROM pattern")
def hourly_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.hourly_pattern(B.readings(spark, sf), KEY, _FEATURES)


@query(
    "hour_pattern_join",
    f"""WITH {_PATTERN_SQL}, o AS (SELECT station, max(ts) AS t FROM readings GROUP BY station),
    fut AS (SELECT station, t + INTERVAL 1 HOUR + to_hours(CAST(g.step AS INTEGER)) AS ts FROM o CROSS JOIN (SELECT unnest(generate_series(0, 71)) AS step) g)
    SELECT f.station, {TS('f.ts')} AS ts, {', '.join(f'{R(f"p.{f}")} AS {f}' for f in _FEATURES)} FROM fut f LEFT JOIN pattern p ON p.station = f.station AND p.hour = hour(f.ts)""",
)
def hour_pattern_join(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf)
    future = ordered.hour_spine(r.groupBy("station").agg(F.max("ts").alias("origin")), "origin", 72, keep=KEY)
    return forecast.hour_pattern_join(future, forecast.hourly_pattern(r, KEY, _FEATURES), KEY).select("station", "ts", *_FEATURES)


_DAILY_VALUES = ["pm2_5", "pm10"]

#: Values in quarters add up exactly in any order, so that a mean on a rounding tie is the same everywhere.
_QUARTERS = ", ".join(f"floor({v} * 4) / CAST(4 AS DOUBLE) AS {v}" for v in _DAILY_VALUES)


def _quarters(df: DataFrame) -> DataFrame:
    return df.withColumns({v: F.floor(F.col(v) * 4) / 4.0 for v in _DAILY_VALUES})


def _round2_sql(x: str) -> str:
    return f"(round_even({x} * CAST(100 AS DOUBLE), 0) / CAST(100 AS DOUBLE))"


@query(
    "daily_minmaxmean",
    f"""WITH {CLEAN_SQL} SELECT station, {D('ts')} AS date, {", ".join(f"{R(_round2_sql(f'{n[0]}({v})'))} AS {n[1]}_{v}" for v in _DAILY_VALUES for n in (("min", "min"), ("max", "max"), ("avg", "mean")))}
    FROM (SELECT station, ts, {_QUARTERS} FROM clean) GROUP BY station, {D('ts')}""",
)
def daily_minmaxmean(spark: SparkSession, sf: str) -> DataFrame:
    r = _quarters(B.clean_readings(spark, sf)).withColumn("date", F.to_date("ts"))
    return forecast.daily_minmaxmean(r, KEY, "date", _DAILY_VALUES)


@query(
    "daily_aqi",
    f"""WITH {CLEAN_SQL}, d AS (SELECT station, {D('ts')} AS date, min("Calculated_AQI") AS lo, max("Calculated_AQI") AS hi, {_round2_sql('avg("Calculated_AQI")')} AS mean, count(*) AS hours
    FROM clean GROUP BY station, {D('ts')}) SELECT station, date, lo AS min_aqi, hi AS max_aqi, {R('mean')} AS mean_aqi, hours, {B.category_sql('mean')} AS category FROM d""",
)
def daily_aqi(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps filled, index computed, days summarised and categorised: the flagship query."""
    r = B.clean_readings(spark, sf)
    daily = r.groupBy("station", F.to_date("ts").alias("date")).agg(
        F.min("Calculated_AQI").alias("min_aqi"),
        F.max("Calculated_AQI").alias("max_aqi"),
        C.round_even(F.avg("Calculated_AQI")).alias("mean_aqi"),
        F.count(F.lit(1)).alias("hours"),
    )
    return daily.withColumn("category", C.aqi_category("mean_aqi"))


def _summary_sql(src: str, key: str) -> str:
    return f"""first AS (SELECT {key}, min(CAST(ts AS DATE)) AS d0 FROM {src} GROUP BY {key}),
    spine AS (SELECT {key}, CAST(d0 + to_days(CAST(g.i AS INTEGER)) AS DATE) AS date FROM first CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS i) g),
    daily AS (SELECT {key}, CAST(ts AS DATE) AS date, min(a) AS min_a, max(a) AS max_a, {_round2_sql('avg(a)')} AS mean_a, min(b) AS min_b, max(b) AS max_b, {_round2_sql('avg(b)')} AS mean_b FROM {src} GROUP BY {key}, CAST(ts AS DATE))"""


@query(
    "daily_summary",
    f"""WITH src AS (SELECT o_custkey, o_orderdate AS ts, floor(o_totalprice / 250) / CAST(4 AS DOUBLE) AS a, floor(o_totalprice / 500) / CAST(2 AS DOUBLE) AS b FROM orders),
    {_summary_sql('src', 'o_custkey')}
    SELECT s.o_custkey, {D('s.date')} AS date, {R('min_a')} AS min_aqi_index, {R('max_a')} AS max_aqi_index, {R('mean_a')} AS mean_aqi_index,
      {R('min_b')} AS min_calculated_aqi, {R('max_b')} AS max_calculated_aqi, {R('mean_b')} AS mean_calculated_aqi, {B.category_sql('mean_a')} AS aqi_category
    FROM spine s LEFT JOIN daily d ON d.o_custkey = s.o_custkey AND d.date = s.date""",
)
def daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse series: most dates of the spine have no rows and stay empty."""
    o = B.table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderdate").alias("ts"), (F.floor(F.col("o_totalprice") / 250) / 4.0).alias("a"), (F.floor(F.col("o_totalprice") / 500) / 2.0).alias("b")
    )
    return forecast.daily_summary(o, ["o_custkey"], "ts", "a", "b", 7)


@query(
    "date_spine_join",
    f"""WITH {READINGS_SQL}, src AS (SELECT station, ts, pm10 AS a, pm10 AS b FROM readings), {_summary_sql('src', 'station')}
    SELECT s.station, {D('s.date')} AS date, {R('min_a')} AS low, {R('max_a')} AS high FROM spine s LEFT JOIN daily d ON d.station = s.station AND d.date = s.date""",
)
def date_spine_join(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf).select("station", F.to_date("ts").alias("date"), "pm10")
    daily = r.groupBy("station", "date").agg(F.min("pm10").alias("low"), F.max("pm10").alias("high"))
    return forecast.date_spine_join(r, KEY, "date", 7, daily)


@query(
    "forecast_stats",
    f"""WITH {CLEAN_SQL} SELECT station, {", ".join(f"{R(_round2_sql(f'{fn}({v})'))} AS {n}_{v}" for v in _DAILY_VALUES for n, fn in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_pop")))}
    FROM (SELECT station, {_QUARTERS} FROM clean) GROUP BY station""",
)
def forecast_stats(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.forecast_stats(_quarters(B.clean_readings(spark, sf)), KEY, _DAILY_VALUES)


@query(
    "forecast_insights",
    f"""WITH {CLEAN_SQL}, r AS (SELECT station, ts, {_round2_sql('pm2_5')} AS v FROM clean),
    a AS (SELECT station, avg(v) AS mean, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM r GROUP BY station)
    SELECT a.station, {R('mean')} AS mean, {R('lo')} AS min, {R('hi')} AS max, {R('sd')} AS std,
      (SELECT {TS('min(ts)')} FROM r WHERE r.station = a.station AND v = lo) AS min_at, (SELECT {TS('min(ts)')} FROM r WHERE r.station = a.station AND v = hi) AS max_at FROM a""",
)
def forecast_insights(spark: SparkSession, sf: str) -> DataFrame:
    r = airquality.rounded(B.clean_readings(spark, sf), ["pm2_5"])
    return forecast.forecast_insights(r, KEY, "pm2_5", "ts")


@query(
    "category_breakdown",
    f"""WITH {CLEAN_SQL}, c AS (SELECT {B.category_sql('"Calculated_AQI"')} AS category FROM clean)
    SELECT category, count(*) AS n, {R('count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM c)')} AS pct FROM c GROUP BY category""",
)
def category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    r = B.clean_readings(spark, sf).select(C.aqi_category("Calculated_AQI").alias("category"))
    return tables.category_breakdown(r, "category")


# ---------------------------------------------------------------- tables

_HOLES = {
    "o_custkey": "nullif(o_custkey % 7, 0)",
    "o_orderstatus": "nullif(o_orderstatus, 'P')",
    "o_totalprice": "CASE WHEN o_totalprice > 100000 THEN o_totalprice END",
    "o_orderpriority": "nullif(nullif(o_orderpriority, '5-LOW'), '2-HIGH')",
}


@query(
    "null_summary",
    "WITH h AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in _HOLES.items()) + " FROM orders) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM h" for c in ["o_orderkey", *_HOLES]),
)
def null_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders")
    return tables.null_summary(o.select("o_orderkey", *[F.expr(e).alias(c) for c, e in _HOLES.items()]))


_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(c: str) -> str:
    quarts = ", ".join(f"{R(f'quantile_cont(CAST({c} AS DOUBLE), {q})')} AS {n}" for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, {R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, "
        f"{R(f'min({c})')} AS min, {quarts}, {R(f'max({c})')} AS max FROM lineitem"
    )


@query("describe_table", " UNION ALL ".join(_describe_sql(c) for c in _NUM))
def describe_table(spark: SparkSession, sf: str) -> DataFrame:
    return tables.describe_table(B.table(spark, sf, "lineitem"), _NUM)


_SUMMED = ["o_totalprice", "o_custkey", "o_orderkey"]


def _data_summary_sql(c: str) -> str:
    quarts = ", ".join(f"{R(f'quantile_cont(CAST({c} AS DOUBLE), {q})')} AS {n}" for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", "
        f"(SELECT {R(c)} FROM h WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common, "
        f"(SELECT count(*) FROM h WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS most_common_count, "
        f"{R(f'avg({c})')} AS mean, {R(f'stddev_samp({c})')} AS std, {R(f'min({c})')} AS min, {quarts}, {R(f'max({c})')} AS max FROM h"
    )


@query(
    "data_summary",
    "WITH h AS (SELECT CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS o_totalprice, o_custkey, o_orderkey FROM orders) "
    + " UNION ALL ".join(_data_summary_sql(c) for c in _SUMMED),
)
def data_summary(spark: SparkSession, sf: str) -> DataFrame:
    o = B.table(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")))
    return tables.data_summary(o.select(*_SUMMED), _SUMMED)


@query(
    "concat_rows",
    f"""WITH {READINGS_SQL} SELECT station, {TS('ts')} AS ts, {R('pm10')} AS pm10, {R('no2')} AS no2 FROM readings WHERE day <= 15
    UNION ALL SELECT station, {TS('ts')} AS ts, {R('pm10')} AS pm10, NULL AS no2 FROM readings WHERE day > 15""",
)
def concat_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf)
    old = r.filter(F.col("day") <= 15).select("station", "ts", "pm10", "no2")
    new = r.filter(F.col("day") > 15).select("pm10", "ts", "station")
    return tables.concat_rows(old, new)


@query(
    "dedup_rows",
    "SELECT DISTINCT l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem",
)
def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = B.table(spark, sf, "lineitem")
    return tables.dedup_rows(
        li.select("l_returnflag", F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"), "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    )


@query(
    "required_columns",
    f"""WITH {READINGS_SQL}, m AS (SELECT avg(temperature_2m) AS t, avg(surface_pressure) AS s FROM readings)
    SELECT station, hour, {R('pm10')} AS pm10, {R('m.t')} AS temperature_2m, {R('m.s')} AS surface_pressure FROM readings CROSS JOIN m""",
)
def required_columns(spark: SparkSession, sf: str) -> DataFrame:
    r = B.readings(spark, sf)
    partial = r.select("station", "hour", "pm10")
    return tables.required_columns(partial, r, ["station", "hour", "pm10", "temperature_2m", "surface_pressure"])


_BRAND = "SELECT p_brand AS feature, avg(p_retailprice) AS a, CAST(sum(p_size) AS DOUBLE) AS b FROM part GROUP BY p_brand"


@query(
    "importance_compare",
    f"SELECT feature, {R('a')} AS first_importance, {R('b')} AS second_importance FROM ({_BRAND}) ORDER BY b DESC, feature LIMIT 15",
)
def importance_compare(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature"))
    first = p.agg(F.avg("p_retailprice").alias("importance"))
    second = p.agg(F.sum("p_size").cast("double").alias("importance"))
    return models.importance_compare(first, second)


@query(
    "top_features",
    f"""WITH f AS ({_BRAND}) SELECT * FROM (SELECT 'top5' AS part, feature, {R('a')} AS importance FROM f ORDER BY a DESC, feature LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'bottom2' AS part, feature, {R('a')} AS importance FROM f ORDER BY a, feature LIMIT 2)""",
)
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    f = B.table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    best = tables.top_by(f, "importance", 5, tie="feature").select(F.lit("top5").alias("part"), "*")
    return best.unionByName(tables.top_by(f, "importance", 2, ascending=True, tie="feature").select(F.lit("bottom2").alias("part"), "*"))


@query(
    "head_tail",
    f"""SELECT * FROM (SELECT event_id, {TS('ts')} AS ts, 'head' AS part FROM events ORDER BY events.ts, event_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT event_id, {TS('ts')} AS ts, 'tail' AS part FROM events ORDER BY events.ts DESC, event_id DESC LIMIT 5)""",
)
def head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return tables.head_tail(B.table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"])
