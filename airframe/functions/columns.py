"""Scalar expressions. Every function takes and returns Columns and stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from airframe import schemas


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub_index_text(value: str, bands=None) -> str:
    """SQL text of the piecewise-linear index. Text, because a chain over all bands and pollutants is
    some hundred Column calls, and one parsed expression costs the driver a fraction of that."""
    v = f"CAST({value} AS DOUBLE)"
    arms = " ".join(
        f"WHEN {v} BETWEEN {float(c_low)!r}D AND {float(c_high)!r}D "
        f"THEN bround({(i_high - i_low) / (c_high - c_low)!r}D * ({v} - {float(c_low)!r}D) + {float(i_low)!r}D)"
        for c_low, c_high, i_low, i_high in (bands or schemas.BREAKPOINTS)
    )
    return f"CAST(CASE {arms} END AS INT)"


def sub_index(value: str, bands=None) -> Column:
    """Piecewise-linear index of the first band holding the value, half-to-even; NULL in the gaps.

    ``value`` is a column name or SQL expression.
    """
    return F.expr(sub_index_text(value, bands))


def calculated_aqi(columns: dict[str, str] | None = None, bands: dict[str, list] | None = None) -> Column:
    """Largest available sub-index; NULL when no pollutant has one. ``columns``: pollutant → column."""
    columns = columns or {p: p for p in schemas.INDEXED_POLLUTANTS}
    parts = [sub_index_text(c, (bands or {}).get(p)) for p, c in columns.items()]
    return F.expr(f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0])


def aqi_category_text(value: str) -> str:
    v = f"CAST({value} AS DOUBLE)"
    arms = " ".join(f"WHEN {v} <= {float(b)!r}D THEN '{n}'" for b, n in schemas.CATEGORY_BOUNDS[:-1])
    return f"CASE WHEN {v} IS NULL OR isnan({v}) THEN NULL {arms} ELSE '{schemas.CATEGORY_BOUNDS[-1][1]}' END"


def aqi_category(value: str) -> Column:
    """Six-way banding; missing values have no category."""
    return F.expr(aqi_category_text(value))


def round_even(value: Column | str, places: int = 2) -> Column:
    """Scale, round half-to-even, scale back: the rounding numeric array libraries use."""
    factor = float(10**places)
    return F.rint(as_col(value).cast("double") * F.lit(factor)) / F.lit(factor)


def epoch_to_ts(epoch: Column | str) -> Column:
    """UTC wall-clock time of epoch seconds; NULL and 0 mean unknown."""
    e = as_col(epoch).cast("long")
    return F.when(e != 0, F.to_timestamp_ntz(F.date_format(F.timestamp_seconds(e), "yyyy-MM-dd HH:mm:ss")))


def epoch_parts(epoch: Column | str) -> dict[str, Column]:
    e = as_col(epoch).cast("long")
    ts = F.when(e != 0, F.timestamp_seconds(e))
    return {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}


def date_of(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """Calendar date of three parts; impossible dates become NULL instead of failing the job."""
    text = F.format_string("%04d-%02d-%02d", as_col(year).cast("int"), as_col(month).cast("int"), as_col(day).cast("int"))
    parts = as_col(year).isNotNull() & as_col(month).isNotNull() & as_col(day).isNotNull()
    return F.when(parts, F.try_to_date(text, "yyyy-MM-dd"))


def time_labels(ts: Column | str) -> dict[str, Column]:
    ts = as_col(ts)
    return {
        "datetime": F.date_format(ts, "yyyy-MM-dd HH:mm"),
        "date": F.date_format(ts, "yyyy-MM-dd"),
        "hour": F.hour(ts),
    }


def duration_ms(seconds: Column | str) -> Column:
    return round_even(as_col(seconds) * F.lit(1000.0), 2)


def token_split(total: Column | str) -> dict[str, Column]:
    """70 % of the tokens (rounded down) count as input, the rest as output."""
    total = as_col(total).cast("long")
    tokens_in = F.floor(total.cast("double") * F.lit(0.7)).cast("long")
    return {"input_tokens": tokens_in, "output_tokens": total - tokens_in}


def token_cost(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    million = F.lit(1_000_000.0)
    return as_col(tokens_in) / million * as_col(price_in) + as_col(tokens_out) / million * as_col(price_out)


def flatten_observation(aqi: Column | str = "aqi", weather: Column | str = "weather") -> list[Column]:
    """Nested provider answer to the flat reading columns; whatever is absent is NULL."""
    aqi, weather = as_col(aqi), as_col(weather)
    first = F.get(aqi["list"], F.lit(0))
    cols = [first["main"]["aqi"].alias("aqi_index")]
    cols += [first["components"][p].alias(p) for p in schemas.POLLUTANTS]
    cols += [weather[w].alias(w) for w in schemas.WEATHER[:6]]
    cols += [weather["cloudcover"].alias("cloud_cover")]
    cols += [weather[w].alias(w) for w in schemas.WEATHER[6:]]
    cols += [c.alias(n) for n, c in epoch_parts(first["dt"]).items()]
    return cols


def render_prompt(template: Column | str, aqi_value: Column | str, aqi_category_: Column | str) -> Column:
    """Fill the two placeholders, then turn doubled braces into single ones.

    Doubled braces are set aside first so that a filled-in value can never be mistaken for one.
    """
    open_mark, close_mark = "\u0001", "\u0002"
    t = F.replace(F.replace(as_col(template), F.lit("{{"), F.lit(open_mark)), F.lit("}}"), F.lit(close_mark))
    t = F.replace(t, F.lit("{aqi_value}"), as_col(aqi_value).cast("string"))
    t = F.replace(t, F.lit("{aqi_category}"), as_col(aqi_category_))
    return F.replace(F.replace(t, F.lit(open_mark), F.lit("{")), F.lit(close_mark), F.lit("}"))


# The characters that count as white space (``trim`` alone only knows the space).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column | str) -> Column:
    """Remove all white space at both ends."""
    return F.btrim(as_col(text), F.lit(WHITE_SPACE))


def fenced_text(response: Column | str) -> Column:
    """Text inside the first json fence, else the first plain fence, else the whole answer."""
    t = strip(as_col(response))
    after = F.when(F.contains(t, F.lit("```json")), _after(t, "```json")).when(
        F.contains(t, F.lit("```")), _after(t, "```")
    )
    return F.when(after.isNull(), t).otherwise(strip(F.substring_index(after, "```", 1)))


def _after(text: Column, mark: str) -> Column:
    return F.substring(text, F.instr(text, mark) + F.lit(len(mark)), F.length(text))


def parse_answer(response: Column | str) -> Column:
    """Struct of the answer fields with defaults, plus ``parse_error`` when the text is no JSON object."""
    body = fenced_text(response)
    parsed = F.from_json(body, schemas.ANSWER, {"mode": "PERMISSIVE"})
    kind = F.try_parse_json(body)
    bad = kind.isNull() | ~F.coalesce(F.substring(F.schema_of_variant(kind), 1, 6) == "OBJECT", F.lit(False))
    return F.struct(
        F.when(~bad, F.coalesce(parsed["answer"], F.lit(""))).alias("answer"),
        F.when(~bad, F.coalesce(parsed["sources_used"], F.array().cast("array<string>"))).alias("sources_used"),
        F.when(~bad, F.coalesce(parsed["confidence"], F.lit("unknown"))).alias("confidence"),
        bad.alias("parse_error"),
    )


def parse_evaluation(response: Column | str) -> Column:
    """Struct of the evaluated fields, and ``parse_error`` when the text is no JSON object; absent fields are empty."""
    body = fenced_text(response)
    parsed = F.from_json(body, schemas.EVALUATED, {"mode": "PERMISSIVE"})
    kind = F.try_parse_json(body)
    bad = kind.isNull() | ~F.coalesce(F.substring(F.schema_of_variant(kind), 1, 6) == "OBJECT", F.lit(False))
    return F.struct(
        F.when(~bad, F.coalesce(parsed["summary"], F.lit(""))).alias("summary"),
        F.when(~bad, F.coalesce(parsed["precautions"], F.array().cast("array<string>"))).alias("precautions"),
        bad.alias("parse_error"),
    )


def squared_distance(a: Column | str, b: Column | str) -> Column:
    def add(acc, x):
        return acc + x

    diffs = F.zip_with(as_col(a), as_col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), add)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 when either is empty, absent or of zero length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    a, b = as_col(a), as_col(b)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def unit_noise(*parts: Column | str) -> Column:
    """Deterministic number in [0, 1) from the parts, the same on every run and every partitioning."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, flags)


def labels_where(pairs: list[tuple[Column, Column]]) -> Column:
    """Array of the labels whose flag holds, in the given order."""
    return F.array_compact(F.array(*[F.when(flag, label) for flag, label in pairs]))
