"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Every source is cut into blocks. With a share of ``q`` of ``period`` slots, block ``j`` of a source is released
in slot ``floor(j * period / q)`` and due before slot ``ceil((j + 1) * period / q)``; each slot goes to the
released block with the earliest deadline. As the shares add up to the period, every deadline is met, so after any
number of slots each source is less than one block away from its target. The schedule repeats after a period;
one period is worked out by a fold, and a row finds its slot from the number of its block.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airframe.llm.common import query, table

#: Slots of a period to share out (at least one for each source on top), rows of a block.
RESOLUTION, BLOCK_ROWS = 1000, 16
#: Hex digits of the id's digest that cut a source into groups for numbering its rows.
DIGITS = 4

#: The earliest deadline among released blocks; ties go to the source that comes first.
PICK = """array_min(filter(transform(q, (x, i) -> IF(s.done[i] * period div x <= t,
    named_struct('due', ((s.done[i] + 1) * period + x - 1) div x, 'i', i), NULL)), c -> c IS NOT NULL)).i"""
FOLD = f"""aggregate(sequence(0L, period - 1),
    named_struct('done', array_repeat(0L, size(q)), 'picks', CAST(array() AS array<int>)),
    (s, t) -> named_struct('done', transform(s.done, (d, i) -> d + IF(i = {PICK}, 1L, 0L)), 'picks', array_append(s.picks, {PICK})),
    s -> s.picks)"""


def schedule(weights: DataFrame, resolution: int | None = RESOLUTION) -> DataFrame:
    """``(source_key, share, period, turn, slot)``: in which slots of a period a source has its turns.

    ``weights`` has ``source_key`` and a whole ``weight`` of 0 or more; a source gets its part of ``resolution``
    slots, rounded down, and at least one. None stands for the first multiple of the sum of the weights that is not
    below ``RESOLUTION``, at which nothing is rounded. The result has a row for each slot of one period, whatever the size of the data.
    """
    total = F.greatest(F.sum("weight").over(Window.partitionBy()), F.lit(1))
    slots = F.lit(resolution) if resolution is not None else total * F.ceil(F.lit(RESOLUTION) / total)
    shares = weights.select("source_key", F.greatest(F.lit(1), F.floor(F.col("weight") * slots / total)).cast("long").alias("share"))
    row = shares.agg(F.array_sort(F.collect_list(F.struct("source_key", "share"))).alias("sources"), F.sum("share").alias("period"))
    row = row.where("period > 0").withColumn("q", F.expr("sources.share"))
    turns = row.select("sources", "period", F.posexplode(F.expr(FOLD)).alias("slot", "i"))
    turns = turns.select(F.expr("sources[i].source_key").alias("source_key"), F.expr("sources[i].share").alias("share"), "period", F.col("slot").cast("long").alias("slot"))
    return turns.withColumn("turn", F.row_number().over(Window.partitionBy("source_key").orderBy("slot")) - F.lit(1))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``number``, gapless from 0 in each source, in the order of the digest of the id.

    A source is cut into groups by the head of the digest, so that no source is sorted in one task: rows are
    numbered inside a group, and the groups' counts give the first number of each.
    """
    rows = rows.withColumn("digest", F.md5(F.coalesce(F.col("mix_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("part", F.substring("digest", 1, DIGITS))
    counts = rows.groupBy("source_key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source_key", "part").orderBy("digest", "mix_id", "tie")
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["source_key", "part"])
    return rows.withColumn("number", F.col("first") + F.col("rank")).drop("digest", "part", "rank", "first", "tie")


def weights_of(rows: DataFrame, weights: dict | None) -> DataFrame:
    """Whole weights per source key: the given ones, in the same proportion, or the root of the source's rows (small
    sources gain)."""
    counts = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        return counts.select("source_key", F.floor(F.sqrt("n")).cast("long").alias("weight"))
    given = [f"WHEN source_key = {quoted(key_text(k))} THEN {w}L" for k, w in whole(weights).items()]
    return counts.select("source_key", F.expr(f"CASE {' '.join(given)} ELSE 0L END" if given else "0L").alias("weight"))


def whole(weights: dict) -> dict:
    """The weights as the smallest whole numbers in the same proportion; fractions count as they are written."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    unit = lcm(*(w.denominator for w in exact.values()))
    parts = {k: int(w * unit) for k, w in exact.items()}
    common = gcd(*parts.values()) or 1
    return {k: n // common for k, n in parts.items()}


def key_text(source) -> str:
    return "-" if source is None else f"+{source}"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def mix(docs: DataFrame, id="doc_id", source="source", weights: dict | None = None, resolution: int | None = None, block_rows=BLOCK_ROWS) -> DataFrame:
    """All rows of ``docs`` with ``block``, ``slot`` and ``offset``; ordered by slot and offset they are the mixture.

    Every row comes exactly once. While all sources last, each is less than one block off its weight after any
    slot; the slots of a source that has run out stay empty, so the others go on in the proportion of their weights.
    Given weights, fractions too, are met exactly unless a ``resolution`` rounds them; without any the roots are rounded
    to ``RESOLUTION`` slots, as in the SQL twin.
    Sources without a given weight, and weights of 0, get one slot a period. NULL is a source of its own, NULL ids
    come as one. The rows of a source come in the order of the md5 of their id; repeated rows stay, and which of
    them comes first doesn't matter. An empty table gives no rows. Columns of ``docs`` named like the new ones are
    replaced.
    """
    clash = {"block", "slot", "offset"}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in clash]
    names = [docs.columns[i] for i in kept]
    place = {"mix_id": at_kept(names, id), "source_key": at_kept(names, source)}
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]).select(*[F.col(f"_{i}").alias(f"c{k}") for k, i in enumerate(kept)])
    key = F.col(f"c{place['source_key']}").cast("string")
    rows = plain.withColumn("mix_id", F.col(f"c{place['mix_id']}")).withColumn("source_key", F.when(key.isNull(), "-").otherwise(F.concat(F.lit("+"), key)))
    rows = rows.withColumn("tie", F.xxhash64(*[F.col(f"c{k}") for k in range(len(kept))]))
    turns = schedule(weights_of(rows, weights), RESOLUTION if resolution is None and weights is None else resolution)
    lengths = turns.select("source_key", "share", "period").distinct()
    placed = numbered(rows).withColumn("block", F.expr(f"number div {block_rows}")).withColumn("offset", F.col("number") % block_rows)
    placed = placed.join(lengths, "source_key").withColumn("turn", F.col("block") % F.col("share"))
    placed = placed.join(turns.select("source_key", "turn", F.col("slot").alias("at")), ["source_key", "turn"])
    placed = placed.withColumn("slot", F.expr("block div share * period") + F.col("at"))
    return placed.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)], "block", "slot", "offset")


def at_kept(names: list[str], name: str) -> int:
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture as one sorted table, without the scheduling columns."""
    return mixed.orderBy("slot", "offset").drop("block", "slot", "offset")


SQL = f"""
WITH RECURSIVE n AS (SELECT CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT k, greatest(1, floor(floor(sqrt(n)) * {RESOLUTION} / (SELECT sum(floor(sqrt(n))) FROM n)))::BIGINT AS q FROM n),
a AS (SELECT list(k ORDER BY k) AS ks, list(q ORDER BY k) AS q, sum(q)::BIGINT AS p FROM w),
r AS (SELECT 0::BIGINT AS t, list_transform(q, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, ks, q, p FROM a
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, i: d + CASE WHEN i = pick THEN 1 ELSE 0 END), pick, ks, q, p FROM (
    SELECT t, done, ks, q, p, list_min(list_filter(list_transform(q, lambda x, i:
      CASE WHEN done[i] * p // x <= t THEN ((done[i] + 1) * p + x - 1) // x * 1000000 + i END), lambda c: c IS NOT NULL)) % 1000000 AS pick
    FROM r WHERE t < p)),
s AS (SELECT ks[pick] AS k, q[pick] AS q, p, t - 1 AS place, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM r WHERE t > 0),
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k,
        row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS number FROM documents)
SELECT doc_id, source, number // {BLOCK_ROWS} AS block, number // {BLOCK_ROWS} // q * p + place AS slot, number % {BLOCK_ROWS} AS "offset"
FROM d JOIN s ON d.k = s.k AND s.turn = number // {BLOCK_ROWS} % s.q
"""


@query("op3_mixing", SQL)
def op3_mixing(spark, sf):
    return mix(table(spark, sf, "documents").select("doc_id", "source"))
