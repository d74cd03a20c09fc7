"""Contiguous shards of near-equal bytes, in DataFrame and SQL functions only.

Rows are ordered by key in range partitions. Each partition's total gives the bytes before it, a running sum
inside the partition the bytes before a row; the line of all bytes is cut at equal targets, and a row goes to the
shard in which its middle lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airframe.llm.common import partitions, pick, query, stored, table

SHARDS = 40
#: Bytes that every row counts besides its text.
OVERHEAD = 16


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def lines_up(keyed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in range partitions of ``order``, written with the number of their partition.

    The order ends in all columns, so only rows that are equal in everything tie, and these can be exchanged.
    """
    ends = [*order, *[c for c in keyed.columns if c not in order]]
    return stored(keyed.repartitionByRange(partitions(keyed.sparkSession), *ends).withColumn("part", F.spark_partition_id()), "line")


def placed(keyed: DataFrame, order: Sequence[str], shards: int = SHARDS) -> DataFrame:
    """``keyed`` (with ``size``) plus ``shard`` and ``slot``, which counts from 0 in each shard along the order.

    Only keys and sizes are moved, never texts. Partition totals are one row for each partition, shard starts
    one row for each shard.
    """
    line = lines_up(keyed, order)
    ends = [*order, *[c for c in keyed.columns if c not in order]]
    totals = line.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    totals = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(whole).alias("total")
    )
    running = Window.partitionBy("part").orderBy(*ends).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = line.withColumn("upto", F.sum("size").over(running)).withColumn("rank", F.row_number().over(running)).join(totals, "part")
    middle = F.expr("CAST(2 * (bytes_before + upto) - size AS DECIMAL(38,0))")
    rows = rows.withColumn("shard", F.floor(middle * shards / (2 * F.col("total"))).cast("int"))
    rows = rows.withColumn("index", F.col("rows_before") + F.col("rank") - 1)
    starts = rows.groupBy("shard").agg(F.min("index").alias("start"))
    return rows.join(starts, "shard").withColumn("slot", F.col("index") - F.col("start")).select(*keyed.columns, "shard", "slot", "index")


def shard_keys(docs: DataFrame, id="doc_id", text="text", shards=SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per row, shards contiguous in the order of the id.

    A NULL text has no bytes and the checksum of none; NULL ids come first; rows with one id come by checksum.
    Repeated rows are placed one by one. A text larger than a shard's target leaves shards empty. An empty table
    gives no rows.
    """
    rows = pick(docs, doc_id=id, text=text)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = rows.select("doc_id", row_size(F.col("text")).alias("size"), F.crc32(body).alias("text_crc32"))
    return placed(keyed, ["doc_id", "text_crc32"], shards).drop("index")


def cuts(keyed: DataFrame, order: Sequence[str], shards: int = SHARDS) -> list:
    """First key of each shard but the first: a row for each shard reaches the driver."""
    key = F.struct(*order)
    first = placed(keyed, order, shards).groupBy("shard").agg(F.min(key).alias("key"))
    return [tuple(r.key) for r in first.orderBy("shard").collect()][1:]


def with_shard(docs: DataFrame, order: dict[str, Column], text="text", shards=SHARDS) -> DataFrame:
    """``docs``, all columns, with ``shard``: numbers in line with the given unique order, texts stay where they are.

    Keys and sizes alone are sorted to find where the shards begin; the rows are then numbered by comparing their
    key with these few cuts. Shards are numbered without gaps. A column named ``shard`` is replaced.
    """
    keyed = docs.select(*[c.alias(k) for k, c in order.items()], row_size(F.col(text)).alias("size"))
    starts = cuts(keyed, list(order), shards)
    types = {f.name: f.dataType.simpleString() for f in keyed.schema}
    key = F.struct(*[c.alias(k) for k, c in order.items()])
    number = F.lit(0)
    for start in starts:
        at = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(order, start, strict=True)])
        number = number + F.when(key >= at, 1).otherwise(0)
    return docs.select(*[F.col(c) for c in docs.columns if c.lower() != "shard"], number.alias("shard"))


POLY = 0xEDB88320
#: CRC-32 in SQL: a table of 256 remainders, folded over the bytes of the text as hex digits.
SQL_CRC = f"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range::BIGINT AS v, 0 AS i FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {POLY}) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(v ORDER BY b) AS c FROM bits WHERE i = 8)
"""
SQL = f"""{SQL_CRC},
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, c FROM documents, crc),
d AS (SELECT doc_id, length(x) // 2 + {OVERHEAD} AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda p: ('0x' || p)::BIGINT)),
          lambda a, b: xor(a >> 8, c[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32 FROM h),
r AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
        row_number() OVER (ORDER BY doc_id, text_crc32) AS n FROM d),
s AS (SELECT *, ((2 * upto - size) * {SHARDS} // (2 * total))::INTEGER AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""


@query("op6_sharding", SQL)
def op6_sharding(spark, sf):
    found = shard_keys(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
