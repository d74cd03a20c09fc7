"""URL rules as a sort-merge range join.

A host is turned round (``www.example.org`` becomes ``org.example.www.``), so that a host and all its subdomains
are one interval of keys and the intervals of rules are nested or apart. Pages are range-partitioned by key; a rule
goes to the partitions its interval meets. One sorted pass over pages and rules keeps a stack of the intervals that
are open at the page's key; the longest rule on the stack whose path starts the page's path decides.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airframe.llm.common import partitions, pick, query, stored, table, to_batch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"
DEFAULT = "allow"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))


def split_url(rows: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` of the column ``url``; both are empty when it is NULL or has no ``://``."""
    rest = F.coalesce(after_scheme(F.col("url")), F.lit(""))
    rows = rows.withColumn("rest", rest)
    host = F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER)
    return rows.withColumn("host", host).withColumn("path", F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1)).drop("rest")


def host_key(host: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def key_end(key: Column) -> Column:
    """First key behind all that start with this one: the last dot becomes the next character."""
    return F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))


EVENT = "part int, key string, page boolean, path string, page_id {kind}, host string, verdict string"


def judge(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains when the page's path
    starts with its path; the longest rule text wins, then the longer host. Where one rule has several verdicts
    ``block`` wins. No fitting rule: ``rule`` is NULL and the verdict the default. NULL urls and urls without
    ``://`` have empty host and path; rules with NULLs fit nothing; repeated rows are judged one by one; empty pages give
    no rows. A host with many pages is spread over partitions by path and id.
    """
    spark = pages.sparkSession
    keyed = split_url(pick(pages, page_id=id, url=url)).drop("url").withColumn("key", host_key("host"))
    keyed = keyed.repartitionByRange(partitions(spark), "key", "path", "page_id").withColumn("part", F.spark_partition_id())
    keyed = stored(keyed, "pages")
    bounds = keyed.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    known = pick(rules, host="host", path="path", verdict="verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    known = known.withColumn("host", F.translate("host", UPPER, LOWER)).withColumn("key", host_key("host")).withColumn("end", key_end(F.col("key")))
    # a row of bounds for each partition: bounded by their number
    met = known.join(F.broadcast(bounds), (F.col("key") <= F.col("high")) & (F.col("end") > F.col("low")))
    kind = keyed.schema["page_id"].dataType
    events = keyed.select("part", "key", F.lit(True).alias("page"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict")).union(
        met.select("part", "key", F.lit(False).alias("page"), "path", F.lit(None).cast(kind).alias("page_id"), "host", "verdict")
    )
    events = events.repartition(partitions(spark), "part").sortWithinPartitions("part", "key", "page", "path")
    types = {"page_id": kind.simpleString()}
    schema = pa.schema([("page_id", arrow_type(kind)), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    return events.mapInArrow(sweep(default, schema), f"page_id {types['page_id']}, host string, path string, rule string, verdict string")


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def sweep(default: str, schema: pa.Schema):
    """One pass over sorted events; the stack holds, for each open interval, the paths of its rules and their lengths, longest first."""

    def run(batches):
        part, stack, out = None, [], []
        for batch in batches:
            for at, key, is_page, path, page_id, host, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_page:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    _, _, paths, lengths = stack[-1]
                    if -len(path) not in lengths:
                        insort(lengths, -len(path))
                    paths[path] = min(verdict, paths.get(path, verdict), key=lambda v: (v != "block", v))
                    continue
                rule = longest(stack, path)
                out.append((page_id, host, path, rule[1] + rule[2] if rule else None, rule[3] if rule else default))
                if len(out) >= 4096:
                    yield to_batch(out, schema)
                    out = []
        if out:
            yield to_batch(out, schema)

    return run


def longest(stack: list, path: str) -> tuple | None:
    """``(length, host, path, verdict)`` of the longest rule that fits; only lengths that rules have are tried."""
    best = None
    for _, host, paths, lengths in stack:
        for n in map(abs, lengths):
            if n <= len(path) and path[:n] in paths:
                found = (len(host) + n, host, path[:n], paths[path[:n]])
                best = found if best is None or found[0] >= best[0] else best
                break
    return best


#: Fixed values of the query: host, path, verdict.
FIXED_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_RULES, RULES)


VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in FIXED_RULES)
SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp, rv) AS (VALUES {VALUES}),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS v
      FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM q LEFT JOIN m USING (page_id)
"""


@query("op7_url_rules", SQL)
def op7_url_rules(spark, sf):
    return judge(table(spark, sf, "pages"), rule_table(spark))
