"""Benchmark decontamination: a broadcast set of benchmark windows, scanned over whole documents.

Words are runs of digits, a-z (A-Z lower-cased) and non-ASCII characters. A window is ``window`` consecutive
words of a benchmark item; a shorter item is one window of all its words. Window hashes are looked up in a bit
table first, every hit is verified word by word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airframe.llm.common import arrow_of, by_row, pick, query, stored, table

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is scanned in that many passes.
BLOCK_BYTES = 1 << 20
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        out = (out + ids[j : j + len(out)]) * MIX
    return out >> np.uint64(64 - TABLE_BITS)


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


class Windows:
    """The windows of a bounded list of items, by their number of words."""

    def __init__(self, items: list[tuple], window: int) -> None:
        self.items: dict[int, dict[bytes, set]] = {}
        self.seen: dict[int, np.ndarray] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(window, len(words))
            known = self.items.setdefault(k, {})
            for i in range(len(words) - k + 1):
                known.setdefault(b" ".join(words[i : i + k]), set()).add(item)
            self.seen.setdefault(k, np.zeros(1 << TABLE_BITS, bool))[window_hashes(word_ids(words), k)] = True

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges of the windows found, and the items they come from."""
        ranges, items = [], set()
        if words and self.items:
            ids = word_ids(words)
            for k, known in self.items.items():
                for i in np.flatnonzero(self.seen[k][window_hashes(ids, k)]).tolist():
                    found = known.get(b" ".join(words[i : i + k]))
                    if found:
                        ranges.append((i, i + k))
                        items |= found
        return ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each range of words."""
    at = [m.span() for m in WORD.finditer(text.translate(PLAIN))]
    kept, last = [], 0
    for a, z in spans:
        kept.append(text[last : at[a][0]])
        last = at[z - 1][1]
    return b"".join([*kept, text[last:]])


def blocks_of(bench: DataFrame, block_bytes: int) -> DataFrame:
    """Items with the number of the pass that scans for them; passes hold about ``block_bytes`` of text each."""
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = total // block_bytes + 1
    return bench.withColumn("pass", F.pmod(F.xxhash64("item", "text"), F.lit(passes))), passes


def scan(docs: DataFrame, bench: DataFrame, id="doc_id", text="text", item="item_id", item_text="text", window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text, n_words, spans, items)`` for every row of ``docs``.

    ``spans`` are merged, sorted ranges ``[start, stop)`` of words inside any occurrence of a window; ``items``
    the distinct ids of items with an occurring window, sorted. NULL and empty texts have no words; an item with
    no words has no window; a NULL item id counts as no item but its windows are hit. Repeated rows and items
    change nothing else. An empty benchmark hits nothing, an empty table gives no rows.

    Only one pass's items are held and broadcast at a time. Each pass adds its spans to the rows of the one
    before, which are written to the shared folder when there are several.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id, text=text).withColumn("text", F.col("text").cast("binary"))
    items = pick(bench, item=item, text=item_text).withColumn("text", F.col("text").cast("binary"))
    items, passes = blocks_of(items.distinct(), block_bytes)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    kind = T.ArrayType(items.schema["item"].dataType)
    rows = rows.withColumn("n_words", F.lit(0).cast("long")).withColumn("spans", F.array().cast(span)).withColumn("items", F.array().cast(kind))
    schema = pa.schema([(f.name, arrow_of(rows, f.name)) for f in rows.schema])
    for number in range(passes):
        known = spark.sparkContext.broadcast([tuple(r) for r in items.where(F.col("pass") == number).select("item", "text").collect()])
        if number:
            rows = stored(rows, "scanned")
        rows = rows.mapInArrow(scanner(known, window, schema), rows.schema)
    return rows.withColumn("text", F.col("text").cast("string"))


def scanner(known, window: int, schema: pa.Schema):
    def run(batches):
        windows = Windows(known.value, window)

        def row(key, text, _, spans, items):
            words = words_of(text)
            ranges, found = windows.scan(words)
            before = [(s["start"], s["stop"]) for s in spans]
            found |= set(items)
            spans = [{"start": a, "stop": z} for a, z in merged(before + ranges)]
            return key, text, len(words), spans, sorted(x for x in found if x is not None)

        return by_row(row, schema)(batches)

    return run


def remove_spans(found: DataFrame) -> DataFrame:
    """Scanned rows with their texts rid of the spans."""
    def clean(text, spans):
        return without(text, [(s["start"], s["stop"]) for s in spans]).decode()

    schema = pa.schema([(f.name, arrow_of(found, f.name)) for f in found.schema])

    def row(*cells):
        cell = dict(zip(schema.names, cells, strict=True))
        if cell["spans"]:
            cell["text"] = clean(cell["text"].encode(), cell["spans"])
        return tuple(cell.values())

    return found.mapInArrow(by_row(row, schema), found.schema)


def clean_rows(docs: DataFrame, bench: DataFrame, text="text", window=WINDOW, block_bytes=BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no window; passes as in :func:`scan`."""
    items, passes = blocks_of(pick(bench, item="item_id", text="text").withColumn("text", F.col("text").cast("binary")).distinct(), block_bytes)
    place = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())

    def filtered(known):
        def run(batches):
            windows = Windows(known.value, window)
            for batch in batches:
                clean = (not windows.scan(words_of(v.as_py().encode() if v.is_valid else None))[0] for v in batch.column(place))
                yield batch.filter(pa.array(list(clean), pa.bool_()))

        return run

    for number in range(passes):
        rows = items.where(F.col("pass") == number).select("item", "text").collect()
        docs = docs.mapInArrow(filtered(docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])), docs.schema)
        if number < passes - 1:
            docs = stored(docs, "clean")
    return docs


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL_WORDS = f"regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce({SQL_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s
      FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
      FROM d, (SELECT DISTINCT k FROM g) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
h AS (SELECT doc_id, i, p.k, item_id FROM p JOIN g ON p.k = g.k AND p.s = g.s),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(i, i + k)) AS t(x) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op8_decontaminate", SQL)
def op8_decontaminate(spark, sf):
    found = scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )
