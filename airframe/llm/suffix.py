"""Removal of repeated byte strings by prefix-free parsing.

A text is parsed at triggers: the places where a rolling hash is smallest in a stretch of ``REACH`` places. Triggers depend
on the bytes around them alone, so repeated text is parsed alike wherever it stands, and every string of
``length`` bytes has one trigger of its own, the smallest in its first ``REACH`` places. That trigger serves a short run of
starts; what these strings have in common behind the trigger is its phrase, what they cover together its context.

Phrases are the dictionary, the triggers of all texts the parse. Corpus order is only needed up to ``length``
bytes, and only to tell which suffixes are equal that far; so dictionary entries, contexts and suffixes are put in order by
64-bit fingerprints instead of ranks, level by level: a phrase that occurs once ends the matter for all its
starts, a context that occurs twice settles them too, and only where one phrase has several contexts are its
starts parted into shorter runs, one representative for each context, down to single suffixes. Copies cost one
context, however many there are, and no level brings a group of equal things together in a task.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import arrow_of, by_row, pick, query, stored, table

LENGTH, REACH, GRAM = 200, 128, 16
#: Starts of a run at the levels below the first.
RUNS = (8, 1)
#: Starts that are worked on at once in a long text; bits for a place in it.
TILE, PLACE = 1 << 20, 24
_RANDOM = np.random.default_rng(9)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTES = _RANDOM.integers(0, 1 << 64, (2, 256), dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, kept as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            steps = np.full(n, BASE), np.full(n, INVERSE)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.multiply.accumulate(s) for s in steps)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Running sums of a text from which the hash of any stretch is read off."""

    def __init__(self, body: np.ndarray, which: int) -> None:
        self.up, down = POWERS.upto(len(body) + 1)
        self.sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(BYTES[which][body] * down[:-1], out=self.sums[1:])

    def hash(self, start, stop) -> np.ndarray:
        return stirred((self.sums[stop] - self.sums[start]) * self.up[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every stretch of ``width``, from running minima forth and back in blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1 : width - 1 + n])


def tiles(text: bytes, length: int):
    """Stretches of a text that hold ``TILE`` starts each, with their first place."""
    for at in range(0, len(text) - length + 1, TILE):
        yield at, np.frombuffer(text, np.uint8, min(len(text) - at, TILE + length - 1), at)


def parse(text: bytes, length: int):
    """For each tile of a text its first place and its triggers: phrase, context, trigger, first and last start."""
    for at, body in tiles(text, length):
        starts = len(body) - length + 1
        places = starts + REACH - 1
        rolling = Sums(body[: places + GRAM - 1], 0)
        place = np.arange(places)
        value = rolling.hash(place, place + GRAM) >> np.uint64(PLACE) << np.uint64(PLACE) | place.astype(np.uint64)
        trigger = (sliding_least(value, REACH) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        low = np.flatnonzero(np.concatenate([[True], trigger[1:] != trigger[:-1]]))
        high = np.concatenate([low[1:], [starts]]) - 1
        trigger = trigger[low]
        sums = Sums(body, 1)
        phrase = sums.hash(trigger, trigger + length - REACH + 1)
        yield at, phrase.view(np.int64), contexts_of(sums, trigger, low, high, length), trigger, low, high


def contexts_of(sums: Sums, trigger: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of what the strings at a run of starts cover together, and of where the run lies."""
    shape = ((trigger - low) * REACH + high - low).astype(np.uint64)
    return stirred(sums.hash(low, high + length) ^ stirred(shape + np.uint64(1))).view(np.int64)


def phrases(length: int, per_text: bool):
    """Phrases of each text: with the number of their occurrences, or once with the text's hash."""
    name = "text_hash" if per_text else "n"
    schema = pa.schema([("phrase", pa.int64()), (name, pa.int64())])

    def run(batches):
        for batch in batches:
            found, other = [], []
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, phrase, *_ in parse(text.as_py(), length):
                    distinct, n = np.unique(phrase, return_counts=True)
                    found.append(distinct)
                    other.append(np.full(len(distinct), mark) if per_text else n)
            if found:
                columns = [pa.array(np.concatenate(c)) for c in (found, other)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def packed(batches):
    """Rows with the size, digest and packed bytes of their text."""
    press = zstandard.ZstdCompressor(3)
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text")]
        columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        more = [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([press.compress(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "n_bytes", "sha256", "body"])


RUN = "phrase long, context long, row long, trigger long, low long, high long, many boolean"
RUN_SCHEMA = pa.schema([*((n, pa.int64()) for n in ("phrase", "context", "row", "trigger", "low", "high")), ("many", pa.bool_())])


def run_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, RUN_SCHEMA, strict=True)], schema=RUN_SCHEMA)


def marked(length: int):
    """The triggers of a text whose phrase occurs again somewhere."""

    def run(batches):
        for batch in batches:
            for row, body, known in zip(*(batch.column(n) for n in ("row", "body", "phrases")), strict=True):
                known = np.sort(known.values.to_numpy())
                for at, phrase, context, trigger, low, high in parse(unpacked(body.as_py()), length):
                    here = known[np.minimum(np.searchsorted(known, phrase), len(known) - 1)] == phrase
                    n = int(here.sum())
                    yield run_batch(phrase[here], context[here], np.full(n, row.as_py()), at + trigger[here], at + low[here], at + high[here], np.zeros(n, bool))

    return run


def parted(length: int, size: int):
    """Runs parted into runs of at most ``size`` starts, on a grid that counts back from the trigger. The phrase of a
    part is what all its strings share by their place on the grid, under the phrase it comes from."""

    def run(batches):
        for batch in batches:
            for row, body, runs in zip(*(batch.column(n).to_pylist() for n in ("row", "body", "runs")), strict=True):
                phrase, trigger, low, high, many = (np.array([r[n] for r in runs]) for n in ("phrase", "trigger", "low", "high", "many"))
                for at, bytes_ in tiles(unpacked(body), length):
                    mine = np.flatnonzero(low // TILE == at // TILE)
                    if len(mine):
                        sums = Sums(bytes_, 1)
                        t, z = trigger[mine] - at, high[mine] - at
                        first, last = (t - z) // size, (t - (low[mine] - at)) // size
                        parts = last - first + 1
                        of = np.repeat(np.arange(len(mine)), parts)
                        cell = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts) + first[of]
                        t, own = t[of], mine[of]
                        start, stop = np.maximum(low[own] - at, t - cell * size - size + 1), np.minimum(z[of], t - cell * size)
                        common = sums.hash(t - cell * size, t - cell * size - size + 1 + length)
                        key = stirred(common ^ stirred(phrase[own].view(np.uint64) + cell.astype(np.uint64))).view(np.int64)
                        yield run_batch(key, contexts_of(sums, t, start, stop, length), np.full(len(of), row), at + t, at + start, at + stop, many[own])

    return run


def unpacked(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def spans_of(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal stretches covered by strings that start in the given ranges."""
    if not ranges:
        return []
    low = np.array([r["low"] for r in ranges])
    order = np.argsort(low, kind="stable")
    low, stop = low[order], np.maximum.accumulate(np.array([r["high"] for r in ranges])[order] + length)
    first = np.flatnonzero(np.concatenate([[True], low[1:] > stop[:-1]]))
    return list(zip(low[first].tolist(), stop[np.concatenate([first[1:], [len(low)]]) - 1].tolist(), strict=True))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def repeats(docs: DataFrame, id="doc_id", text="text", length=LENGTH, with_text=False) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept_sha256)`` per row, and ``kept`` (the remaining bytes) when asked for.

    ``spans`` are the maximal stretches ``[start, stop)`` of bytes covered by a string of ``length`` bytes that starts
    anywhere else too, in this text or another; strings are those of the input. NULL and empty texts have no bytes,
    texts shorter than ``length`` keep all. Repeated rows are texts of their own, so they remove each other. Cutting may
    part a multi-byte character, so ``kept`` is binary. An empty table gives no rows. Long texts are parsed in
    tiles. ``length`` must be over ``REACH + GRAM``.
    """
    if length <= REACH + GRAM:
        raise ValueError(f"length must be over {REACH + GRAM}")
    rows = pick(docs, doc_id=id, text=text).withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    again = rows.select("text_hash", "text").mapInArrow(phrases(length, False), "phrase long, n long")
    again = stored(again.groupBy("phrase").agg(F.sum("n").alias("n")).where("n > 1").select("phrase"), "dictionary")
    known = rows.select("text_hash", "text").mapInArrow(phrases(length, True), "phrase long, text_hash long")
    known = known.join(again, "phrase").groupBy("text_hash").agg(F.collect_set("phrase").alias("phrases"))

    kind = rows.schema["doc_id"].dataType.simpleString()
    bodies = rows.select("doc_id", "text_hash", "text").mapInArrow(packed, f"doc_id {kind}, text_hash long, n_bytes long, sha256 string, body binary")
    body = F.col("body") if with_text else F.when(F.col("phrases").isNotNull(), F.col("body"))
    texts = bodies.join(known, "text_hash", "left").withColumn("body", body).drop("text_hash")
    texts = stored(texts.withColumn("row", F.monotonically_increasing_id()), "texts")

    bodies = texts.where("phrases IS NOT NULL").select("row", "body", "phrases")
    runs, settled = bodies.mapInArrow(marked(length), RUN), []
    for size in (*RUNS, None):
        runs = stored(runs, "runs")
        contexts = runs.groupBy("phrase", "context").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min(F.struct("row", "trigger", "low", "high")).alias("first"))
        contexts = stored(contexts, "contexts")
        equal = contexts.where("n > 1").select("phrase", "context")
        settled.append(runs.where("NOT many").join(equal, ["phrase", "context"]).select("row", "low", "high"))
        if size:
            several = contexts.groupBy("phrase").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least"))
            left = contexts.join(several.where("contexts > 1 AND least = 1").select("phrase"), "phrase")
            left = left.groupBy("first.row").agg(F.collect_list(F.struct("phrase", "first.trigger", "first.low", "first.high", (F.col("n") > 1).alias("many"))).alias("runs"))
            runs = left.join(bodies.select("row", "body"), "row").mapInArrow(parted(length, size), RUN)
    ranges = reduce(DataFrame.union, settled).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    columns = [("doc_id", arrow_of(rows, "doc_id")), ("n_bytes", pa.int64())]
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([*columns, ("spans", pa.list_(span)), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_text else [])])

    def finish(key, size, digest, body, ranges):
        if not ranges:
            return (key, size, [], digest, *([unpacked(body)] if with_text else []))
        spans = spans_of(ranges, length)
        kept = cut(unpacked(body), spans)
        row = (key, size, [{"start": a, "stop": z} for a, z in spans], hashlib.sha256(kept).hexdigest())
        return (*row, kept) if with_text else row

    done = texts.join(ranges, "row", "left").select("doc_id", "n_bytes", "sha256", "body", "ranges")
    out = f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept_sha256 string" + ", kept binary" * with_text
    return done.mapInArrow(by_row(finish, schema), out)


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, {2 * LENGTH})) AS k FROM d, unnest(range(0, n - {LENGTH - 1})) AS t(p)),
h AS (SELECT doc_id, p FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + {LENGTH} THEN 0 ELSE 1 END AS head FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
s AS (SELECT doc_id, min(p) AS lo, max(p) + {LENGTH} AS hi FROM i GROUP BY doc_id, span),
l AS (SELECT doc_id, list(struct_pack(lo := lo, hi := hi) ORDER BY lo) AS s FROM s GROUP BY doc_id),
j AS (SELECT doc_id, x, n, coalesce(s, []) AS s FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(list_sum(list_transform(s, lambda r: r.hi - r.lo)), 0)::BIGINT AS n_removed, len(s)::BIGINT AS n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(s) + 1), lambda i: substr(x, CASE WHEN i = 0 THEN 1 ELSE 2 * s[i].hi + 1 END,
    CASE WHEN i = len(s) THEN 2 * n ELSE 2 * s[i + 1].lo END - CASE WHEN i = 0 THEN 0 ELSE 2 * s[i].hi END)), ''))) AS kept_sha256
FROM j
"""


@query("op9_repeats", SQL)
def op9_repeats(spark, sf):
    found = repeats(table(spark, sf, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
