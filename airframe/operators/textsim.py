"""Cosine of texts over their real terms: TF-IDF weights, an inverted index joined by term.

No term is hashed away and no vector is as long as the vocabulary: a text is its terms with their counts, one row
each, and texts meet where they share a term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airframe.operators.scoring import tokens

#: Bytes of texts that are counted in one task, about, and products of a text's and a query's term that are summed at once.
PART_BYTES, PRODUCTS = 16 << 20, 2_000_000
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def term_counts(df: DataFrame, id: str, text: str) -> DataFrame:
    """``(id, term, tf)``: how often each term occurs in each text; texts without terms, and NULL, have no row."""
    rows = df.select(F.col(id).alias("id"), F.explode(F.coalesce(tokens(text), F.array().cast("array<string>"))).alias("term"))
    return rows.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def text_cosine(df: DataFrame, id: str, left: str, right: str, name: str = "cosine") -> DataFrame:
    """``(id, <name>)``: cosine of the TF-IDF vectors of two texts of a row, 0 when either has no term.

    Every row's two texts count as documents for the frequencies. Ids must differ from row to row. One shuffle
    brings the counts of a row's term together from both texts, one joins the terms with their weight (a term that
    most texts have is split by a skew join), one sums up by row.
    """
    both = df.select(F.col(id).alias("id"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(left).alias("text")), F.struct(F.lit(1).alias("side"), F.col(right).alias("text")))).alias("t"))
    words = both.select("id", "t.side", F.explode(F.coalesce(tokens("t.text"), F.array().cast("array<string>"))).alias("term"))
    counts = words.groupBy("id", "term").agg(*[F.count_if(F.col("side") == s).cast("double").alias(n) for s, n in ((0, "a"), (1, "b"))])
    texts = df.agg((F.lit(2.0) * F.count(F.lit(1))).alias("texts"))
    seen = counts.groupBy("term").agg((F.count_if(F.col("a") > 0) + F.count_if(F.col("b") > 0)).alias("df")).crossJoin(F.broadcast(texts))  # one row
    idf = seen.select("term", (F.lit(1.0) + F.log((F.col("texts") + 1.0) / (F.col("df") + 1.0))).alias("w"))
    square = F.col("w") * F.col("w")
    sums = {"dot": F.col("a") * F.col("b"), "aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b")}
    scored = counts.join(idf, "term").groupBy("id").agg(*[F.sum(square * x).alias(n) for n, x in sums.items()])
    value = F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("aa")) * F.sqrt(F.col("bb"))), F.lit(0.0))
    return df.select(F.col(id).alias("id")).join(scored, "id", "left").select(F.col("id").alias(id), value.alias(name))


def similar_texts(queries: DataFrame, corpus: DataFrame, query_id: str, query: str, text_id: str, text: str, least: float = 0.2) -> DataFrame:
    """``(query_id, text_id, cosine)`` of the texts whose cosine with a query is at least ``least``, by an inverted index.

    Weights come from the corpus; a query term that no text has weighs as if none had it and lowers the query's
    cosines. The texts are shuffled once, into parts of about ``PART_BYTES``. A part's terms, one row each, fetch
    their weight and the queries that ask for them; counts and products never leave the part. Texts of one id are
    one text; those without an id count as one for the weights and are not found. ``least`` must be above 0.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    size = corpus.agg(F.count(F.lit(1)).cast("double").alias("texts"), F.sum(F.octet_length(text).cast("long")).alias("bytes")).first()
    parts = max(1, math.ceil((size["bytes"] or 0) / PART_BYTES))
    place = F.pmod(F.when(F.col(text_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(text_id)), F.lit(parts)).cast("int")
    docs = corpus.select(place.alias("part"), F.col(text_id).alias("id"), F.coalesce(F.lower(text), F.lit("")).alias("text"))

    def terms(part: pa.Table) -> pa.Table:
        """The part's terms with the number of ids that have them, and whether a text without an id does."""
        ids, vocabulary, doc, code, _ = _counted(part)
        known = doc < len(ids)
        n, nil = (np.bincount(code[x], minlength=len(vocabulary)) for x in (known, ~known))
        return pa.table({"part": pa.array(np.full(len(n), part["part"][0].as_py(), np.int32)), "term": vocabulary, "n": n, "nil": nil})

    seen = docs.groupBy("part").applyInArrow(terms, "part int, term string, n long, nil long")
    idf = seen.groupBy("term").agg((F.sum("n") + F.max("nil")).alias("df"))
    weight = F.lit(1.0) + F.log((F.lit(size["texts"]) + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0))
    asked = term_counts(queries, query_id, query).where("id IS NOT NULL").join(idf, "term", "left").select("id", "term", (F.col("tf") * weight).alias("x"))
    length = asked.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = asked.join(length, "id").groupBy("term").agg(F.collect_list(F.struct(F.col("id").alias("q"), (F.col("x") / F.col("norm")).alias("y"))).alias("asked"))
    told = seen.select("part", "term").join(idf.select("term", weight.alias("w")), "term").join(asked, "term", "left")

    def compare(part: pa.Table, index: pa.Table) -> pa.Table:
        kinds = {"q": index.schema.field("asked").type.value_type.field("q").type, "id": part.schema.field("id").type, "cosine": pa.float64()}
        found = [pa.table({n: pa.array([], k) for n, k in kinds.items()})]
        if len(part) and len(index):
            found += _cosines(*_counted(part), index.combine_chunks(), least)
        return pa.concat_tables(found)

    kinds = [("q", queries.schema[query_id].dataType), ("id", corpus.schema[text_id].dataType), ("cosine", T.DoubleType())]
    out = docs.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(compare, T.StructType([T.StructField(*k) for k in kinds]))
    return out.select(F.col("q").alias(query_id), F.col("id").alias(text_id), "cosine")


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal for equal ones and the number of different ones for NULL, and the values in that order."""
    try:
        found = values.dictionary_encode()
        return found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
    except pa.ArrowNotImplementedError:  # a nested value
        first: dict[str, int] = {}
        said = [None if v is None else first.setdefault(repr(v), len(first)) for v in values.to_pylist()]
        numbers = np.array([len(first) if v is None else v for v in said], np.int64)
        at = np.unique(numbers, return_index=True)[1][: len(first)]
        return numbers, values.take(pa.array(at))


def _runs(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of ASCII letters and digits of lower-case texts: the row and the length of each, and their bytes one after the other."""
    _, offsets, data = lowered.buffers()
    ends = np.frombuffer(offsets, np.int32)[lowered.offset : lowered.offset + len(lowered) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside, border = _WORD[data], np.zeros(len(data) + 1, bool)
    border[ends] = True
    border[1:-1] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(border[:-1] & inside)
    lengths = np.flatnonzero(border[1:] & inside) + 1 - starts
    return np.searchsorted(ends, starts, "right") - 1, lengths, data[inside]


def _counted(part: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and terms of a part, and (text, term, count) by their numbers in the order of the texts."""
    rows, lengths, letters, before = [], [], [], 0
    for chunk in (c for c in part["text"].chunks if len(c)):
        row, n, data = _runs(chunk)
        rows.append(row + before)
        lengths.append(n)
        letters.append(data)
        before += len(chunk)
    ends = np.concatenate([np.zeros(1, np.int64), *lengths]).cumsum()
    words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *letters])))
    words = words.dictionary_encode()
    doc, ids = _numbered(part["id"].combine_chunks())
    many = max(1, len(words.dictionary))
    pair, tf = np.unique(doc[np.concatenate([np.zeros(0, np.int64), *rows])] * many + words.indices.to_numpy(), return_counts=True)
    return ids, words.dictionary.cast(pa.string()), pair // many, pair % many, tf


def _cosines(ids: pa.Array, vocabulary: pa.Array, doc: np.ndarray, code: np.ndarray, tf: np.ndarray, index: pa.Table, least: float) -> Iterator[pa.Table]:
    """Cosines of at least ``least``, for some texts of a part at a time; ``index`` has a row for each of its terms."""
    at = pc.index_in(vocabulary, value_set=_whole(index["term"]))
    x = tf * _whole(index["w"]).take(at).to_numpy()[code]
    norm = np.sqrt(np.bincount(doc, x * x, minlength=len(ids) + 1))
    lists = _whole(index["asked"]).take(at)
    many = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, starts = lists.flatten(), many.cumsum() - many
    (query, names), y = _numbered(flat.field("q")), flat.field("y").to_numpy()
    use = (many[code] > 0) & (doc < len(ids))
    doc, code, x = doc[use], code[use], x[use]
    met = np.concatenate([np.zeros(1, np.int64), np.bincount(doc, many[code], minlength=len(ids)).astype(np.int64)]).cumsum()
    lo, rows = 0, max(1, PRODUCTS // max(1, len(names)))
    while lo < len(ids) and len(names):
        hi = max(lo + 1, min(lo + rows, len(ids), int(np.searchsorted(met, met[lo] + PRODUCTS, "right")) - 1))
        some = slice(*np.searchsorted(doc, [lo, hi]))
        n = many[code[some]]
        which = np.repeat(starts[code[some]] - (n.cumsum() - n), n) + np.arange(int(n.sum()))
        cell = np.repeat(doc[some] - lo, n) * len(names) + query[which]
        dot = np.bincount(cell, np.repeat(x[some], n) * y[which], minlength=(hi - lo) * len(names)).astype(np.float64).reshape(hi - lo, -1)
        cosine = np.divide(dot, norm[lo:hi, None], out=np.zeros_like(dot), where=norm[lo:hi, None] > 0)
        i, j = np.nonzero(cosine >= least)
        yield pa.table({"q": names.take(pa.array(j)), "id": ids.take(pa.array(i + lo)), "cosine": cosine[i, j]})
        lo = hi


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
