"""Text cosine next to plain vectors over all terms."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from airframe.operators import textsim


def terms(text):
    return Counter(re.findall("[a-z0-9]+", (text or "").lower()))


def plain_cosine(a, b, weight):
    dot = sum(a[t] * b[t] * weight(t) ** 2 for t in a if t in b)
    norm = math.sqrt(sum((n * weight(t)) ** 2 for t, n in a.items()) * sum((n * weight(t)) ** 2 for t, n in b.items()))
    return dot / norm if norm else 0.0


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["the", "The,", "a1", "air", "ozone", "ou-tdoor", "x" * 40, "é"], [9, 3, 2, 1, 1, 1, 1, 1], k=rng.randint(0, 30))) for _ in range(n)] + [None, "", "!!", "only here"]


def test_two_texts_of_a_row(spark):
    pairs = list(zip(texts(60, 1), reversed(texts(60, 2)), strict=True))
    got = {r.i: r.cosine for r in textsim.text_cosine(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, l string, r string"), "i", "l", "r").collect()}
    every = [terms(t) for p in pairs for t in p]
    df = Counter(t for d in every for t in d)
    weight = lambda t: 1 + math.log((len(every) + 1) / (df[t] + 1))
    assert len(got) == len(pairs) and all(got[i] == pytest.approx(plain_cosine(terms(a), terms(b), weight)) for i, (a, b) in enumerate(pairs))
    empty = spark.createDataFrame([], "i long, l string, r string")
    assert textsim.text_cosine(empty, "i", "l", "r").collect() == []


@pytest.mark.parametrize("least", [0.1, 0.5, 0.95])
def test_search_by_the_index(spark, least):
    corpus, queries = texts(80, 3), texts(15, 4)
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    df = Counter(t for d in map(terms, corpus) for t in d)
    weight = lambda t: 1 + math.log((len(corpus) + 1) / (df[t] + 1))
    want = {(q, d): plain_cosine(terms(a), terms(b), weight) for q, a in enumerate(queries) for d, b in enumerate(corpus)}
    got = {(r.q, r.d): r.cosine for r in textsim.similar_texts(frame(queries).toDF("q", "t"), frame(corpus).toDF("d", "t"), "q", "t", "d", "t", least).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= least})


def test_the_least_cosine_must_be_above_zero(spark):
    with pytest.raises(ValueError):
        textsim.similar_texts(spark.range(1), spark.range(1), "id", "id", "id", "id", 0.0)


@pytest.mark.parametrize("part_bytes,products", [(100, 40), (1 << 24, 2_000_000)])
def test_texts_go_to_parts_once_and_terms_stay_there(spark, monkeypatch, part_bytes, products):
    """Repeated ids are one text, those without an id count as one and are not found; nothing is counted in rows of a term but the queries."""
    monkeypatch.setattr(textsim, "PART_BYTES", part_bytes)
    monkeypatch.setattr(textsim, "PRODUCTS", products)  # of the driver's process; tasks keep theirs
    rng = random.Random(9)
    words = ["the", "The", "a1", "air", "ozone", "É", "İx", "K", "x" * 40, "2024", "ou-t"]
    rows = [(None if i % 9 == 4 else f"d{i % 50}", rng.choice([None, ""]) if i % 13 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 20)))) for i in range(90)]
    asked = [(None if i == 3 else i % 8, " ".join(rng.choices([*words, "unknown"], k=4))) for i in range(12)]
    counted, plain = [], textsim.term_counts
    monkeypatch.setattr(textsim, "term_counts", lambda df, *more: counted.append(df.count()) or plain(df, *more))
    queries, corpus = spark.createDataFrame(asked, "q long, t string"), spark.createDataFrame(rows, "d string, t string").repartition(5)
    got = {(r.q, r.d): r.cosine for r in textsim.similar_texts(queries, corpus, "q", "t", "d", "t", 0.3).collect()}
    together = lambda rows: {k: sum((terms(t) for i, t in rows if i == k), Counter()) for k in {i for i, _ in rows}}
    texts_of, asked_of = together(rows), together(asked)
    df = Counter(t for d in texts_of.values() for t in d)
    weight = lambda t: 1 + math.log((len(rows) + 1) / (df[t] + 1))
    want = {(q, d): plain_cosine(a, b, weight) for q, a in asked_of.items() for d, b in texts_of.items() if q is not None and d is not None}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.3}) and len(got) > 20
    assert counted == [12]
    pairs = spark.createDataFrame([(1, "b c"), (2, "air")], "i long, t string").selectExpr("named_struct('i', i) AS d", "t")
    assert [tuple(r.d) for r in textsim.similar_texts(queries.selectExpr("q", "'air air' AS t"), pairs, "q", "t", "d", "t", 0.9).select("d").distinct().collect()] == [(2,)]


def test_cosines_of_some_texts_at_a_time(monkeypatch):
    """A part whose products are summed in many steps, and one without any text."""
    part = pa.table({"id": pa.array([7, 8, 9, 7], pa.int64()), "text": ["a b", "", "b c c", "c"]})
    asks = pa.array([[{"q": "u", "y": 1.0}], None, [{"q": "v", "y": 0.5}, {"q": "u", "y": 0.25}]])
    index = pa.table({"term": ["a", "b", "c"], "w": [1.0, 2.0, 3.0], "asked": asks})
    want = {("u", 7): (1 + 0.75) / math.sqrt(14), ("v", 7): 1.5 / math.sqrt(14), ("u", 9): 1.5 / math.sqrt(40), ("v", 9): 3 / math.sqrt(40)}
    for products in (1, 3, 1_000):
        monkeypatch.setattr(textsim, "PRODUCTS", products)
        rows = [r for t in textsim._cosines(*textsim._counted(part), index, 0.1) for r in t.to_pylist()]
        assert {(r["q"], r["id"]): r["cosine"] for r in rows} == pytest.approx(want) and len(rows) == 4
    assert list(textsim._cosines(*textsim._counted(part.slice(1, 1)), index, 0.1)) == []
