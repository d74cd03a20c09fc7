"""SimHash groups next to brute force."""

import numpy as np
import pytest
import xxhash

from airframe.llm import simhash
from airframe.llm.graph import components

SCHEMA = "doc_id long, text string, FP string, component string"


def plain_fingerprint(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, radius):
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def test_fingerprint_by_definition():
    rng = np.random.default_rng(1)
    for text in ["", None, "one", "One two", "a b c", " \t\n\x0b\x0c\r", "ÀB\x85c d\xa0e f", " ".join(map(str, rng.integers(0, 9, 700)))]:
        got = simhash.fingerprint(text.encode() if text is not None else None, 3)
        assert got & (2**64 - 1) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_index_finds_what_all_pairs_find(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for b, i, j in zip(base[:400], rng.integers(0, 64, 400), rng.integers(0, 64, 400), strict=True)]
    dense = [np.uint64(0xFFFF0000FFFF0000) ^ np.uint64(int(x)) for x in rng.integers(0, 1 << 12, 1500)]
    codes = np.concatenate([base, near, dense, [np.uint64(0), np.uint64(2**64 - 1)]]).view(np.int64).tolist()
    want = plain_groups(codes, radius)
    frame = spark.createDataFrame([(c,) for c in codes], "fp long")
    got = {r.node: r.component for r in components(simhash.gray_links(frame, radius)).collect()}
    assert {c: got.get(c, c) for c in want} == want


def test_groups_of_awkward_rows(spark):
    long = "word " * 5 + " ".join(f"w{i}" for i in range(40_000))
    rows = [(5, "a b c d"), (3, "a  b\nc D"), (None, "A b c d"), (9, None), (8, ""), (7, " \t"), (2, long), (2, long), (None, "only here in the test"), (1, "x")]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = simhash.near_fingerprints(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.component_id is not None) == [
        (False, 1, 1), (False, 2, 2), (False, 2, 2), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 8, 7), (False, 9, 7), (True, 0, 3)
    ]
    assert {r.fp for r in got if r.doc_id in (7, 8, 9)} == {0}
    assert simhash.near_fingerprints(docs.limit(0)).collect() == []


def test_components_of_a_chain_a_hub_and_repeated_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(7, 6), (7, 7), (None, 3), (500, 501)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(300)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_one_of_each_group_of_similar_texts_stays(spark):
    rng = np.random.default_rng(3)
    rows, clean = [], []
    for k in range(60):
        text = words(rng, int(rng.integers(60, 900)))
        rows.append((1000 + k, " ".join(text)))
        clean.append(1000 + k)
        for c in range(k % 3):
            other = list(text)
            for at in rng.choice(len(other), max(1, len(other) // 60), replace=False):  # about 0.85 of the shingles of five stay
                other[at] = "changed"
            rows.append((2000 + 10 * k + c, " ".join(other)))
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[0][1]), (5, None), (6, ""), (None, "a null id alone stays")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, chosen string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert set(clean) <= set(ids) and ids.count(1000) == 1
    assert 5 in ids and 6 not in ids and ids.count(None) == 1
    copies = [i for i in ids if i is not None and i >= 2000]
    assert len(copies) <= 3, copies
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_pairs_on_both_sides_of_the_similarity(spark):
    rng, rows, similar = np.random.default_rng(5), [], set()
    for k in range(80):
        text = words(rng, int(rng.integers(200, 700)))
        other = list(text)
        for at in rng.choice(len(other), max(1, int(len(other) * (0.015 + 0.001 * (k % 25)))), replace=False):
            other[at] = "changed"
        a, b = (set(simhash.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in (text, other))
        if len(a & b) >= 0.8 * len(a | b):
            similar.add(2 * k + 1)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 15 < len(similar) < 65
    assert not {i for i, _ in rows} - similar - kept  # nothing below the similarity goes
    assert len(similar & kept) <= 1


def test_rows_and_columns_survive_unchanged(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    assert kept.join(docs, docs.columns, "left_semi").count() == kept.count() > 0


def shares_a_passage(seed, texts, length, part, copies):
    """Texts with one long passage in common, all pairs below 0.8, and copies of some of them that stay just above it."""
    rng = np.random.default_rng(seed)
    passage, rows = words(rng, int(length * part)), []
    for k in range(texts):
        rows.append((k, passage + [f"own{k}x{i}" for i in range(length - len(passage))]))
    for k in range(copies):
        other = list(rows[k][1])
        for at in rng.choice(length // 6, length // 50, replace=False):
            other[6 * at] = f"changed{k}"
        rows.append((10_000 + k, other))
    return [(i, " ".join(t)) for i, t in rows]


def plain_similar(rows, similarity=0.8):
    """Smallest id of each group, from all pairs of sets of shingles."""
    ids = [i for i, _ in rows]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return set(least.values())


def test_close_fingerprints_below_the_similarity_stay(spark):
    rows = shares_a_passage(11, 500, 600, 0.86, 0)
    marks = np.array([simhash.signature(t.encode(), 5)[0][0] for _, t in rows])
    assert (np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 2).sum() > len(rows)  # the index finds pairs
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(plain_similar(rows)) == list(range(500))


def test_all_texts_under_one_key_are_compared(spark):
    rows = shares_a_passage(14, 400, 300, 0.85, 300)
    want = sorted(plain_similar(rows))
    kept = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == want and len(want) == 400
