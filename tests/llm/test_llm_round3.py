"""Whitening, quality rules and the conversation trie next to plain versions."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from airframe.llm import quality, trie, whitening
from airframe.llm.common import QUERIES

# ---------------------------------------------------------------- whitening


def plain_whitening(rows, k=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    distinct = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (distinct * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    all_rows = (x * n - sums)
    return n, (all_rows * all_rows).sum(axis=1), (all_rows.astype(float) / n) @ vectors / np.sqrt(values), values / (centred**2).sum() * n


def test_whitening_next_to_an_eigenvalue_routine(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    n, deviation, white, share = plain_whitening(rows)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, sf).collect()}
    assert len(got) == 16 * len(rows)
    for c in range(1, 17):
        mine = np.array([got[i, c].whitened for i, _ in rows])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.allclose(mine, sign * white[:, c - 1], atol=1e-8)
        assert abs(got[rows[0][0], c].explained - share[c - 1]) <= 1e-10 * share[c - 1]
    assert all(got[i, 1].deviation == d and got[i, 1].n == n and got[i, 3].identity_error < 1e-9 for (i, _), d in zip(rows, deviation.tolist(), strict=True))


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 5)) @ np.diag([9, 3, 3, 1, 0])  # an equal pair and a direction without variance
    good = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, x[1].tolist()), (None, x[2].tolist())] + [(7000 + i, x[0].tolist()) for i in range(200)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [float("nan")] * 5), (903, [float("inf")] * 5), (904, []), (905, [1.0]), (906, [1e300] * 5)]
    frame = spark.createDataFrame([(i, v, 1, "z") for i, v in good + bad], "vec_id long, embedding array<double>, component int, X string")
    got = whitening.whitened(frame).collect()
    n, deviation, white, share = plain_whitening(good, 4)
    assert n == 300 and Counter(r.vec_id for r in got) == Counter({i: 4 * k for i, k in Counter(i for i, _ in good).items()})
    by = defaultdict(set)
    for r in got:
        by[r.vec_id].add(int(r.deviation))
    assert all(int(d) in by[i] for (i, _), d in zip(good, deviation.tolist(), strict=True))
    assert all(r.identity_error < 1e-9 and abs(r.explained - share[r.component - 1]) < 1e-9 for r in got)
    mine = np.array([[r.whitened for r in sorted((r for r in got if r.vec_id == i), key=lambda r: r.component)] for i in range(3, 300)])
    assert np.allclose(np.abs(mine[:, 0]), np.abs(white[3:300, 0]), atol=1e-8)
    assert whitening.whitened(frame.limit(0)).collect() == []
    assert whitening.whitened(frame.where("vec_id >= 900")).count() <= 1200  # copies and what cannot be used
    assert whitening.whitened(frame.where("vec_id >= 7000")).collect() == []  # equal vectors have no variance


def test_huge_parts_stay_exact(spark):
    rows = [(1, [1e15, 0.5]), (2, [-1e15, 0.25]), (3, [3.0, 7.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, deviation, _, _ = plain_whitening(rows, 2)
    assert {r.vec_id: int(r.deviation) for r in got} == dict(zip([1, 2, 3], map(int, deviation), strict=True))


@pytest.mark.parametrize("kind", ["random", "graded", "low rank", "equal", "clusters", "zero columns", "one column", "nearly equal columns"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(0)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = {
        "random": lambda: rng.standard_normal((200, 40)),
        "graded": lambda: rng.standard_normal((200, 40)) @ np.diag(np.logspace(0, -9, 40)),
        "low rank": lambda: rng.standard_normal((7, 40)),
        "equal": lambda: 3 * turn,
        "clusters": lambda: np.linalg.qr(rng.standard_normal((99, 40)))[0] @ np.diag([5] * 10 + [2] * 20 + [1] * 10) @ turn,
        "zero columns": lambda: np.hstack([rng.standard_normal((50, 3)), np.zeros((50, 4))]),
        "one column": lambda: rng.standard_normal((50, 1)),
        "nearly equal columns": lambda: np.repeat(rng.standard_normal((300, 5)), 8, axis=1) + 1e-9 * rng.standard_normal((300, 40)),
    }[kind]()
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((a.shape[1] - len(r), a.shape[1]))])
    values, vectors = whitening.leading(r, 16)
    want = np.linalg.svd(a, compute_uv=False)
    assert len(values) == min(16, int((want > 1e-12 * want[0]).sum()))
    assert np.allclose(values, want[: len(values)], rtol=1e-12, atol=1e-13 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values**2).max() < 1e-12 * want[0] ** 2


def test_small_singular_values_keep_their_digits():
    d, e = np.logspace(0, -12, 30), 0.3 * np.logspace(0, -12, 30)[:-1]
    b = np.diag(d) + np.diag(e, 1)
    got = np.sqrt(whitening.dqds((d**2).tolist(), (e**2).tolist()))
    inverse = 1 / np.linalg.svd(np.linalg.inv(b), compute_uv=False)  # its largest values are the smallest ones of b
    assert abs(got[-1] / inverse[0] - 1) < 1e-10 and abs(got[0] / np.linalg.svd(b, compute_uv=False)[0] - 1) < 1e-12


# ---------------------------------------------------------------- quality rules


def split_words(text):
    return (text or "").translate({c: 32 for c in range(9, 14)}).split(" ")


def plain_quality(text):
    w = [x for x in split_words(text) if x]
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(split_words(x))]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_next_to_plain_ones(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "one", "a b c", "a b c a b c", "a a a a a", "x\x0by\x0cz\tw \x85 \xa0v", "#$|<>* 𝔘𝔫 é́", "l\nl\n \n\nl\r\nm", "a  b   c\na b c", "fff the fff", "it's \\n 'q'"]
    texts += [" ".join(rng.choice(list("abcdef"), 40)) for _ in range(60)] + ["the la " * 60_000, "w" * 300_000]
    frame = spark.createDataFrame([(i % 50, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, W string, n_words int").repartition(5)
    got = quality.judged(frame.union(frame.limit(0)))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == Counter((i % 50, *plain_quality(t)) for i, t in enumerate(texts))
    assert quality.judged(frame.limit(0)).collect() == []
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got.collect())


def test_rules_are_a_table(spark):
    frame = spark.createDataFrame([(1, "tom met ann " + "word " * 3), (None, None)], "doc_id long, text string")
    rule = quality.Rule("short", "word_chars", "n_words", None, 3)
    got = {r.doc_id: (r.kept, r.failed) for r in quality.judged(frame, base=(), rules=(rule,)).collect()}
    assert got == {1: (False, ["short"]), None: (True, [])}
    assert {r.kept for r in quality.judged(frame, base=(), rules=(), stop_words=()).collect()} == {True}


def test_clean_labelled_documents_are_kept(spark, sf):
    marked = quality.judged(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    clean = marked.where("quality = 1 AND NOT base_failed")
    assert clean.where("kept").count() >= 0.95 * clean.count()
    assert marked.where("quality = 0 AND kept").count() == 0


# ---------------------------------------------------------------- conversation trie


def digest(role, text):
    role, text = role or "", text or ""
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_conversations(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, digest(role, text), len([x for x in split_words(text) if x])))
    return {c: [t[2:] for t in sorted(t)] for c, t in turns.items()}


def plain_rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(np.fmod(c, 20)), [])[:h] + own[h:]
    return out


def plain_trie(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = Counter(q[:-1] for q in members if q), Counter(), Counter()
    for q, m in members.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += q not in children
            saved[q[:d]] += (len(m) - 1) * q[-1][1] if q else 0
    out = []
    for q, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(q))
        out.append((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), children[q], leaves[q], saved[q], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(turns, ids):
    nodes, ends = trie.prefix_trie(turns, ids)
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(trie.end_digests(ends), trie.KEY, "left").fillna(none, ["ends_sha256"])
    return Counter(tuple(r) for r in found.select(COLUMNS).collect())


def conversation_rows(rng, n=160):
    rows = []
    for c in range(0, n):
        if c in (20, 33, 40):  # 20 and 40: heads that are absent
            continue
        length = int(rng.choice([1, 2, 3, 8, 9, 16, 17, 30]))
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\nf"])) for k in range(length)]
    copies = [("user", "same start"), ("assistant", "same  answer here"), ("user", "x")]
    rows += [(1000 + c, k, *t) for c in range(150) for k, t in enumerate(copies * (5 if c % 3 else 6))]
    rows += [(5000, k, "user", f"word {k // 2}") for k in range(700)] + [(5001, k, "user", f"word {k // 2}") for k in range(650)]
    rows += [(6000, None, "user", "t1"), (6000, None, "user", "t0"), (6000, 0, "user", "t2"), (6000, 0, "user", "t2"), (-7, 1, "user", "m"), (None, 0, "user", "none"), (None, 1, "user", "none")]
    return rows


def test_trie_next_to_sets_of_prefixes(spark, monkeypatch):
    monkeypatch.setattr(trie, "STEP", 16)
    rows = conversation_rows(np.random.default_rng(9))
    frame = spark.createDataFrame([(*map(lambda v: v if v is None else str(v) if isinstance(v, str) else int(v), r), 1, "y") for r in rows], "conv_id long, turn long, role string, text string, pos int, Words string")
    turns = trie.turn_rows(frame)
    plain = plain_conversations(rows)
    ids = frame.select("conv_id").where("conv_id IS NOT NULL")
    assert trie_rows(turns, ids) == plain_trie(plain)
    assert trie_rows(*trie.rebuilt(turns)) == plain_trie(plain_rebuilt(plain))
    assert trie_rows(trie.turn_rows(frame.limit(0)), ids.limit(0)) == Counter()
    assert trie_rows(turns.limit(0), spark.createDataFrame([(5,), (3,)], "conv_id long")) == plain_trie({3: [], 5: []})
