"""Repeated strings, decontamination, language, licences and chat next to plain versions."""

import hashlib
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from airframe.llm import chat, decontaminate, langid, licences, suffix


def plain_repeats(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        spans = []
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append((len(b), [tuple(s) for s in spans], hashlib.sha256(suffix.cut(b, spans)).hexdigest()))
    return out


def awkward_texts():
    rng = np.random.default_rng(5)
    letters = list("abcdefgh éü\n")

    def text(n):
        return "".join(rng.choice(letters, n))

    shared, line = text(700), text(230)
    texts = [text(int(n)) for n in rng.integers(0, 3000, 25)]
    texts += [text(50) + shared + text(90), shared[:350] + text(400), text(300) + shared[100:299], text(10) + shared[200:420] + text(5)]
    texts += [text(int(n)) + line + text(300) for n in rng.integers(0, 400, 20)]
    texts += [texts[3], texts[3], None, "", "x", "a" * 900, "ab" * 400, text(200), shared[:200]]
    return texts


def test_repeats_next_to_all_strings(spark):
    texts = awkward_texts()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, body string, row int")
    got = {r.doc_id: r for r in suffix.repeats(docs, with_text=True).collect()}
    for i, (size, spans, digest) in enumerate(plain_repeats(texts)):
        r = got[i]
        assert (r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256) == (size, spans, digest)
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == digest
    assert suffix.repeats(docs.limit(0)).collect() == []


def test_a_text_longer_than_a_tile(spark):
    rng = np.random.default_rng(6)
    body = bytes(rng.integers(97, 123, suffix.TILE + 5000, dtype=np.uint8)).decode()
    border = body[suffix.TILE - 300 : suffix.TILE + 350]
    texts = [body, "q" * 30 + border, body[:150] + border[:250]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix.repeats(docs).collect()}
    for i, (size, spans, digest) in enumerate(plain_repeats(texts)):
        assert (got[i].n_bytes, [tuple(s) for s in got[i].spans], got[i].kept_sha256) == (size, spans, digest)


def test_short_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        suffix.repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=100)


def bench_rows():
    item = " ".join(f"b{i}" for i in range(25))
    return item, [(1, item), (2, "Tiny item"), (3, None), (4, " ... "), (None, " ".join(f"n{i}" for i in range(12))), (5, item), (5, item)]


def test_windows_found_in_any_number_of_passes(spark):
    item, bench = bench_rows()
    rows = [
        (1, "before " + item.upper().replace(" ", ", ") + " after"),
        (2, "b0 b1 b2 b3 b4 b5 b6 b7 b8 x"),
        (3, "a tiny-ITEM, and tiny items"),
        (4, None),
        (5, ""),
        (6, " ".join(f"n{i}" for i in range(1, 12))),
        (7, "word " * 30_000 + " ".join(f"b{i}" for i in range(3, 13))),
        (7, "clean"),
    ]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n_words int, SPANS string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = {(1, 27): ([(1, 26)], [1, 5]), (2, 10): ([], []), (3, 6): ([(1, 3)], [2]), (4, 0): ([], []), (5, 0): ([], []), (6, 11): ([(0, 11)], []), (7, 30_010): ([(30_000, 30_010)], [1, 5]), (7, 1): ([], [])}
    for size in (1 << 20, 60):
        got = decontaminate.scan(docs, items, block_bytes=size).collect()
        assert {(r.doc_id, r.n_words): ([tuple(s) for s in r.spans], r.items) for r in got} == want
        kept = decontaminate.clean_rows(docs, items, block_bytes=size)
        assert sorted((r.doc_id, len(r.text or "")) for r in kept.collect()) == [(2, 28), (4, 0), (5, 0), (7, 5)]
        assert kept.columns == docs.columns
    cleaned = {r.doc_id: r.text for r in decontaminate.remove_spans(decontaminate.scan(docs, items)).collect()}
    assert cleaned[1] == "before  after" and cleaned[3] == "a , and tiny items" and cleaned[4] is None
    assert decontaminate.scan(docs.limit(0), items).collect() == []
    assert all(r.items == [] for r in decontaminate.scan(docs, items.limit(0)).collect())


def test_language_sample_is_that_of_all_hashes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(langid, "ROWS_PER_LANG", 5)
    bounded = langid.train(docs)
    monkeypatch.setattr(langid, "SPARE_DRAW", 1e9)
    whole = langid.train(docs)
    assert bounded.langs == whole.langs and (bounded.weights == whole.weights).all()
    assert langid.hash_bound(1) == (1 << 63) - 1 and abs(langid.hash_bound(10**9)) < 1 << 63
    assert langid.train(docs.limit(0)).langs == []


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    seen = langid.held_out("doc_id")
    model = langid.train(docs.where(~seen))
    got = langid.identify(docs.where(seen), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert np.mean([r.accepted for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (None, "the and of the"), (5, "ñ"), (6, "the with and " * 60_000), (6, "the with and " * 60_000)]
    odd = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, lang_pred string, Score double")
    got = langid.identify(odd, model).collect()
    assert [(r.lang_pred, r.score, r.accepted) for r in got if r.doc_id in (1, 2, 3)] == [("und", 0.0, False)] * 3
    assert all(r.lang_pred in model.langs for r in got if r.doc_id not in (1, 2, 3))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 6}) == 1
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.limit(0), model).collect() == []
    assert langid.train(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).langs == []


def test_licences_of_texts_and_lines(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + licences.MIT.upper().replace(",", " ;") + "\n"
    rows = [
        (1, mit),
        (2, "text before\nReleased under the MIT licence!\nLicensed under CC BY-NC 4.0."),
        (3, "text Released under the MIT License."),
        (4, None),
        (5, ""),
        (6, "x " * 50_000 + "\nSPDX-License-Identifier: Apache-2.0"),
        (7, "custom terms"),
        (7, "custom terms"),
        (None, licences.ISC),
    ]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id or 0, r.licence, r.notices) for r in licences.scan(docs, licences.known_digests(spark)).collect()), key=str)
    assert got == sorted([(1, "MIT", []), (2, None, ["CC-BY-NC-4.0", "MIT"]), (3, None, []), (4, None, []), (5, None, []), (6, None, ["Apache-2.0"]), (7, None, []), (7, None, []), (0, "ISC", [])], key=str)
    own = licences.known_digests(spark, [("Own", "Custom, terms"), ("None", None)])
    assert [r.licence for r in licences.scan(docs, own).collect() if r.doc_id == 7] == ["Own", "Own"]
    assert licences.scan(docs.limit(0), own).collect() == []


def test_known_licences_in_any_wrapping(spark):
    heads = ["", "Copyright (c) 2020 Some One\nAll rights reserved.\n\n", "Copyright Some One\nCopyright Some Body\n\n", "(c) Some One\n\n", "© Some One\n\n"]
    rows = []
    for name, text in licences.KNOWN:
        for width in (25, 40, 60, 72, 79, 100, 10_000):
            for head in heads:
                body = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False) for p in text.split("\n\n"))
                rows.append((len(rows), head + body, name))
    breaks = "provided that the above\ncopyright notice and this permission notice appear in all copies."
    rows.append((len(rows), licences.ISC.replace("provided\nthat the above copyright notice and this permission notice appear in all copies.", breaks), "ISC"))
    assert breaks in rows[-1][1]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs, licences.known_digests(spark)).collect()}
    assert [(i, t, got[i]) for i, t, name in rows if got[i] != name] == []


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


TURNS = "array<struct<role:string,text:string>>"


def test_pairs_share_their_prompt(spark):
    head = turns(("system", "be kind"), ("user", "hi"))
    rows = [
        (1, head + turns(("assistant", "yes"), ("user", "more")), head + turns(("assistant", "nö")), "x"),
        (2, head, head, "x"),
        (3, head, head[:1], "x"),
        (4, turns(("user", "a")), turns(("user", "b")), "x"),
        (5, None, [], "x"),
        (6, turns(("user", "a" * 200_000)), turns(("user", "a" * 200_000), ("assistant", "b")), "x"),
    ]
    pairs = spark.createDataFrame(rows, f"pair_id long, chosen {TURNS}, rejected {TURNS}, prompt string")
    got = {r.pair_id: r for r in chat.preferences(pairs).collect()}
    assert [got[i].n_prompt_turns for i in range(1, 7)] == [2, 2, 1, 0, 0, 1]
    one = got[1]
    assert one.prompt == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
    assert [one.chosen[s.start : s.stop] for s in one.chosen_spans] == ["yes<|im_end|>"]
    assert [one.rejected[s.start : s.stop] for s in one.rejected_spans] == ["nö<|im_end|>"]
    assert (got[2].chosen, got[2].rejected, got[2].chosen_spans) == ("", "", [])
    assert got[3].rejected == "" and got[4].prompt == "" and got[5].prompt == ""
    assert got[6].chosen == "" and [got[6].rejected[s.start : s.stop] for s in got[6].rejected_spans] == ["b<|im_end|>"]
    assert chat.preferences(pairs.limit(0)).collect() == []


def test_conversations_with_nulls_ties_and_clashes(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, "a"), (1, 1, "assistant", None), (None, 0, "user", "q"), (2, None, "user", "z"), (2, 0, "assistant", "y")]
    frame = spark.createDataFrame([(*r, [1]) for r in rows], "conv_id long, turn long, role string, text string, TURNS array<int>")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.conversations(frame).collect()}
    assert got == {1: [("", "a"), ("assistant", ""), ("user", "b")], None: [("user", "q")], 2: [("user", "z"), ("assistant", "y")]}
    assert {r.pair_id for r in chat.repeating(chat.conversations(frame)).collect()} == {1, 2}
    assert chat.conversations(frame.limit(0)).collect() == []


def plain_without_holders(text):
    """Lines that name a holder made blank, by looking at each line and its neighbours."""
    import re

    lines = text.lower().split("\n")

    def kind(x):
        java = lambda p: p.replace(r"\z", r"\Z").replace(r"\p{L}\p{N}_", r"\w").replace(r"^\p{L}\p{N}", r"\W_").replace(r"[\p{L}\p{N}<\[]", r"(?:[^\W_]|[<\[])")
        if re.search(java(licences.BLANK), x):
            return "_"
        if re.search(java(licences.SIGNED).replace(r"[\W_]*", r"(?:\W|_)*"), x):
            return "S"
        if re.search(java(licences.NAMED), x) and not re.search(java(licences.SENTENCE).replace(r"[^\w]", r"\W"), x):
            return "N"
        return "A" if re.search(java(licences.ALONE), x) else "o"

    k = [kind(x) for x in lines]
    blank, out = set("_S"), list(k)
    for i, c in enumerate(k):
        before = out[i - 1] if i else "_"
        if c == "N" and (before in blank or (before == "X" and k[i - 1] == "N")):
            out[i] = "X"
    for i, c in enumerate(out):
        if c == "N" and (i + 1 == len(k) or k[i + 1] in blank):
            out[i] = "X"
    done = list(out)
    for i, c in enumerate(out):
        if c == "A" and (i == 0 or out[i - 1] in blank | {"X"}) and (i + 1 == len(out) or out[i + 1] in blank | {"X"}):
            done[i] = "X"
    return "\n".join(" " if c in "SX" else x for c, x in zip(done, lines, strict=True))


def test_holder_lines_by_their_neighbours(spark):
    rng = np.random.default_rng(6)
    pool = ["", " \t", "copyright someone", "Copyright (c) 2020 x", "copyright notice and more", "(c) a firm", "(c) the sentence goes on;", "text", "© all", "all rights reserved.", "Copyright 1999", "copyright: <name>\r", "copyright"]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 12))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in docs.select("i", licences.without_holders(F.lower("t")).alias("c")).collect()}
    assert got == {i: plain_without_holders(t) for i, t in enumerate(texts)}


def test_long_runs_of_copyright_lines(spark):
    names = "\n".join(f"copyright someone {i}" for i in range(100_000))
    texts = [(1, names + "\n\n" + licences.ISC), (2, "(c) " + "a " * 200_000), (3, "copyright " * 100_000), (4, "\n" * 300_000 + licences.UNLICENSE)]
    got = {r.doc_id: r.licence for r in licences.scan(spark.createDataFrame(texts, "doc_id long, text string"), licences.known_digests(spark)).collect()}
    assert got == {1: "ISC", 2: None, 3: None, 4: "Unlicense"}


def test_twin_has_the_same_rule(spark, tmp_path):
    rng = np.random.default_rng(8)
    pool = ["", "copyright someone", "Copyright (c) 2020 x", "copyright notice", "(c) a firm", "text", "MIT License", "Released under the MIT License.", "copyright: <name>\r"]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 9))) for _ in range(200)] + [None, "", "Copyright A\n\n" + licences.ISC, "copyright a\ncopyright b\n" + licences.MIT]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(licences.SQL).fetchall()}
    got = {r.doc_id: (r.digest, r.licence, r.notices) for r in licences.op4_licences(spark, str(tmp_path)).collect()}
    assert got == want and {v[1] for v in got.values()} >= {"ISC", "MIT"}
