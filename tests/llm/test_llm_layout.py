"""Mixtures, shards, URL rules, vectors and the pipeline next to plain versions."""

import math
import time
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from airframe.llm import decontaminate, langid, mixing, sharding, simhash, urls, vectors


def test_no_source_is_a_block_off_its_weight(spark):
    sizes = {"a": 3000, "b": 700, "c": 90, None: 400, "": 50}
    rows = [(i, s, "x") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, Slot string")
    weights = {"a": 5, "b": 3, "c": 1, None: 2}
    got = mixing.mix(docs, weights=weights, resolution=110, block_rows=10).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "source", "block", "slot", "offset"}
    assert len({(r.slot, r.offset) for r in got}) == len(rows)
    at = defaultdict(set)
    for r in got:
        at[r.source].add(r.slot)
    assert sum(map(len, at.values())) == len(set().union(*at.values()))  # a slot has one source
    shares = {"a": 50, "b": 30, "c": 10, None: 20, "": 1}
    for source, share in shares.items():
        slots = np.array(sorted(at[source]))
        done = np.searchsorted(slots, np.arange(slots[-1] + 1), "right")  # as long as the source lasts
        assert np.abs(done - (np.arange(slots[-1] + 1) + 1) * share / 111).max() < 1
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("weights", [{"a": 7, "b": 3, "c": 1}, {"a": 0.7, "b": 0.3, "c": 0.1}])
def test_given_weights_are_met_at_default_settings(spark, weights):
    rows = [(i, s) for s, n in {"a": 9000, "b": 4000, "c": 1500}.items() for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_rows=1).collect()
    last = min(max(r.slot for r in got if r.source == s) for s in weights)  # as long as all sources last
    assert last > 10_000
    for source, weight in weights.items():
        done = np.searchsorted(sorted(r.slot for r in got if r.source == source), np.arange(last + 1), "right")
        assert np.abs(done - (np.arange(last + 1) + 1) * weight / sum(weights.values())).max() < 1


def test_mixture_of_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "s", "t")] * 40 + [(None, "s", None)] * 7 + [(2, None, "u")] * 3, "doc_id long, source string, text string")
    got = mixing.mix(docs, block_rows=4)
    assert sorted(map(str, got.select("doc_id", "source", "text").collect())) == sorted(map(str, docs.collect()))
    ordered = mixing.in_order(mixing.mix(docs, block_rows=4))
    assert ordered.columns == docs.columns and ordered.count() == 50


def plain_shards(sizes, shards):
    total, before, out = sum(sizes), 0, []
    for s in sizes:
        out.append((2 * before + s) * shards // (2 * total))
        before += s
    return out


def test_shards_are_contiguous_even_and_gapless(spark):
    rng = np.random.default_rng(2)
    texts = ["é" * int(n) for n in rng.integers(0, 300, 900)] + [None, "", "z" * 40_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    got = sorted(sharding.shard_keys(docs, shards=7).collect())
    sizes = [len((t or "").encode()) + 16 for t in texts]
    assert [r.size for r in got] == sizes
    assert [r.shard for r in got] == plain_shards(sizes, 7)
    for k in {r.shard for r in got}:
        assert [r.slot for r in got if r.shard == k] == list(range(sum(r.shard == k for r in got)))
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c")], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_keys(odd, shards=1).collect()) == [0, 1, 2, 3]
    assert sharding.shard_keys(docs.limit(0)).collect() == []
    assert sharding.with_shard(docs.limit(0), {"id": docs["doc_id"]}).collect() == []
    placed = sharding.with_shard(docs, {"id": docs["doc_id"]}, shards=7)
    want = {k: i for i, k in enumerate(sorted({r.shard for r in got}))}
    assert {r.doc_id: r.shard for r in placed.collect()} == {r.doc_id: want[r.shard] for r in got}


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for mark in "/?#":
        host = host.split(mark, 1)[0]
    path = rest[len(host) :]
    for mark in "?#":
        path = path.split(mark, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[1] + best[2], best[3]) if best else (host, path, None, "allow")


def test_url_rules_next_to_every_rule(spark):
    rng = np.random.default_rng(4)
    hosts = ["org", "example.org", "www.example.org", "a.b.com", "com", "notexample.org", "example.org.", "", ".org", "EXAMPLE.ORG", "bücher.org", "x.org:80"]
    paths = ["", "/", "/es", "/es/", "/es/a?b#c", "/en/1", "/en/12", "/fr/x", "/de/", "?q=/es/", "#/es/", "/a\nb"]
    page = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(600)] + [None, "", "no scheme", "://", "a://b://c/d", "http://hot.com/de/"] * 3
    page += ["http://hot.com/de/x"] * 700
    frame = spark.createDataFrame([(i, u, "k", "h") for i, u in enumerate(page)], "page_id long, url string, key string, HOST string")
    rules = [*urls.FIXED_RULES, ("hot.com", "/de/x", "allow"), ("b.com", "/fr", "block"), ("org", "/es/a", "block")]
    table = spark.createDataFrame([*rules, (None, "/", "block"), ("hot.com", None, "block")], urls.RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, table).collect()}
    assert got == {i: plain_verdict(u, rules) for i, u in enumerate(page)}
    assert urls.judge(frame.limit(0), table).collect() == []
    assert {r.verdict for r in urls.judge(frame, table.limit(0), default="block").collect()} == {"block"}


def test_a_very_long_path_costs_no_more_than_its_rules(spark):
    deep = "/" + "a" * 4000
    rules = [("org", "/", "allow"), ("org", deep, "block"), ("org", "", "block"), ("org", "/" + "a" * 100, "block")]
    paths = ["/" + "a" * n for n in (99, 100, 3999, 4000, 400_000)] + ["", "/b"]
    frame = spark.createDataFrame([(i, "http://x.org" + p) for i, p in enumerate(paths)], "page_id long, url string")
    start = time.perf_counter()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, spark.createDataFrame(rules, urls.RULES)).collect()}
    assert got == {i: plain_verdict("http://x.org" + p, rules) for i, p in enumerate(paths)}
    assert urls.longest([("k", "org", dict.fromkeys(["/", deep], "block"), [-4001, -1])], "/" + "a" * 3_000_000)[2] == deep
    assert time.perf_counter() - start < 60


def test_vectors_next_to_all_pairs(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2500, 24))
    dense = rng.standard_normal(24) + 0.08 * rng.standard_normal((1400, 24))  # a leaf of its own that needs blocks
    near = x[:300] + 0.25 * rng.standard_normal((300, 24))
    x = np.concatenate([x, dense, near, 1e100 * x[:20], x[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 24), (9002, [1.0, None] * 12), (9003, [math.nan] * 24), (9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9006, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, row string")
    got = vectors.near_vectors(frame).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    links = {r.vec_id: r.n_links for r in got if r.vec_id < 9000}
    found = sum(links.values())
    assert found <= close.sum() and found >= 0.99 * close.sum()
    assert all(links[i] <= n for i, n in enumerate(close.sum(axis=1).tolist()))
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(close, label[None, :], len(x)).min(axis=1))
        if (new == label).all():
            break
        label = new
    assert np.mean([r.component_id == label[r.vec_id] for r in got if r.vec_id < 9000]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    odd = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id >= 9000)
    assert odd == [(9000, 0, 9000), (9001, 0, 9001), (9002, 0, 9002), (9003, 0, 9003), (9004, 0, 9004), (9005, 2, 9005), (9006, 2, 9005), (9006, 2, 9005)]
    assert vectors.near_vectors(frame.limit(0)).collect() == []


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.standard_normal((3, 16))
    near = a + 0.02 * np.abs(a).max() * rng.standard_normal(16)
    rows = [(i, (a * 2.0 ** (i % 5)).tolist()) for i in range(30_000)] + [(40_000 + i, near.tolist()) for i in range(7)] + [(50_000, b.tolist()), (50_001, (-a).tolist()), (60_000, c.tolist()), (60_000, c.tolist())]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    counted = {(r.n_links, r.component_id): r.n for r in got.groupBy("n_links", "component_id").agg({"*": "count"}).toDF("n_links", "component_id", "n").collect()}
    assert counted == {(30_006, 0): 30_007, (0, 50_000): 1, (0, 50_001): 1, (1, 60_000): 2}


def test_dense_vectors_are_compared_once(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal(24) + 0.1 * rng.standard_normal((3000, 24))  # no tree splits their root
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(3000)] == want.tolist()


def plain_kept(rows):
    """Smallest id of each group, from all pairs of sets of shingles."""
    sets = [set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    return {min(g) for g in groups.values()}


def plain_mixture(rows):
    sources = defaultdict(list)
    for r in sorted(rows, key=lambda r: (__import__("hashlib").md5(str(r.doc_id).encode()).hexdigest(), r.doc_id)):
        sources[r.source].append(r.doc_id)
    names = sorted(sources)
    roots = [math.isqrt(len(sources[n])) for n in names]
    share = [max(1, mixing.RESOLUTION * x // sum(roots)) for x in roots]
    period, done, order = sum(share), [0] * len(names), []
    left = {n: list(v) for n, v in sources.items()}
    slot = 0
    while any(left.values()):
        t = slot % period
        if t == 0:
            done = [0] * len(names)
        due, k = min((-(-(done[k] + 1) * period // q), k) for k, q in enumerate(share) if done[k] * period // q <= t)
        done[k] += 1
        slot += 1
        order += left[names[k]][: mixing.BLOCK_ROWS]
        left[names[k]] = left[names[k]][mixing.BLOCK_ROWS :]
    return order


def test_pipeline_stage_by_stage_next_to_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    rows = sorted(docs.collect())
    model = langid.train(docs)
    answers = {r.doc_id: model.score(langid.bag(r.text)) for r in rows}
    want = [r for r in rows if answers[r.doc_id][0] != "und" and answers[r.doc_id][1] >= model.threshold]
    bench = [(r.item_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = decontaminate.Windows(bench, 10)

    path = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        path.append(docs)
    kept = [sorted(d.collect()) for d in path]
    assert kept[0] == want and all(d.columns == path[0].columns for d in path[:4])
    ids = plain_kept(want)
    want = [r for r in want if r.doc_id in ids]
    assert kept[1] == want
    want = [r for r in want if not windows.scan(decontaminate.words_of((r.text or "").encode()))[0]]
    assert kept[2] == want
    order = plain_mixture(want)
    mixture = path[3].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index")
    assert kept[3] == want and [r.doc_id for r in mixture.collect()] == order
    size = {r.doc_id: len((r.text or "").encode()) + 16 for r in want}
    shards = plain_shards([size[i] for i in order], sharding.SHARDS)
    number = {k: i for i, k in enumerate(sorted(set(shards)))}
    assert {r.doc_id: r.shard for r in path[4].collect()} == {i: number[k] for i, k in zip(order, shards, strict=True)}
    assert [r[:5] for r in kept[4]] == [tuple(r) for r in want]


def awkward(spark):
    rows = [(1, None, None, None, None), (None, "the and of with " * 9, "en", "s", 3), (None, "the and of with " * 9, "en", "s", 3), (3, "", "en", "", 0), (4, "la le " * 90_000, None, "t", 1), (4, "123", "fr", None, 1)]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, slot int, shard string")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, sf, name, stage):
    docs = awkward(spark)
    got = stage(spark, docs, sf)
    assert got.count() <= 6
    assert name == "language" or got.count() >= 4
    assert stage(spark, docs.limit(0), sf).count() == 0
