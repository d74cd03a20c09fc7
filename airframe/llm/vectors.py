"""Near duplicates among embeddings by a forest of random-projection trees.

A tree splits its rows again and again along random directions, at the sparsest place near the middle, and rows
close to a split go to both sides. Trees are fitted on bounded samples of a node's rows, in Spark and a few levels
at a time, until leaves are small or so dense that a split would only part links. Rows are compared within the
leaves of every tree; a pair that shares several leaves counts in the one with the smallest id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import pick, query, stored, table, tied
from airframe.llm.graph import components

SIMILARITY = 0.9
TREES = 8
#: Rows of a sample that a node is fitted on, of a leaf, of a block of a leaf that is left dense, of a part of a node.
FIT_ROWS, LEAF_ROWS, BLOCK_ROWS, PART_ROWS = 2048, 1000, 1024, 8192
#: Half the width of the overlap at a split, in deviations of a random projection (one over the root of the dimension).
SPILL = 0.16
SEED = 11


def usable(batches):
    """Unit vectors of rows that have one; a vector that is NULL, zero, or has a NULL or non-finite part has none."""
    schema = pa.schema([("row", pa.int64()), ("size", pa.int32()), ("unit", pa.list_(pa.float64()))])
    for batch in batches:
        rows, sizes, units = [], [], []
        for row, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = vector.values
            if values is None or len(values) == 0 or values.null_count:
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.abs(x).max()
            if np.isfinite(x).all() and top > 0:
                x = x / top  # squares of very large or small parts stay finite
                rows.append(row)
                sizes.append(len(x))
                units.append(x / np.sqrt((x * x).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sizes, pa.int32()), pa.array(units, pa.list_(pa.float64()))], schema=schema)


# ---------------------------------------------------------------- trees


def split(x: np.ndarray, direction: np.ndarray, margin: float) -> tuple[float, float]:
    """Place of the sparsest split between the tenths at both ends, and the share of rows that it copies."""
    along = np.sort(x @ direction)
    shares = np.linspace(0.1, 0.9, 33)
    places = along[(shares * (len(along) - 1)).astype(int)]
    inside = (np.searchsorted(along, places + margin, "right") - np.searchsorted(along, places - margin)) / len(along)
    best = int((inside + 0.3 * np.abs(shares - 0.5)).argmin())
    return float(places[best]), float(inside[best])


def grow(x: np.ndarray, least: float, rng: np.random.Generator) -> list[tuple]:
    """Nodes of a subtree in preorder: ``(direction, place, left, right)``, or ``None`` for a leaf and ``()`` for a
    leaf that is dense: each of several directions would copy or part more than half of it."""
    nodes: list[tuple] = []

    def build(x: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(x) <= max(least, 16):
            return at
        margin = SPILL / np.sqrt(x.shape[1])
        for _ in range(4):
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            place, copied = split(x, direction, margin)
            if copied <= 0.5:
                along = x @ direction
                left, right = build(x[along <= place + margin]), build(x[along >= place - margin])
                nodes[at] = (direction, place, left, right)
                return at
        nodes[at] = ()
        return at

    build(x)
    return nodes


def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Subtree of one node from its sample: a row per inner node and leaf."""
    tree, leaf = key
    x, total = np.stack(frame["unit"].to_numpy()), int(frame["total"].iloc[0])
    rng = np.random.default_rng([SEED, int(tree), int(leaf) & 0xFFFFFFFF, int(leaf) >> 32 & 0xFFFFFFFF])
    nodes = grow(x, LEAF_ROWS * len(x) / total, rng)
    out = [(i, list(n[0]), n[1], n[2], n[3], False) if n else (i, None, 0.0, -1, -1, n == ()) for i, n in enumerate(nodes)]
    cells = pd.DataFrame(out, columns=["at", "direction", "place", "left", "right", "dense"])
    return pd.DataFrame({"tree": [tree], "leaf": [leaf], "nodes": [cells.to_dict("records")]})


NODES = "array<struct<at:int,direction:array<double>,place:double,left:int,right:int,dense:boolean>>"
MEMBER = "tree int, leaf long, row long, done boolean"


def descend(key: tuple, rows: pd.DataFrame, subtree: pd.DataFrame) -> pd.DataFrame:
    """Leaves that some rows of a node reach in its subtree; leaf ids are hashes of tree, node and place in it."""
    tree, leaf, _ = key
    nodes, row, x = subtree["nodes"].iloc[0], rows["row"].to_numpy(), np.stack(rows["unit"].to_numpy())
    margin, todo, out = SPILL / np.sqrt(x.shape[1]), [(0, np.arange(len(row)))], []
    while todo:
        at, those = todo.pop()
        node = nodes[at]
        if node["direction"] is None:
            # a node left whole keeps its name, so that a root which no tree splits is one leaf and not one for each
            name = int(mixed(np.array([leaf, tree, at], np.int64).view(np.uint64))) if at else int(leaf)
            out.append(pd.DataFrame({"tree": np.int32(tree), "leaf": name, "row": row[those], "done": bool(node["dense"])}))
            continue
        along = x[those] @ np.asarray(node["direction"])
        todo.append((node["left"], those[along <= node["place"] + margin]))
        todo.append((node["right"], those[along >= node["place"] - margin]))
    return pd.concat(out)


def mixed(words: np.ndarray) -> np.int64:
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for w in words:
            h = (h ^ w) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h.astype(np.int64)


def leaves(points: DataFrame, trees: int) -> DataFrame:
    """``(leaf, row)``: the leaves of all trees that each row reaches."""
    now = points.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.col("size").cast("long").alias("leaf"), "row", F.lit(False).alias("done"))
    ended = None
    while True:
        sizes = now.where("NOT done").groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("total")).where(f"total > {LEAF_ROWS}")
        sizes = stored(sizes, "nodes")
        if sizes.isEmpty():
            return (now if ended is None else ended.union(now)).select("leaf", "row")
        keep = now.join(sizes, ["tree", "leaf"], "left_anti")
        ended = keep if ended is None else ended.union(keep)
        open_ = now.join(sizes, ["tree", "leaf"]).where("NOT done").join(points.select("row", "unit"), "row")
        sample = open_.where(f"pmod(xxhash64(row, tree, leaf), total) < {FIT_ROWS}")
        fitted = sample.groupBy("tree", "leaf").applyInPandas(fit, f"tree int, leaf long, nodes {NODES}")
        # a subtree goes to every part of its node's rows once, not to every row
        open_ = open_.select("tree", "leaf", F.expr(f"pmod(xxhash64(row), total div {PART_ROWS} + 1)").alias("part"), "row", "unit")
        fitted = stored(fitted, "trees").join(sizes, ["tree", "leaf"])
        fitted = fitted.select("tree", "leaf", F.explode(F.expr(f"sequence(0L, total div {PART_ROWS})")).alias("part"), "nodes")
        parts = open_.groupBy("tree", "leaf", "part").cogroup(fitted.groupBy("tree", "leaf", "part"))
        now = stored(parts.applyInPandas(descend, MEMBER), "leaves")


# ---------------------------------------------------------------- comparison


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest leaf that two rows share, by sorted rows of leaf ids, padded with different values."""
    same = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return a[np.arange(len(a)), same.argmax(axis=1)]


def padded(lists: list, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def compare(similarity: float):
    """For a pair of blocks of one leaf: how many links each row has that count here, copies of the other end included,
    and a row it is tied to."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        leaf, i, j = key
        x, rows = np.stack(frame["unit"].to_numpy()), frame["row"].to_numpy()
        own = [np.sort(v) for v in frame["own"]]
        left = padded(own, -1)
        right = padded(own, -2)
        first = np.flatnonzero(frame["block"].to_numpy() == i)
        second = first if i == j else np.flatnonzero(frame["block"].to_numpy() == j)
        us, vs = [], []
        for k in range(0, len(first), 256):
            a, b = np.nonzero(x[first[k : k + 256]] @ x[second].T >= similarity)
            u, v = first[k + a], second[b]
            if i == j:
                u, v = u[u < v], v[u < v]
            for n in range(0, len(u), 4096):
                p, q = u[n : n + 4096], v[n : n + 4096]
                here = first_shared(left[p], right[q]) == leaf
                us.append(p[here])
                vs.append(q[here])
        u, v = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (us, vs))
        if not len(u):
            return pd.DataFrame({"row": [], "links": [], "least": []}).astype("int64")
        copies, links = frame["copies"].to_numpy(), np.zeros(len(rows), np.int64)
        np.add.at(links, u, copies[v])
        np.add.at(links, v, copies[u])
        nodes, least = tied(rows[u], rows[v])
        place = pd.Series(links, index=rows)
        return pd.DataFrame({"row": nodes, "links": place.loc[nodes].to_numpy(), "least": least})

    return run


def near_vectors(vectors: DataFrame, id="vec_id", vector="embedding", similarity=SIMILARITY, trees=TREES) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows are linked when their cosine, in double precision, is at least ``similarity``. A vector that is NULL, empty,
    zero, or holds a NULL or non-finite part links with nothing, nor do vectors of different length. Equal
    vectors are linked; repeated ids are rows of their own. The component is named by its smallest id; rows
    with a NULL id are compared too and not kept. An empty table gives no rows.

    Equal unit vectors are compared as one, with their number. A leaf that stays larger than a block is compared in pairs
    of blocks, so no task holds more than two of them. Links are counted where they are found; no list of pairs is made.
    """
    rows = stored(pick(vectors, vec_id=id, embedding=vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    points = rows.select("row", "embedding").where("embedding IS NOT NULL").mapInArrow(usable, "row long, size int, unit array<double>")
    points = stored(points.withColumns({"ka": F.xxhash64("unit"), "kb": F.xxhash64(F.lit(1), "unit")}), "points")
    same = stored(points.groupBy("size", "ka", "kb").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")), "copies")
    copy_of = points.select("row", "size", "ka", "kb").join(same, ["size", "ka", "kb"]).select("row", "first", "copies")
    points = points.join(same.select(F.col("first").alias("row"), "copies"), "row").select("row", "size", "unit", "copies")
    points = stored(points, "distinct")
    members = stored(leaves(points, trees).distinct(), "members")
    own = members.groupBy("row").agg(F.array_sort(F.collect_list("leaf")).alias("own"))
    blocks = members.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", F.expr(f"n div {BLOCK_ROWS} + 1").alias("blocks"))
    placed = members.join(blocks, "leaf").withColumn("block", F.expr("pmod(xxhash64(row), blocks)"))
    placed = placed.join(points.select("row", "unit", "copies").join(own, "row"), "row")
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "unit", "copies", "own")
    found = stored(met.groupBy("leaf", "i", "j").applyInPandas(compare(similarity), "row long, links long, least long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("row").alias("u"), F.col("least").alias("v"))).select(F.col("node").alias("row"), "component")
    found_of = copy_of.join(links.withColumnRenamed("row", "first"), "first", "left").join(groups.withColumnRenamed("row", "first"), "first", "left")
    found_of = found_of.select("row", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    named = rows.select("vec_id", "row").join(found_of, "row", "left").withColumn("component", F.coalesce("component", "row"))
    names = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = named.join(names, "component").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@query("op10_vectors")
def op10_vectors(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))
