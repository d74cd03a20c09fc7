"""SimHash fingerprints and near-duplicate groups by a Gray-order hierarchical index.

Fingerprints are sorted by their rank in the reflected Gray code, so that neighbours share long bit patterns.
Runs of them form blocks; the bits that all members of a block share are factored into its header (mask and
value), the bits that blocks share into the header of their parent, and so on up to one root. The index is
joined with itself from the root down: a pair of nodes is followed only while the differences on the bits that
both have fixed stay within the radius, so whole groups are dropped at once. Nothing but headers moves until a
pair of blocks is left, and a pair of blocks is compared leaf by leaf in the same way inside one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import acos, pi, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import arrow_of, by_row, partitions, pick, query, stored, table, tied
from airframe.llm.graph import components

BITS = 64
SEED = 42
#: Members of a block and of a leaf, children of a node (a power of two).
BLOCK, LEAF, FANOUT = 1024, 32, 64
LANES = np.uint64(0x0101010101010101)


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes | None, words: int) -> np.ndarray:
    """XXH64 of the shingles of a text, repeats included; the whole sequence when it has fewer words.

    Only A-Z are lower-cased, only ASCII white space parts words.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    pieces = (joined[a:z] for a, z in zip(starts, ends[words - 1 :].tolist(), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each row of a matrix of hashes the bits set in over half of its hashes; 0 without hashes."""
    lanes, n = hashes.shape
    if not n:
        return np.zeros(lanes, np.uint64)
    cuts, sums = np.arange(0, n, 255), np.empty((lanes, 8, 8), np.int64)
    for k in range(8):  # eight counters of a byte each share a word, for 255 hashes at most
        part = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts, axis=1)
        sums[:, :, k] = part.view(np.uint8).reshape(lanes, -1, 8).sum(axis=1, dtype=np.int64)
    return packed(2 * sums.reshape(lanes, BITS) > n)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, lowest first, as words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes | None, words: int) -> int:
    return int(majority(shingle_hashes(text, words)[None, :]).view(np.int64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; texts without words, and NULL, have fingerprint 0."""
    rows = pick(docs, doc_id=id, text=text).select("doc_id", F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", arrow_of(rows, "doc_id")), ("fp", pa.int64())])
    return rows.mapInArrow(by_row(lambda key, body: (key, fingerprint(body, words)), schema), f"doc_id {kind}, fp long")


# ---------------------------------------------------------------- index


def gray_rank(code: Column) -> Column:
    """Rank of a 64-bit code in the reflected Gray code, shifted so that signed order is rank order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


BLOCKS = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("mask", pa.int64()), ("value", pa.int64()), ("codes", pa.binary())])


def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition whose codes come in Gray order, each with its shared pattern; further columns follow the codes."""
    part, seq, rest = TaskContext.get().partitionId(), 0, None

    def block(cut: np.ndarray) -> pa.RecordBatch:
        mask, value = shared(cut[0].view(np.uint64), np.array([0]))
        cells = ([part], [seq], mask.view(np.int64), value.view(np.int64), [cut.tobytes()])
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cells, BLOCKS, strict=True)], schema=BLOCKS)

    for batch in batches:
        new = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        rest = new if rest is None else np.concatenate([rest, new], axis=1)
        while rest.shape[1] >= BLOCK:
            yield block(rest[:, :BLOCK])
            rest, seq = rest[:, BLOCK:], seq + 1
    if rest is not None and rest.shape[1]:
        yield block(rest)


def shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and value of the bits that the codes of each run have in common."""
    every, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    mask = ~(every ^ some)
    return mask, every & mask


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of two blocks that differ in at most ``radius`` bits, leaf patterns first."""
    sa, sb = np.arange(0, len(a), LEAF), np.arange(0, len(b), LEAF)
    (ma, va), (mb, vb) = shared(a, sa), shared(b, sb)
    near = np.bitwise_count((va[:, None] ^ vb[None, :]) & ma[:, None] & mb[None, :]) <= radius
    la, lb = np.nonzero(near)
    inner, us, vs = np.arange(LEAF), [], []
    for k in range(0, len(la), 512):
        x = a[np.minimum(sa[la[k : k + 512], None] + inner, len(a) - 1)]
        y = b[np.minimum(sb[lb[k : k + 512], None] + inner, len(b) - 1)]
        i, j, m = np.nonzero(np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= radius)
        us.append(x[i, j])
        vs.append(y[i, m])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def block_links(radius: int):
    """For ``mapInArrow`` over pairs of blocks: each code tied to the smallest one it meets there, so that a
    pair of blocks gives no more rows than it has members, however many of them are close."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (0, 1))
                u, v = close_pairs(a, b, radius)
                apart = u != v
                if apart.any():
                    nodes, least = tied(u[apart].view(np.int64), v[apart].view(np.int64))
                    own = nodes != least
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], schema=schema)

    return run


def gray_links(codes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges ``(u, v)`` that connect all distinct codes (column ``fp``) within ``radius`` bits of each other.

    Range partitions of distinct codes are even whatever the data, so no group of close codes meets in one task.
    """
    met = close_blocks(codes.select("fp").where("fp IS NOT NULL").distinct(), radius)
    if met is None:
        return codes.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    return met.mapInArrow(block_links(radius), "u long, v long")


def close_blocks(codes: DataFrame, radius: int) -> DataFrame | None:
    """Pairs of blocks ``(left, right)`` of distinct codes that may hold close ones; None without codes."""
    spark, columns = codes.sparkSession, codes.columns
    ordered = codes.withColumn("rank", gray_rank(F.col("fp")))
    ordered = ordered.repartitionByRange(partitions(spark), "rank").sortWithinPartitions("rank").select(columns)
    blocks = stored(ordered.mapInArrow(cut_blocks, "part long, seq long, mask long, value long, codes binary"), "blocks")
    top_part, top_seq = blocks.agg(F.max("part"), F.max("seq")).first()
    if top_part is None:
        return None
    width = 1
    while width <= top_seq:
        width *= FANOUT
    blocks = blocks.withColumn("node", F.col("part") * width + F.col("seq"))
    levels, top = [blocks.select("node", "mask", "value")], top_part * width + top_seq
    while top > 0:
        top //= FANOUT
        levels.append(parents(levels[-1]))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        pairs = descend(pairs, level, radius)
    body = blocks.select("node", "codes")
    both = pairs.join(body.select(F.col("node").alias("a"), F.col("codes").alias("left")), "a")
    both = both.join(body.select(F.col("node").alias("b"), F.col("codes").alias("right")), "b")
    return both.select("left", "right")


def parents(level: DataFrame) -> DataFrame:
    """Nodes one step up: bits that all children have fixed to the same value."""
    up = level.groupBy(F.expr(f"node div {FANOUT}").alias("node"))
    up = up.agg(F.bit_and("mask").alias("m"), F.bit_and("value").alias("every"), F.bit_or("value").alias("some"))
    return up.selectExpr("node", "m & ~(every ^ some) AS mask", "every & m & ~(every ^ some) AS value")


def descend(pairs: DataFrame, level: DataFrame, radius: int) -> DataFrame:
    """Pairs of children whose fixed bits differ in no more than ``radius`` places."""

    def side(p: str) -> DataFrame:
        return level.selectExpr(f"node div {FANOUT} AS {p}", f"node AS {p}_node", f"mask AS {p}_mask", f"value AS {p}_value")

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.expr(f"a_node <= b_node AND bit_count((a_value ^ b_value) & a_mask & b_mask) <= {radius}")
    return met.where(near).selectExpr("a_node AS a", "b_node AS b")


# ---------------------------------------------------------------- groups


def near_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: documents whose fingerprints are linked by steps of at most ``radius`` bits.

    Equal fingerprints are one node, so copies cost nothing. The component is named by the smallest document id in
    it. NULL texts and texts without words have fingerprint 0 and are linked like any other; rows with a
    NULL id are grouped too, and a group of such rows only has a NULL component. Repeated rows stay repeated.
    An empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id, text, words), "fingerprints")
    tied_codes = components(gray_links(marked, radius))
    codes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    codes = codes.join(tied_codes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = codes.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = codes.join(names, "component").select("fp", "component_id")
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- similar texts

#: Lanes of 64 bits in a wide fingerprint, samples of a text's shingles, shingles in a sample (6 to 12, and half as many).
WIDE, SAMPLES, SAMPLE_SIZE = 16, 16, 6
#: Deviations from the similarity beyond which, and below which, wide fingerprints decide alone.
FAR, NEAR = 6.0, 4.0
_RANDOM = np.random.default_rng(SEED)
LANE_KEYS = _RANDOM.integers(0, 1 << 64, WIDE, dtype=np.uint64)
SAMPLE_KEYS = _RANDOM.integers(0, 1 << 64, SAMPLES, dtype=np.uint64) | np.uint64(1)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(text: bytes | None, words: int, distinct: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprint of a text's distinct shingles, and keys of the fingerprints of samples of them.

    A sample holds the shingles whose keyed hash falls below a limit, which halves as the text doubles. Texts that
    share most shingles share all of some samples; neighbouring sizes share one of the two limits.
    """
    distinct = np.unique(shingle_hashes(text, words)) if distinct is None else distinct
    wide = majority(stirred(distinct[None, :] ^ LANE_KEYS[:, None]))
    level, keys = max(0, (len(distinct) // SAMPLE_SIZE).bit_length() - 1), []
    if level == 0:
        keys.append(stirred(majority(distinct[None, :])))
    drawn = (distinct[None, :] * SAMPLE_KEYS[:, None]) >> np.uint64(63 - level)
    for at in (level, level + 1) if level else (1,):
        sample, member = np.nonzero(drawn <= (1 if at == level else 0))
        if len(sample):
            numbers, starts, sizes = np.unique(sample, return_index=True, return_counts=True)
            bits = np.unpackbits(distinct[member].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            keys.append(stirred(packed(2 * sums > sizes[:, None]) ^ stirred((at * SAMPLES + numbers).astype(np.uint64))))
    return wide, np.unique(np.concatenate(keys))


def limit(similarity: float, deviations: float) -> int:
    """Differing bits of wide fingerprints: what sets of this Jaccard similarity differ in on average, and so many
    deviations more."""
    bits, share = WIDE * BITS, acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + deviations * sqrt(bits * share * (1 - share)))


#: Sets of fewer shingles are always compared themselves: wide fingerprints say little about them.
SMALL = 64
#: Rows of a block of fingerprints, bytes of a block of sets, cells of a matrix of shared shingles.
FP_ROWS, SET_BYTES, CELLS = 1024, 4 << 20, 1 << 22
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def signatures(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """``(doc_id, row, twin, fp, node, proof, n, wide, keys)`` per row.

    ``row, twin`` are two hashes of id and text, ``node, proof`` two hashes of the sorted distinct shingles, so that
    neither rows nor sets are taken for each other; ``fp`` is the first lane of ``wide``, ``n`` the size of the set.
    """
    rows = pick(docs, doc_id=id, text=text).select("doc_id", *row_marks("doc_id", "text"), F.col("text").cast("binary"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    whole = [(c, pa.int64()) for c in ("row", "twin", "fp", "node", "proof", "n")]
    schema = pa.schema([("doc_id", arrow_of(rows, "doc_id")), *whole, ("wide", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def one(key, row, twin, body):
        distinct = np.unique(shingle_hashes(body, words))
        wide, keys = signature(body, words, distinct)
        packed_set = distinct.tobytes()
        node, proof = (np.uint64(xxhash.xxh64_intdigest(packed_set, seed)).astype(np.int64) for seed in (SEED, SEED + 1))
        return key, row, twin, int(wide.view(np.int64)[0]), int(node), int(proof), len(distinct), wide.tobytes(), keys.view(np.int64)

    return rows.mapInArrow(by_row(one, schema), f"doc_id {kind}, row long, twin long, fp long, node long, proof long, n long, wide binary, keys array<long>")


def row_marks(id: str | Column, text: str | Column) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text."""
    return F.xxhash64(id, text).alias("row"), F.xxhash64(F.lit(1), text, id).alias("twin")


def shingle_sets(docs: DataFrame, id: str, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """``(node, shingles)``: the sorted distinct hashes, packed, of the texts that ``wanted`` (``row, twin, node``) names."""
    rows = pick(docs, doc_id=id, text=text).select(*row_marks("doc_id", "text"), F.col("text").cast("binary"))
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    found = rows.join(wanted, ["row", "twin"]).dropDuplicates(["node"]).select("node", "text")
    return found.mapInArrow(by_row(lambda node, body: (node, np.unique(shingle_hashes(body, words)).tobytes()), schema), "node long, shingles binary")


class Group(NamedTuple):
    """Members of one side of a block: nodes, their labels, sizes of their sets and wide fingerprints."""

    node: np.ndarray
    label: np.ndarray
    n: np.ndarray
    wide: np.ndarray

    @staticmethod
    def of(rows: list[dict]) -> Group:
        node, label, n = (np.array([r[c] for r in rows], np.int64) for c in ("node", "label", "n"))
        return Group(node, label, n, np.frombuffer(b"".join(r["wide"] for r in rows), np.uint64).reshape(-1, WIDE))

    def cut(self, at: slice) -> Group:
        return Group(*[x[at] for x in self])


def judged(x: Group, y: Group, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members with different labels that fingerprints settle as similar, and those they leave open.

    Sets whose sizes are too far apart can't be similar. Between the rest, differing bits ``FAR`` deviations beyond the
    similarity rule a pair out and ``NEAR`` below it settle it; pairs with a small set stay open.
    """
    bits = np.zeros((len(x.node), len(y.node)), np.int32)
    for lane in range(WIDE):
        bits += np.bitwise_count(x.wide[:, lane, None] ^ y.wide[None, :, lane])
    less, more = np.minimum(x.n[:, None], y.n[None, :]), np.maximum(x.n[:, None], y.n[None, :])
    able = (x.label[:, None] != y.label[None, :]) & (less >= similarity * more)
    small = less < SMALL
    sure = able & ~small & (bits <= limit(similarity, -NEAR))
    return sure, able & ~sure & (small | (bits <= limit(similarity, FAR)))


def tied_edges(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch | None:
    """The pairs as edges from each node to the smallest one that it is tied to, no more than there are nodes."""
    if not u:
        return None
    nodes, least = tied(np.concatenate(u), np.concatenate(v))
    own = nodes != least
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], schema=EDGE) if own.any() else None


def sure_edges(similarity: float):
    """For ``mapInArrow`` over blocks ``(xs, ys)``: edges that connect the pairs that fingerprints settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (Group.of(column[i].as_py()) for column in batch.columns)
                us, vs = [], []
                for k in range(0, len(x.node), 128):
                    part = x.cut(slice(k, k + 128))
                    a, b = np.nonzero(judged(part, y, similarity)[0])
                    if len(a):
                        us.append(part.node[a])
                        vs.append(y.node[b])
                if (edges := tied_edges(us, vs)) is not None:
                    yield edges

    return run


def open_members(similarity: float):
    """For ``mapInArrow`` over ``(key, xs, ys)``: the nodes of each block that some pair leaves open, with the key."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (Group.of(column[i].as_py()) for column in batch.columns[1:])
                found = [np.zeros(0, np.int64)]
                for k in range(0, len(x.node), 128):
                    part = x.cut(slice(k, k + 128))
                    a, b = np.nonzero(judged(part, y, similarity)[1])
                    found += [part.node[np.unique(a)], y.node[np.unique(b)]]
                nodes = np.unique(np.concatenate(found))
                if len(nodes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), batch.column(0)[i].as_py())), pa.array(nodes)], schema=schema)

    return run


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``x`` has in common with each of ``y``, a bounded matrix at a time."""
    names = np.unique(np.concatenate([np.zeros(0, np.uint64), *x]))
    out = np.zeros((len(x), len(y)))
    if not len(names):
        return out

    def marks(sets: list[np.ndarray], least: int) -> np.ndarray:
        m = np.zeros((len(sets), min(CELLS // len(sets), len(names) - least)), np.float32)
        for i, one in enumerate(sets):
            at = np.searchsorted(names, one)
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == one)] - least
            m[i, at[(at >= 0) & (at < m.shape[1])]] = 1
        return m

    width = max(1, CELLS // max(len(x), len(y)))
    for least in range(0, len(names), width):
        left, right = (marks(s, least)[:, :width] for s in (x, y))
        short = min(left.shape[1], right.shape[1])
        out += left[:, :short] @ right[:, :short].T
    return out


def similar_sets(similarity: float):
    """For ``mapInArrow`` over blocks ``(xs, ys)`` with sets: edges that connect the open pairs of the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [column[i].as_py() for column in batch.columns]
                x, y = map(Group.of, rows)
                left, right = ([np.frombuffer(r["shingles"], np.uint64) for r in side] for side in rows)
                us, vs = [], []
                for k in range(0, len(x.node), 64):
                    for m in range(0, len(y.node), 256):
                        p, q = x.cut(slice(k, k + 64)), y.cut(slice(m, m + 256))
                        open_ = judged(p, q, similarity)[1]
                        if open_.any():
                            both = shared_counts(left[k : k + 64], right[m : m + 256])
                            a, b = np.nonzero(open_ & (both >= similarity * (p.n[:, None] + q.n[None, :] - both)))
                            if len(a):
                                us.append(p.node[a])
                                vs.append(q.node[b])
                if (edges := tied_edges(us, vs)) is not None:
                    yield edges

    return run


def labelled(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Members ``(key, node, label)`` of the keys that hold more than one group, and whether they are outside its largest."""
    marked = keyed.join(groups.toDF("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    return marked.join(largest.select("key", F.col("most.label").alias("largest")), "key").selectExpr("key", "node", "label", "label <> largest AS outside")


def own_blocks(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Blocks ``(xs, ys)`` of the members of a key among themselves, dealt out by hash."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    part = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("rows") / FP_ROWS))
    member = F.struct("node", F.col("node").alias("label"), "n", "wide")
    blocks = keyed.join(sizes, "key").select("key", "node", part.alias("part")).join(nodes.select("node", "n", "wide"), "node")
    blocks = blocks.groupBy("key", "part").agg(F.collect_list(member).alias("xs")).where("size(xs) > 1")
    return blocks.select("xs", F.col("xs").alias("ys"))


def cross_blocks(members: DataFrame, weight: Column, size: int, *columns: str) -> DataFrame:
    """Blocks ``(key, xs, ys)`` in which the members outside a key's largest group meet all its members once.

    ``weight`` adds up to about ``size`` in a side of a block; a key with little in it is one block.
    """
    members = members.withColumn("weight", weight)
    totals = members.groupBy("key").agg(F.sum(F.when(F.col("outside"), F.col("weight"))).alias("few"), F.sum("weight").alias("all"))
    totals = totals.where("few IS NOT NULL").select("key", F.ceil(F.col("few") / size).alias("a"), F.ceil(F.col("all") / size).alias("b"))
    dealt = members.join(totals, "key").withColumn("h", F.xxhash64("key", "node"))
    member = F.struct("node", "label", "n", "wide", *columns)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("b") - 1, F.lit(0).cast("long"))))
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("a") - 1, F.lit(0).cast("long"))))
    xs = dealt.where("outside").select("key", F.pmod("h", F.greatest("a", F.lit(1))).alias("x"), other.alias("y"), member.alias("xm"), F.lit(None).alias("ym"))
    ys = dealt.select("key", one.alias("x"), F.pmod("h", F.greatest("b", F.lit(1))).alias("y"), F.lit(None).alias("xm"), member.alias("ym"))
    met = xs.unionByName(ys).groupBy("key", "x", "y").agg(F.collect_list("xm").alias("xs"), F.collect_list("ym").alias("ys"))
    return met.where("size(xs) > 0 AND size(ys) > 0").select("key", "xs", "ys")


def similar_links(nodes: DataFrame, docs: DataFrame, id: str, text: str, words: int, similarity: float, radius: int) -> DataFrame:
    """Edges that connect nodes whose texts have the similarity and share a sample key or a group of the index.

    A key is a sample's fingerprint or a group of fingerprints that the Gray-order index links. Pairs are compared
    within tasks, which return edges and never pairs: first the members of a key by fingerprint, block by block; then
    those outside its largest group with all others, noting the members that some pair leaves open; then
    these with their sets of shingles. Groups found by the first step are not compared again among themselves.
    """
    tied_codes = components(gray_links(nodes, radius)).select(F.col("node").alias("fp"), F.xxhash64(F.lit("index"), "component").alias("key"))
    by_index = nodes.select("node", "fp").join(tied_codes, "fp", "left").select("node", F.coalesce("key", F.xxhash64(F.lit("index"), "fp")).alias("key"))
    keyed = nodes.select("node", F.explode("keys").alias("key")).union(by_index)
    shared_keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    keyed = stored(keyed.join(shared_keys, "key").select("key", "node"), "keys")
    look = nodes.select("node", "n", "wide")
    pair = "u long, v long"

    first = stored(own_blocks(keyed, nodes).mapInArrow(sure_edges(similarity), pair), "links")
    members = stored(labelled(keyed, components(first)).join(look, "node"), "members")
    blocks = stored(cross_blocks(members, F.lit(1), FP_ROWS), "blocks")
    first = first.union(stored(blocks.select("xs", "ys").mapInArrow(sure_edges(similarity), pair), "links"))
    open_ = stored(blocks.mapInArrow(open_members(similarity), "key long, node long").distinct(), "open")

    wanted = open_.select("node").distinct().join(nodes.select("node", "row", "twin"), "node")
    sets = stored(shingle_sets(docs, id, text, words, wanted), "sets")
    members = members.join(open_, ["key", "node"]).join(sets, "node")
    blocks = cross_blocks(members, F.col("n") * 8 + 256, SET_BYTES, "shingles")
    return first.union(stored(blocks.select("xs", "ys").mapInArrow(similar_sets(similarity), pair), "links"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``docs``, all columns, with one row of each group of near duplicates: the one with the smallest id.

    Texts are compared whose fingerprints of the distinct shingles the Gray-order index groups within ``radius`` bits, and
    texts that share samples of their shingles; they are linked when they have the similarity, by a fingerprint of
    ``WIDE`` lanes and, where that is not clear, by the shingles themselves. Texts with one set of shingles are one
    node. NULL texts and texts without words are copies of each other. Rows with a NULL id go
    last; of repeated rows one stays. An empty table stays empty.
    """
    marked = stored(signatures(docs, id, text, words), "signatures")
    proof = marked.groupBy("node").agg(F.min("proof").alias("first_proof"))
    marked = marked.join(proof, "node")
    marked = marked.withColumn("node", F.when(F.col("proof") == F.col("first_proof"), F.col("node")).otherwise(F.xxhash64("node", "proof"))).drop("first_proof")
    nodes = stored(marked.groupBy("node").agg(F.min(F.struct("row", "twin", "fp", "n", "wide", "keys")).alias("s")).select("node", "s.*"), "nodes")
    groups = components(similar_links(nodes, docs, id, text, words, similarity, radius))
    rows = marked.select("doc_id", "row", "twin", "node").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "twin"))
    chosen = rows.groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias("chosen_row"), F.col("first.twin").alias("chosen_twin"))
    marks = dict(zip(("chosen_row", "chosen_twin"), row_marks(docs[id], docs[text]), strict=True))
    kept = docs.withColumns(marks).join(chosen.distinct(), list(marks)).dropDuplicates(list(marks))
    return kept.select(docs.columns)


@query("op1_simhash")
def op1_simhash(spark, sf):
    found = near_fingerprints(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
