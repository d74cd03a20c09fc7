"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation becomes rows of ``WIDTH`` turn columns, one for each block of turns. ``GROUP BY block, node of the block
before, ROLLUP (t1, ..., t8)`` gives every prefix of every block at once, and ``grouping_id`` says how long it is. The
node before a block is known without waiting for that block's result: a prefix is named by the exclusive or of
128 bits for each (place, turn) in it, which is a running aggregate, so the depth of the trie costs no rounds.

Sums over subtrees need no walk either. A node belongs to its smallest member, and a conversation owns a stretch of
its own path that reaches down to its end. The sum over a subtree is what its members own altogether (a second
ROLLUP), less what the node's own member owns above the node (a running sum along its path).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airframe.llm.common import partitions, pick, query, stored, table
from airframe.llm.sharding import SQL_CRC

#: Turn columns of a block; blocks, depths and conversation ids that share one step of a two-step running value or list.
WIDTH, STEP = 8, 4096
KEY = ["depth", "ka", "kb"]


def turn_rows(conversations: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``(conv_id, pos, a, b, words)``: the turns of each conversation, counted from 1 in the order of ``turn``.

    A turn is known by 128 bits of an MD5 over role and text; only these are moved. NULL turn numbers come first,
    equal ones in the order of that digest, repeated rows are turns of their own. A NULL role or text is an empty
    one. Rows without a conversation id belong to no conversation and are left out. Positions are counted in
    range partitions first, so that one long conversation is many tasks.
    """
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    rows = rows.selectExpr("conv_id", "turn", "coalesce(CAST(role AS STRING), '') AS role", "coalesce(CAST(text AS STRING), '') AS text")
    words = r"size(filter(split(text, '[\\x20\\x09-\\x0D]+', -1), x -> x <> ''))"
    rows = rows.selectExpr("conv_id", "turn", "md5(concat(length(role), ':', role, text)) AS mark", f"CAST({words} AS BIGINT) AS words")
    order = ["conv_id", F.asc_nulls_first("turn"), "mark"]
    line = stored(rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = line.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:]))
    half = "CAST(conv(substring(mark, {}, 16), 16, -10) AS BIGINT) AS {}"
    placed = line.withColumn("here", here).join(counts, ["conv_id", "part"])
    return placed.selectExpr("conv_id", "n + here AS pos", half.format(1, "a"), half.format(17, "b"), "words")


def place_key(pos: str, a: str, b: str) -> tuple[str, str]:
    """The two words of 64 bits that a turn at a place adds to the name of a prefix."""
    return f"xxhash64({pos}, {a}, {b})", f"xxhash64(-1L, {b}, {a}, {pos})"


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, tuple]) -> DataFrame:
    """``rows`` plus, for each ``name: (aggregate, column)``, the aggregate over the rows of the key before this one.

    In two steps, so that a key with many rows is many tasks: inside runs of ``STEP`` values of ``order``, then over the
    totals of the runs.
    """
    add = {"bit_xor": lambda x, y: x.bitwiseXOR(y), "sum": lambda x, y: x + y}
    rows = rows.withColumn("run", F.expr(f"{order} div {STEP}"))
    near = Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    far = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "run").agg(*[F.expr(f"{how}({c})").alias(f"{n}_far") for n, (how, c) in sums.items()])

    def above(how: str, c: str, w) -> Column:
        return F.coalesce(F.expr(f"{how}({c})").over(w), F.lit(0).cast("long"))

    totals = totals.select(*keys, "run", *[above(how, f"{n}_far", far).alias(f"{n}_far") for n, (how, _) in sums.items()])
    rows = rows.withColumns({n: above(how, c, near) for n, (how, c) in sums.items()}).join(totals, [*keys, "run"])
    return rows.withColumns({n: add[how](F.col(n), F.col(f"{n}_far")) for n, (how, _) in sums.items()}).drop("run", *[f"{n}_far" for n in sums])


def blocks_of(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, ka, kb, t1, ..., t8)``: turn columns of each block, with the name of the prefix before it."""
    za, zb = place_key("pos", "a", "b")
    turn = F.struct("pos", "a", "b", "words")
    rows = turns.withColumn("block", F.expr(f"CAST((pos - 1) div {WIDTH} AS BIGINT)")).groupBy("conv_id", "block")
    rows = rows.agg(F.array_sort(F.collect_list(turn)).alias("t"), F.expr(f"bit_xor({za})").alias("za"), F.expr(f"bit_xor({zb})").alias("zb"))
    rows = running(rows, ["conv_id"], "block", {"ka": ("bit_xor", "za"), "kb": ("bit_xor", "zb")})
    cells = [f"CASE WHEN size(t) >= {k} THEN struct(t[{k - 1}].a AS a, t[{k - 1}].b AS b, t[{k - 1}].words AS words) END AS t{k}" for k in range(1, WIDTH + 1)]
    return rows.selectExpr("conv_id", "block", "ka", "kb", *cells)


def all_prefixes(blocks: DataFrame, totals: str) -> DataFrame:
    """``(depth, ka, kb, pa, pb, words, <totals>)`` for every prefix but the empty one, by one ROLLUP over all blocks;
    ``pa, pb`` name the parent."""
    columns = [f"t{k}" for k in range(1, WIDTH + 1)]
    every = ", ".join(columns)
    found = blocks.sparkSession.sql(f"SELECT block, ka, kb, {every}, grouping_id() AS gid, {totals} FROM {{blocks}} GROUP BY block, ka, kb, ROLLUP ({every})", blocks=blocks)
    found = found.withColumn("level", F.expr(f"{WIDTH} - bit_count(gid)")).withColumn("last", F.expr(f"get(array({every}), level - 1)"))
    names = {"ka": [], "kb": []}
    for k in range(1, WIDTH + 1):
        for name, word in zip(names, place_key(f"block * {WIDTH} + {k}", f"t{k}.a", f"t{k}.b"), strict=True):
            names[name].append(f"CASE WHEN level > {{less}} + {k - 1} THEN {word} ELSE 0L END")
    name = {c: f"{c} ^ " + " ^ ".join(parts) for c, parts in names.items()}
    known = {"pos", "block", "ka", "kb", "gid", "level", "last", *columns}
    rest = [c for c in found.columns if c not in known]
    return found.where("last IS NOT NULL").selectExpr(
        f"block * {WIDTH} + level AS depth",
        *[f"{sql.format(less=0)} AS {c}" for c, sql in name.items()],
        *[f"{sql.format(less=1)} AS p{c[1]}" for c, sql in name.items()],
        "last.words AS words",
        *rest,
    )


def ends_of(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``(conv_id, depth, ka, kb)``: the node at which each conversation ends; one without turns ends at the root."""
    za, zb = place_key("pos", "a", "b")
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("depth"), F.expr(f"bit_xor({za})").alias("ka"), F.expr(f"bit_xor({zb})").alias("kb"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in KEY}
    return conversations.select("conv_id").distinct().join(own, "conv_id", "left").withColumns(zero)


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie and the ends of the conversations.

    ``turns`` is ``(conv_id, pos, a, b, words)`` with positions from 1 without gaps, ``conversations`` has every ``conv_id``, those
    without turns too. A node is ``(depth, ka, kb)`` with ``conv_id`` (smallest member), ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens``: the words that need not be read again when each node is read once,
    summed over the subtree. Copies are one node. No conversation at all gives no rows, not even a root.
    """
    blocks = stored(blocks_of(turns), "blocks")
    ends = stored(ends_of(turns, conversations), "ends")
    first = all_prefixes(blocks, "count(1) AS n_convs, min(conv_id) AS conv_id")
    root = ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(*[zero.alias(c) for c in KEY], none.alias("pa"), none.alias("pb"), zero.alias("words"), "n_convs", "conv_id")
    nodes = stored(first.selectExpr("CAST(depth AS BIGINT) AS depth", "ka", "kb", "pa", "pb", "words", "n_convs", "conv_id").union(root), "nodes")

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    nodes = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), KEY, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    nodes = stored(running(nodes, ["conv_id"], "depth", {"above": ("sum", "saved")}), "owned")

    owns = nodes.groupBy("conv_id").agg(F.sum("saved").alias("own"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf"))
    owned = blocks.join(owns, "conv_id", "left").fillna(0, ["own", "leaf"])
    second = all_prefixes(owned, "sum(own) AS own, sum(leaf) AS n_leaves").selectExpr("CAST(depth AS BIGINT) AS depth", "ka", "kb", "own", "n_leaves")
    whole = owns.agg(F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves")).where("own IS NOT NULL")
    sums = second.union(whole.select(*[zero.alias(c) for c in KEY], "own", "n_leaves"))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(sums, KEY).withColumn("saved_tokens", F.col("own") - F.col("above")).join(up, ["depth", "pa", "pb"], "left")
    return nodes.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, comma-joined, from rows sorted by key and piece; one piece is held at a time."""
    schema = pa.schema([("depth", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("ends_sha256", pa.string())])
    key, digest = None, None
    for batch in batches:
        done = []
        for *new, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if new != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = new, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, digest.hexdigest()), strict=True))], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, ka, kb, ends_sha256)`` over the ids, ascending, of the conversations that end at a node.

    Ids are joined to pieces of at most ``STEP`` neighbouring ids before anything of a node meets in one task.
    """
    ids = "array_join(transform(array_sort(collect_list(conv_id)), x -> CAST(x AS STRING)), ',')"
    pieces = ends.groupBy(*KEY, F.expr(f"CAST(floor(conv_id / {STEP}) AS BIGINT)").alias("piece")).agg(F.expr(ids).alias("ids"))
    pieces = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return pieces.mapInArrow(hashed, "depth long, ka long, kb long, ends_sha256 string")


# ---------------------------------------------------------------- the registered query

#: A conversation takes the first turns, at most three, of the first conversation of its group of this many ids.
GROUP, SHARED = 20, 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with the first ones taken from the group's first conversation, and all conversation ids.

    A group shares the head of one conversation, which at most ``SHARED - 1`` turns of it are, so the join of heads gives
    at most that many rows for a conversation.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    heads = turns.where(f"conv_id % {GROUP} = 0 AND pos < {SHARED}").withColumnRenamed("conv_id", "base")
    known = sizes.where(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    info = sizes.selectExpr("conv_id", f"conv_id - conv_id % {GROUP} AS base", f"crc32(CAST(conv_id AS STRING)) % {SHARED} AS h")
    info = info.join(known, "base", "left").selectExpr("conv_id", "base", "h", "least(h, coalesce(base_n, 0)) AS taken")
    info = stored(info, "rebuilt")
    head = info.join(heads, "base").where("pos <= taken").select("conv_id", "pos", "a", "b", "words")
    own = turns.join(info, "conv_id").where("pos > h").selectExpr("conv_id", "pos - h + taken AS pos", "a", "b", "words")
    return head.union(own), info.select("conv_id")


SQL = rf"""{SQL_CRC},
t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'mark': mark, 'words': words}} ORDER BY turn NULLS FIRST, mark) AS s FROM t GROUP BY conv_id),
k AS (SELECT conv_id, s, conv_id - conv_id % {GROUP} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(string_split(conv_id::VARCHAR, ''), lambda p: ord(p)::BIGINT)), lambda a, b: xor(a >> 8, c[xor(a & 255, b) + 1])), 4294967295::BIGINT) % {SHARED} AS h FROM o, crc),
r AS (SELECT k.conv_id, list_concat(coalesce(o.s[1:h], []), k.s[h + 1:]) AS s FROM k LEFT JOIN o ON o.conv_id = k.base),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM r),
n AS (SELECT depth, s[1:depth] AS q, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
u AS (SELECT n.*, coalesce(ch.n, 0) AS n_children, up.conv_id AS parent_conv_id FROM n
        LEFT JOIN (SELECT depth - 1 AS depth, q[1:depth - 1] AS q, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1, 2) ch ON ch.depth = n.depth AND ch.q = n.q
        LEFT JOIN n up ON up.depth = n.depth - 1 AND up.q = n.q[1:n.depth - 1]),
a AS (SELECT unnest(range(0, depth + 1)) AS up, q, CASE WHEN depth > 0 THEN (n_convs - 1) * q[depth].words ELSE 0 END AS saved, n_children FROM u),
z AS (SELECT up AS depth, q[1:up] AS q, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM a GROUP BY 1, 2)
SELECT conv_id, u.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM u JOIN z ON z.depth = u.depth AND z.q = u.q
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark, sf):
    turns, ids = rebuilt(stored(turn_rows(table(spark, sf, "conversations")), "numbered"))
    nodes, ends = prefix_trie(turns, ids)
    none = F.sha2(F.lit(""), 256)
    found = nodes.join(end_digests(ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
