"""Whitening of embeddings by a bidiagonal qd solver.

Spark reduces the centred rows of the fit list to one triangle R: every task folds its blocks of rows into a triangle by
QR, and triangles are folded together in a tree of tasks. What is left is as large as the vectors' dimension and is
solved once: Householder reflections make R bidiagonal, the differential qd transform with shifts (dqds) finds its
singular values to high relative accuracy, and a twisted factorisation of the shifted qd array gives each singular
vector. Singular values that lie too close together for that get their vectors by repeated solves, kept orthogonal.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe.llm.common import arrow_of, pick, query, stored, table

#: A part c of a vector becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows folded into a triangle at once, triangles folded together in one task.
BLOCK_ROWS, FAN_IN = 4096, 16
EPS = np.finfo(np.float64).eps
#: Singular values closer than this, relatively, are a cluster.
CLUSTER = 1e-3


# ---------------------------------------------------------------- the small problem


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and superdiagonal of ``U' r V``, and the reflections that make up ``V``."""
    work, n, right = r.copy(), r.shape[1], []

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        tail = np.linalg.norm(x)
        if tail == 0 or not x[1:].any():
            return None
        v = x.copy()
        v[0] += np.copysign(tail, x[0])
        return v / np.linalg.norm(v), -np.copysign(tail, x[0])

    for k in range(n):
        if (left := reflector(work[k:, k])) is not None:
            work[k:, k:] -= 2 * np.outer(left[0], left[0] @ work[k:, k:])
        if k < n - 2 and (over := reflector(work[k, k + 1 :])) is not None:
            work[k:, k + 1 :] -= 2 * np.outer(work[k:, k + 1 :] @ over[0], over[0])
            right.append((k + 1, over[0]))
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of ``B'B`` from the squares ``q`` of the diagonal and ``e`` of the superdiagonal of ``B``.

    The shift of a step never exceeds the smallest value left: it is guessed from the last rows, and a step in which a
    ``d`` turns negative is taken back and tried with less; when only the last ``d`` did, its amount says how much
    less. All quantities stay positive, so no value loses relative accuracy.
    """
    found: list[float] = []
    parts = [(list(q), list(e), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        tries = 0
        while len(q) > 1:
            small = EPS * EPS
            if e[-1] <= small * (moved + q[-1]) or e[-1] < 1e-300:
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= small * (moved + q[i + 1]) or e[i] < 1e-300), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            shift = 0.0 if tries > 60 else last_value(q, e)
            for attempt in range(8):
                new_q, new_e, lows = qd_step(q, e, shift)
                if lows[0] >= 0 and lows[1] >= 0:
                    break
                late = lows[0] >= 0 and attempt < 3
                shift = max(shift + lows[1], 0.0) * (1 - 4 * EPS) if late else (shift / 4 if attempt < 6 else 0.0)
            else:
                new_q, new_e, _ = qd_step(q, e, 0.0)
                shift = 0.0
            q, e, moved, tries = new_q, new_e, moved + shift, tries + 1
        found += [moved + x for x in q]
    return sorted(found, reverse=True)


def last_value(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows of ``BB'``, as a guess at the smallest of all, a little less."""
    a, b, c = q[-2] + e[-1], q[-1] * e[-1], q[-1]
    half, gap = (a + c) / 2, (a - c) / 2
    top = half + np.hypot(gap, np.sqrt(b))
    return max(0.0, (a * c - b) / top * (1 - 1e-10)) if top > 0 else 0.0


def qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], tuple[float, float]]:
    """One differential qd transform with a shift; the least ``d`` but the last, and the last one."""
    d, least = q[0] - shift, np.inf
    new_q, new_e = [], []
    for k in range(len(e)):
        least = min(least, d)
        both = d + e[k]
        if not both > 0:
            return q, e, (-1.0, -1.0)
        ratio = q[k + 1] / both
        new_q.append(both)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
    new_q.append(d)
    return new_q, new_e, (least, d)


class Twisted(NamedTuple):
    """Twisted factorisation of ``B'B - value``: multipliers from above and below, the place of the twist and its pivot."""

    down: np.ndarray
    up: np.ndarray
    top: np.ndarray
    bottom: np.ndarray
    at: int
    pivot: float

    def vector(self) -> np.ndarray:
        """Solution for the unit vector at the twist, scaled to length one: the singular vector when the pivot is small."""
        n = len(self.top)
        z = np.zeros(n)
        z[self.at] = 1.0
        for k in range(self.at - 1, -1, -1):
            z[k] = -self.down[k] * z[k + 1]
        for k in range(self.at, n - 1):
            z[k + 1] = -self.up[k] * z[k]
        return z / np.linalg.norm(z)

    def solve(self, x: np.ndarray) -> np.ndarray:
        y = x.copy()
        for k in range(self.at):
            y[k + 1] -= self.down[k] * y[k]
        for k in range(len(y) - 2, self.at - 1, -1):
            y[k] -= self.up[k] * y[k + 1]
        y[: self.at] /= self.top[: self.at]
        y[self.at + 1 :] /= self.bottom[self.at + 1 :]
        y[self.at] /= self.pivot
        for k in range(self.at - 1, -1, -1):
            y[k] -= self.down[k] * y[k + 1]
        for k in range(self.at, len(y) - 1):
            y[k + 1] -= self.up[k] * y[k]
        return y / np.linalg.norm(y)


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, tiny: float) -> Twisted:
    """Stationary qd from the top, progressive qd from the bottom, joined where the pivot is smallest."""
    n, square, l = len(diagonal), diagonal**2, above / diagonal[:-1]
    off = square[:-1] * l

    def safe(x: float) -> float:
        return x if abs(x) > tiny else -tiny

    top, bottom, down, up, s, p = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        top[k] = safe(s[k] + square[k])
        down[k] = off[k] / top[k]
        s[k + 1] = down[k] * l[k] * s[k] - value
    top[-1] = safe(s[-1] + square[-1])
    p[-1] = square[-1] - value
    for k in range(n - 2, -1, -1):
        bottom[k + 1] = safe(off[k] * l[k] + p[k + 1])
        ratio = square[k] / bottom[k + 1]
        up[k] = l[k] * ratio
        p[k] = p[k + 1] * ratio - value
    bottom[0] = safe(p[0])
    pivots = s + p + value
    at = int(np.abs(pivots).argmin())
    return Twisted(down, up, top, bottom, at, safe(float(pivots[at])))


def leading(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of a triangle and, as columns, their right singular vectors.

    Fewer than wanted when the triangle's rank is lower: values below the rounding of the largest have no vector.
    """
    n = r.shape[1]
    size = np.abs(r).max() if r.size else 0.0
    if size == 0 or n == 0:
        return np.zeros(0), np.zeros((n, 0))
    a, b, right = bidiagonal(r / size)
    floor = EPS * EPS
    a = np.where(np.abs(a) < floor, floor, a)
    edges = [0, *(np.nonzero(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])) / 2)[0] + 1).tolist(), n]
    pieces = [(x, y) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    taken = sorted(((v, i) for i, (x, y) in enumerate(pieces) for v in dqds((a[x:y] ** 2).tolist(), (b[x : y - 1] ** 2).tolist())), key=lambda t: -t[0])
    taken = [t for t in taken if t[0] > (n * EPS) ** 2 * taken[0][0]][:wanted]
    rng, vectors = np.random.default_rng(17), np.zeros((n, len(taken)))
    cluster: list[tuple[float, int, int]] = []
    for k, (value, i) in enumerate(taken):
        x, y = pieces[i]
        cluster = [c for c in cluster if c[0] - value <= CLUSTER * c[0]]
        near = vectors[x:y, [c[2] for c in cluster if c[1] == i]]
        tiny = EPS * EPS * max(value, 1e-300)
        if y - x == 1:
            z = np.ones(1)
        elif not near.shape[1]:
            z = twisted(a[x:y], b[x : y - 1], value, tiny).vector()
        else:  # a little off the value, so that a solve raises all directions of the cluster and not one alone
            factors, z = twisted(a[x:y], b[x : y - 1], value * (1 - 64 * EPS), tiny), rng.standard_normal(y - x)
            for _ in range(4):
                z = factors.solve(apart(z, near))
            z = apart(z, near)
        vectors[x:y, k] = z
        cluster.append((value, i, k))
    for start, v in reversed(right):
        vectors[start:] -= 2 * np.outer(v, v @ vectors[start:])
    return np.sqrt([value for value, _ in taken]) * size, vectors


def apart(z: np.ndarray, near: np.ndarray) -> np.ndarray:
    """``z`` without its share in the columns of ``near``, scaled to length one."""
    for _ in range(2):
        z = z - near @ (near.T @ z)
        z = z / np.linalg.norm(z)
    return z


# ---------------------------------------------------------------- rows


def whole_parts(embeddings: DataFrame, id: str, vector: str, scale: int, shift: int) -> DataFrame:
    """``(vec_id, x)``: whole-number vectors of the rows that have one, ``x`` as longs.

    A row with a NULL vector, an empty one, or one with NULL or non-finite parts has none; neither has one with a part
    beyond what a long can hold.
    """
    rows = pick(embeddings, vec_id=id, vector=vector).withColumn("vector", F.expr("transform(vector, c -> CAST(c AS DOUBLE))"))
    limit = float(1 << 62) / scale
    good = f"size(vector) > 0 AND forall(vector, c -> coalesce(NOT isnan(c) AND abs(c) < {limit!r}D, false))"
    return rows.where(f"vector IS NOT NULL AND {good}").selectExpr("vec_id", f"transform(vector, c -> CAST(floor({scale} * c) AS BIGINT) + {shift}) AS x")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums, as decimal digits, of the vectors of a partition."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            part = [sum(c) for c in zip(*batch.column(0).to_pylist(), strict=True)] if np.abs(matrix(batch.column(0))).max() >= 1 << 40 else matrix(batch.column(0)).sum(axis=0).tolist()
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += batch.num_rows
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(s) for s in total]], pa.list_(pa.decimal128(38, 0)))], names=["n", "sums"])


class Fit(NamedTuple):
    """Number of distinct vectors, their exact sums, whitening directions (columns), eigenvalues and their share."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: in longs where they hold it, else in Python's integers.

    A whole number near the mean goes off both first, which changes nothing but the size of the products.
    """
    near = [round(s / n) if abs(s) < 1 << 52 else s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, near, strict=True)]
    if max(map(abs, near), default=0) < 1 << 62:
        low = x - np.array(near, np.int64) if np.abs(x).max(initial=0) < 1 << 61 else None
        if low is not None and float(np.abs(low).max(initial=0)) * n < 1 << 62 and max(map(abs, rest), default=0) < 1 << 61:
            return low * np.int64(n) - np.array(rest, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * max(y.shape[1], 1) < float(1 << 62):
        return (y * y).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in y]


def folded(n: int, sums: list[int]):
    """For ``mapInArrow`` over vectors: the triangle of a partition's centred rows, taken a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                x = matrix(batch.column(0).slice(start, BLOCK_ROWS))
                rows = deviations(x, n, sums).astype(np.float64) / n
                r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        if r is not None:
            yield triangle(r)

    return run


def triangle(r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])


def fold_triangles(key: tuple, frame: pd.DataFrame, width: int) -> pd.DataFrame:
    """One triangle from a few."""
    r = None
    for packed in frame["r"]:
        part = np.frombuffer(packed, "<f8").reshape(-1, width)
        r = part if r is None else np.linalg.qr(np.vstack([r, part]), mode="r")
    return pd.DataFrame({"r": [r.astype("<f8").tobytes()]})


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Whitening of the distinct vectors of column ``x``, all of one length; None without any.

    To the driver go one sum for each dimension and one triangle, at most ``dimension * dimension`` numbers.
    """
    distinct = stored(x.select("x").distinct(), "fit_list")
    parts = distinct.mapInArrow(add_up, "n long, sums array<decimal(38,0)>")
    n = parts.agg(F.sum("n")).first()[0]
    if not n:
        return None
    sums = [int(r[1]) for r in parts.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s")).alias("s")).orderBy("at").collect()]
    width = len(sums)
    level = stored(distinct.mapInArrow(folded(n, sums), "r binary"), "triangles")
    while (left := level.count()) > 1:
        groups = -(-left // FAN_IN)
        numbered = level.withColumn("g", F.expr(f"CAST(monotonically_increasing_id() % {groups} AS INT)")) if groups > 1 else level.withColumn("g", F.lit(0))
        level = stored(numbered.groupBy("g").applyInPandas(lambda key, frame: fold_triangles(key, frame, width), "r binary"), "triangles")
    r = np.frombuffer(bytes(level.first()[0]), "<f8").reshape(-1, width)
    r = np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r
    singular, vectors = leading(np.triu(r), components)
    values = singular**2 / n
    trace = float((r * r).sum()) / n
    return Fit(n, sums, vectors, values, values / trace if trace > 0 else values)


def projected(model: Fit, x: np.ndarray) -> np.ndarray:
    """Whitened rows."""
    centred = deviations(x, model.n, model.sums).astype(np.float64) / model.n
    return centred @ (model.vectors / np.sqrt(model.values))


def moments(model: Fit):
    """For ``mapInArrow`` over vectors: count, sums and products of a partition's whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = 0, len(model.values)
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = projected(model, matrix(batch.column(0)))
                n, total, products = n + len(w), total + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()]), pa.array([products.ravel().tolist()])], names=["n", "total", "products"])

    return run


def identity_error(model: Fit, x: DataFrame) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors less the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    parts = x.select("x").distinct().mapInArrow(moments(model), "n long, total array<double>, products array<double>")
    flat = parts.select("n", F.posexplode(F.concat("total", "products")).alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at")
    sums = np.array([row[1] for row in flat.collect()])
    mean = sums[:k] / model.n
    return float(np.abs(sums[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` per row with a vector and component.

    Components are fitted on the distinct whole-number vectors, so copies weigh once, and numbered from 1 by falling variance.
    Rows without a usable vector (NULL, empty, NULL or non-finite parts) are left out, and so are vectors of another
    length than the most common one (the longer on a tie), which have no place in one covariance. Repeated rows
    and NULL ids stay. Directions without variance are not returned: a table whose usable vectors are all equal, or an
    empty one, gives no rows. ``deviation`` is exact and a decimal; it can exceed a long where vectors are huge.
    """
    rows = stored(whole_parts(embeddings, id, vector, scale, shift), "parts")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = pa.schema([("vec_id", arrow_of(rows, "vec_id")), ("component", pa.int32()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64())])
    width = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.where(F.size("x") == width[0]) if width else rows
    model = fit(rows, components) if width else None
    error = identity_error(model, rows) if model else 0.0
    shares = model.shares.tolist() if model else []

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values) if model else 0
        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, BLOCK_ROWS):
                ids, x = batch.column(0).slice(start, BLOCK_ROWS), matrix(batch.column(1).slice(start, BLOCK_ROWS))
                square = pa.array([Decimal(s) for s in square_sums(deviations(x, model.n, model.sums))], pa.decimal128(38, 0))
                each = np.repeat(np.arange(len(x)), k)
                numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(each)), numbers, square.take(pa.array(each)), pa.array(projected(model, x).ravel())], schema=schema)

    found = rows.select("vec_id", "x").mapInArrow(project, f"vec_id {kind}, component int, deviation decimal(38,0), whitened double")
    share = F.array(*[F.lit(s) for s in shares])[F.col("component") - 1] if shares else F.lit(None).cast("double")
    return found.select(
        "vec_id", "component", F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )


@query("op11_whitening")
def op11_whitening(spark, sf):
    return whitened(table(spark, sf, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
