"""Cross-validated straight lines from one scan: moments per fold, every fit and every error from these.

A least-squares line needs only counts, means and co-moments, and so does its mean squared error on any rows. One
aggregate gives them for each fold; the rows to train on are the other folds' moments put together. So any number of
feature sets is fitted, fold by fold, without reading the rows again: the driver solves systems as large as the
number of features.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airframe.operators import models


class Moments(NamedTuple):
    """Rows, means and population co-moments (divisor n) of the columns; the last column is the target."""

    n: float
    mean: np.ndarray
    co: np.ndarray


def fold_moments(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> dict[int, Moments]:
    """Moments of each fold in one pass; rows with a NULL in any column count in none.

    ``covar_pop`` adds up centred products, so large means cost no digits. One row for each fold reaches the driver.
    """
    columns = [F.col(c).cast("double") for c in (*features, target)]
    size = len(columns)
    whole = df.dropna(subset=[*features, target])
    co = {(i, j): F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(size) for j in range(i, size)}
    rows = whole.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *co.values()).collect()
    out = {}
    for r in rows:
        m = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        out[r[fold]] = Moments(float(r["n"]), np.array([r[f"m{i}"] for i in range(size)]), m)
    return out


def together(parts: Sequence[Moments]) -> Moments:
    """Moments of the rows of several parts."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / n
    return Moments(n, mean, sum(p.n * (p.co + np.outer(p.mean - mean, p.mean - mean)) for p in parts) / n)


def line(m: Moments, at: Sequence[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the columns ``at`` and the intercept; columns that depend on each other share their effect."""
    at = list(at)
    spread = np.sqrt(np.where(np.diag(m.co)[at] > 0, np.diag(m.co)[at], 1.0))
    scaled = np.linalg.lstsq(m.co[np.ix_(at, at)] / np.outer(spread, spread), m.co[at, -1] / spread, rcond=1e-12)[0] if at else np.zeros(0)
    coefficients = scaled / spread
    return coefficients, float(m.mean[-1] - coefficients @ m.mean[at])


def squared_error(m: Moments, at: Sequence[int], coefficients: np.ndarray, intercept: float) -> float:
    """Mean squared error of a line on the rows of ``m``."""
    at = list(at)
    off = m.mean[-1] - intercept - coefficients @ m.mean[at]
    spread = m.co[-1, -1] - 2 * coefficients @ m.co[at, -1] + coefficients @ m.co[np.ix_(at, at)] @ coefficients
    return float(max(spread, 0.0) + off * off)


def held_out(moments: dict[int, Moments], at: Sequence[int]) -> dict[int, float]:
    """Mean squared error on each fold of the line fitted to the others."""
    out = {}
    for fold, rows in moments.items():
        rest = [m for other, m in moments.items() if other != fold]
        if rest:
            out[fold] = squared_error(rows, at, *line(together(rest), at))
    return out


def scores(moments: dict[int, Moments], sets: dict[str, Sequence[int]]) -> list[tuple[str, int, float]]:
    return [(name, int(fold), mse) for name, at in sets.items() for fold, mse in sorted(held_out(moments, at).items())]


def cv_lines(df: DataFrame, sets: dict[str, Sequence[str]], target: str, fold: str = "fold") -> DataFrame:
    """``(features, fold, mse)`` for each named feature set, all from one scan."""
    every = list(dict.fromkeys(f for names in sets.values() for f in names))
    moments = fold_moments(df, every, target, fold)
    rows = scores(moments, {name: [every.index(f) for f in names] for name, names in sets.items()})
    return df.sparkSession.createDataFrame(rows, "features string, fold int, mse double")


def weakest_by_error(moments: dict[int, Moments], features: Sequence[str], drop: int) -> list[str]:
    """The features whose loss, one after the other, costs the least held-out error; ties go by name."""
    left, out = list(range(len(features))), []
    for _ in range(min(drop, max(len(features) - 1, 0))):
        cost = {i: np.mean(list(held_out(moments, [j for j in left if j != i]).values())) for i in left}
        weak = min(left, key=lambda i: (cost[i], features[i]))
        left.remove(weak)
        out.append(features[weak])
    return out


def drop_weak(df: DataFrame, features: Sequence[str], target: str, drop: int = 2, fold: str = "fold") -> tuple[list[str], DataFrame]:
    """Features left after the weakest are dropped, and all against these by held-out error. One scan."""
    moments = fold_moments(df, features, target, fold)
    gone = weakest_by_error(moments, features, drop)
    kept = [f for f in features if f not in gone]
    sets = {"full": range(len(features)), "reduced": [features.index(f) for f in kept]}
    rows = df.sparkSession.createDataFrame(scores(moments, sets), "features string, fold int, mse double")
    full, reduced = (rows.filter(F.col("features") == name) for name in sets)
    return kept, models.cv_compare(full, reduced)
