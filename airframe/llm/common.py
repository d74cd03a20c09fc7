"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from airframe.session import new_path, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query under its key, with its SQL twin when there is one."""

    def add(fn):
        QUERIES[key] = lambda spark, sf: fn(prepare(spark), sf)
        if sql:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def at(df: DataFrame, name: str) -> int:
    """Position of a column: the exact name, or else the same name in another case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact and not near:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return (exact or near)[0]


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the given names; other columns, whatever they are called, are left out."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{at(df, c)}").alias(k) for k, c in wanted.items()])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_of(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_row(fn: Callable[..., tuple | None], schema: pa.Schema, chunk: int = 2048) -> Callable:
    """A function for ``mapInArrow`` that calls ``fn`` with the values of each row and returns its results as rows.

    At most ``chunk`` results are held before they are handed on; ``None`` gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = fn(*[column[i].as_py() for column in batch.columns])
                if row is not None:
                    rows.append(row)
                if len(rows) >= chunk:
                    yield to_batch(rows, schema)
                    rows = []
        if rows:
            yield to_batch(rows, schema)

    return run


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def tied(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list, and for each the smallest node it is tied to (within this list)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new
