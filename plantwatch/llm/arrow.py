"""Small helpers for Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from plantwatch.session import ship_package

Batches = Iterator[pa.RecordBatch]


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until the frame has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


class BoundedCache(dict):
    """A dict that forgets everything when it holds ``most`` keys.

    Natural text repeats its words, so a refill costs little; the bound keeps a
    worker's memory the same however large the input is. Keys of more than
    ``LONGEST_KEY`` characters are not kept.
    """

    LONGEST_KEY = 128

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def keep(self, key: str, value):
        if len(key) <= self.LONGEST_KEY:
            self[key] = value
        return value

    def room(self) -> None:
        if len(self) >= self.most:
            self.clear()
