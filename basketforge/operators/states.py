"""Saved aggregates: partial states of chunks that are added without reading earlier chunks.

Each chunk's rows become one row a key, with parts that can be merged (counts and sums
add up, least and greatest and first rows by an order compare). The partial rows are
kept as Parquet under the chunk's name. A result merges the saved states; adding a
chunk reads that chunk alone. A chunk that is added again replaces its state, so a
job that is run twice counts nothing twice. ``compacted`` merges all states into one
where they have become many.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A mergeable aggregate: of rows, and of partial values of the same name."""

    name: str
    of_rows: Column
    merge: Callable[[str], Column]


def counted(name: str) -> Part:
    return Part(name, F.count("*"), F.sum)


def summed(name: str, value: str) -> Part:
    return Part(name, F.sum(value), F.sum)


def least(name: str, value: str) -> Part:
    return Part(name, F.min(value), F.min)


def greatest(name: str, value: str) -> Part:
    return Part(name, F.max(value), F.max)


def first_by(name: str, order: list[str], values: list[str]) -> Part:
    """The ``values`` of the first row by ``order`` (and by the values themselves, where rows tie), as a struct."""
    return Part(name, F.min(F.struct(*order, *values)), F.min)


class SavedAggregate:
    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], parts: list[Part]):
        """``keys``: name -> column of the chunks."""
        self.spark, self.path, self.keys, self.parts = spark, path.rstrip("/"), keys, parts

    def _merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.keys).agg(*(p.merge(p.name).alias(p.name) for p in self.parts))

    def add(self, chunk: DataFrame, name: str) -> None:
        """Write the chunk's state under its name; only the chunk is read."""
        state = chunk.groupBy(*(F.col(c).alias(k) for k, c in self.keys.items())).agg(*(p.of_rows.alias(p.name) for p in self.parts))
        state.write.mode("overwrite").parquet(f"{self.path}/chunk={name}")

    def states(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("chunk")

    def result(self) -> DataFrame:
        """One row a key, over all chunks that were added."""
        return self._merged(self.states())

    def compacted(self, path: str) -> SavedAggregate:
        """The same aggregate with a single state, in a new place; more chunks may be added there."""
        self.result().write.mode("overwrite").parquet(f"{path.rstrip('/')}/chunk=compacted")
        return SavedAggregate(self.spark, path, self.keys, self.parts)
