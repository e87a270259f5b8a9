"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketforge.session import dropped, staged

MOST_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "component"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component), staged: the smallest node that each reaches.

    Alternating large-star and small-star steps: each node's larger, then smaller,
    neighbours are linked to its smallest one, until only stars are left. The
    rounds grow with the logarithm of a path's length, every step is a partial
    minimum and a join, and each round's edges are written, so no plan grows.
    Smallest nodes of a component, and nodes without edges, are not listed.
    ``MOST_ROUNDS`` is an error's bound, not a cut: no path that fits on a disk needs as many.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = staged(both.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct(), "edges")
    before = _signature(now)
    if not before[0]:
        return now
    for _ in range(MOST_ROUNDS):
        pairs = now.toDF("u", "v")
        sides = pairs.union(pairs.select("v", "u"))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = staged(small.union(low).where("u <> v").toDF("node", "component").distinct(), "edges")
        dropped(now)
        now, last = after, before
        before = _signature(now)
        if before == last:
            return now
    raise RuntimeError("components did not settle")
