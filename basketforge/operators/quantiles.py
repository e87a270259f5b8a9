"""Exact quantiles and average ranks of groups of any size, by ranges.

``percentile`` and ``median`` keep a group's distinct values in one task, and a
``rank`` window sorts a group in one. Here a group's distinct values and their counts
are dealt by ranges of (group, value): each range adds up its counts, ranges of a
group add up in order, and a value's rank is what stands in the ranges before its own
and before it within its own. A group with a third of all rows is so many ranges, and
equal values, however many, are one row before anything is dealt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketforge.session import dropped, staged


def _joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Joined on columns of which null equals null; those of ``left`` stay."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return left.join(named, same, how).drop(*(f"_{c}" for c in by))


def value_ranges(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(values, ranges), staged values: ``by``, value, n, part; and for each range ``by``, part, total, base, size.

    ``base`` counts a group's rows in the ranges before, ``size`` all its rows. Null values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    values = staged(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "value-ranges")
    totals = values.groupBy(*by, "part").agg(F.sum("n").alias("total"))
    # One row a range and group from here on.
    whole = Window.partitionBy(*by)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return values, totals.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn("size", F.sum("total").over(whole))


def _placed(values: DataFrame, ranges: DataFrame, by: list[str], value: str) -> DataFrame:
    """``values`` of the given ranges with ``start``: rows of the group that are smaller."""
    inside = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return _joined(values, ranges, [*by, "part"]).withColumn("start", start)


def exact_quantiles(df: DataFrame, by: list[str], columns: list[str], shares: dict[str, float]) -> DataFrame:
    """``by`` and a column ``{column}_{name}`` for each column and share (name -> share from 0 to 1), staged.

    As ``percentile``: between two ranks the value is interpolated. Groups without a
    value of a column have null there; groups without any value are not listed.
    """
    cells = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))).alias("cell")).select(*by, "cell.*")
    group = [*by, "column"]
    values, ranges = value_ranges(cells, group, "value")
    at = {name: (F.col("size") - 1) * share for name, share in shares.items()}
    wanted = [w for x in at.values() for w in (F.floor(x), F.ceil(x))]
    # Only ranges that hold a wanted rank are ordered within.
    holds = reduce(lambda a, b: a | b, ((F.col("base") <= w) & (w < F.col("base") + F.col("total")) for w in wanted))
    placed = _placed(values, ranges.where(holds), group, "value")
    here = lambda w: F.max(F.when((F.col("start") <= w) & (w < F.col("start") + F.col("n")), F.col("value")))
    picked = []
    for c in columns:
        own = F.col("column") == c
        for name, x in at.items():
            picked += [here(F.when(own, F.floor(x))).alias(f"{c}_{name}_low"), here(F.when(own, F.ceil(x))).alias(f"{c}_{name}_high"), F.max(F.when(own, x - F.floor(x))).alias(f"{c}_{name}_part")]
    found = placed.groupBy(*by).agg(*picked)

    def between(name: str) -> Column:
        low, high, part = (F.col(f"{name}_{x}") for x in ("low", "high", "part"))
        return (low * (1 - part) + high * part).alias(name)

    out = staged(found.select(*by, *(between(f"{c}_{name}") for c in columns for name in shares)), "quantiles")
    dropped(values)
    return out


def average_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, value, ``rank`` (from 1, ties share their mean) and ``size`` for each distinct value of each group, staged."""
    values, ranges = value_ranges(df, by, value)
    placed = _placed(values, ranges, by, value)
    out = staged(placed.select(*by, value, (F.col("start") + (F.col("n") + 1) / 2).alias("rank"), "size"), "ranks")
    dropped(values)
    return out
