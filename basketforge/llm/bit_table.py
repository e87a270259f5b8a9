"""Bit tables of hashes: they pass over rows that a later exact step would drop.

``maybe_in`` and ``surely_not_in`` test rows by a broadcast join with the words of
a table that hold a bit: as many words as there are codes, at most FILTER_WORDS.
``bit_table`` and ``in_table`` are a table as a column constant, for tests within
array functions. A bit may be set by another hash, so a set bit proves nothing,
and a full table only saves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a table (2^20 bits).
TABLE_WORDS = 2**14
#: 64-bit words of a broadcast filter at most (2^26 bits, about 50 MB as a relation); few codes have few words.
FILTER_WORDS = 2**20


def bit_table(df: DataFrame, code: str) -> Column:
    """The table of the values of a long column; at most TABLE_WORDS rows come to the driver."""
    word = F.shiftrightunsigned(code, 6).bitwiseAND(F.lit(TABLE_WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(code).bitwiseAND(F.lit(63)).cast("int"))
    bits = [0] * TABLE_WORDS
    for r in df.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).collect():
        bits[r["w"]] = r["b"]
    return F.expr(f"cast(split('{','.join(map(str, bits))}', ',') as array<bigint>)")


def in_table(bits: Column, code: Column) -> Column:
    """False for codes that are surely not in the table."""
    word = F.get(bits, F.shiftrightunsigned(code, 6).bitwiseAND(F.lit(TABLE_WORDS - 1)).cast("int"))
    return F.call_function("shiftrightunsigned", word, code.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _tested(rows: DataFrame, code: Column, codes: DataFrame, kind: str) -> DataFrame:
    """``rows`` joined (left_semi or left_anti) with the filter of the first column of ``codes``, hashes of 64 bits."""
    word = lambda c: F.shiftrightunsigned(c, 6).bitwiseAND(F.lit(FILTER_WORDS - 1))
    low = lambda c: c.bitwiseAND(F.lit(63)).cast("int")
    own = F.col(codes.columns[0])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low(own))
    words = codes.where(own.isNotNull()).groupBy(word(own).alias("filter_word")).agg(F.bit_or(bit).alias("filter_bits"))
    there = F.call_function("shiftrightunsigned", F.col("filter_bits"), low(code)).bitwiseAND(F.lit(1)) == 1
    return rows.join(F.broadcast(words), (word(code) == F.col("filter_word")) & there, kind)


def maybe_in(rows: DataFrame, code: Column, codes: DataFrame) -> DataFrame:
    """Rows whose code may be among ``codes``; a null code is in none."""
    return _tested(rows, code, codes, "left_semi")


def surely_not_in(rows: DataFrame, code: Column, codes: DataFrame) -> DataFrame:
    """The other rows."""
    return _tested(rows, code, codes, "left_anti")
