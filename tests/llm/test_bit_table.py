"""Filters of hashes: nothing that is among the codes is passed over, and the two parts make the whole."""

import numpy as np
from pyspark.sql import functions as F

from basketforge.llm import bit_table
from basketforge.llm.bit_table import maybe_in, surely_not_in
from basketforge.llm.shingle_join import _near, sketch


def test_no_code_is_passed_over(spark, monkeypatch):
    rows = spark.range(5_000).select("id", F.when(F.col("id") % 11 > 0, F.xxhash64("id")).alias("code"), F.lit("x").alias("extra"))
    codes = spark.range(0, 5_000, 3).select(F.xxhash64("id").alias("c"))
    inside = {r["id"] for r in rows.collect() if r["id"] % 3 == 0 and r["code"] is not None}
    for words in (2**20, 1):
        monkeypatch.setattr(bit_table, "FILTER_WORDS", words)
        held = [r["id"] for r in maybe_in(rows, F.col("code"), codes).collect()]
        rest = [r["id"] for r in surely_not_in(rows, F.col("code"), codes).collect()]
        assert sorted(held + rest) == list(range(5_000))
        assert inside <= set(held)
        assert {k for k in range(0, 5_000, 11)} <= set(rest)
        if words > 1:
            assert set(held) == inside


def test_no_codes(spark):
    rows, none = spark.range(10).select("id", F.xxhash64("id").alias("code")), spark.range(0).select(F.xxhash64("id").alias("c"))
    assert maybe_in(rows, F.col("code"), none).count() == 0
    assert surely_not_in(rows, F.col("code"), none).count() == 10


def test_codes_are_not_in_the_plan(spark):
    codes = spark.range(1_000).select(F.xxhash64("id").alias("c"))
    plan = maybe_in(spark.range(10), F.xxhash64("id"), codes)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and len(plan) < 20_000


def test_sketches_of_large_sets_reject_unlike_sets_alone(spark):
    """Sizes on both sides of a power of two, so that one sketch is folded; long texts fill no sketch."""
    draw, rows = np.random.default_rng(5), []
    for n in (400, 511, 513, 2_040, 2_060, 20_000):
        whole = np.unique(draw.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64))[: n + n // 8]
        more = np.unique(draw.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64))[:n]
        one = np.sort(draw.choice(whole, n, replace=False))
        for linked, other in ((True, whole), (False, more)):
            rows.append((n, linked, len(one), len(other), sketch(one).tolist(), sketch(other).tolist()))
    df = spark.createDataFrame(rows, "k int, linked boolean, n_a long, n_b long, s_a array<long>, s_b array<long>")
    assert any(len(r[4]) != len(r[5]) for r in rows)
    for r in df.select("linked", _near("a", "b", 4, 5).alias("near")).collect():
        assert r["near"] == r["linked"]
