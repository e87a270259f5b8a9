"""Exact quantiles and average ranks by ranges, against numpy and against Spark's own."""

import numpy as np
from pyspark.sql import functions as F

from basketforge.operators import quantiles as Q
from basketforge.operators import quality, vectors

SHARES = {"low": 0.05, "median": 0.5, "high": 0.95, "least": 0.0, "most": 1.0}


def rows(seed):
    rng = np.random.default_rng(seed)
    out = [("hot", float(x), float(-x)) for x in rng.integers(0, 400, 3_000)]
    out += [("even", 1.5, None) for _ in range(500)] + [("one", 7.0, 2.0), ("two", 1.0, 4.0), ("two", 2.0, 8.0), ("none", None, None), (None, 3.0, 1.0), (None, 4.0, 5.0)]
    return out


def test_quantiles_match_numpy(spark):
    data = rows(1)
    df = spark.createDataFrame(data, "k string, x double, y double")
    got = {r.k: r.asDict() for r in Q.exact_quantiles(df, ["k"], ["x", "y"], SHARES).collect()}
    assert set(got) == {"hot", "even", "one", "two", None}
    for k, r in got.items():
        for at, c in ((1, "x"), (2, "y")):
            own = [d[at] for d in data if d[0] == k and d[at] is not None]
            for name, share in SHARES.items():
                assert (r[f"{c}_{name}"] is None) if not own else abs(r[f"{c}_{name}"] - np.percentile(own, 100 * share)) < 1e-9
    whole = Q.exact_quantiles(df, [], ["x"], {"median": 0.5}).collect()
    assert len(whole) == 1 and whole[0].x_median == np.median([d[1] for d in data if d[1] is not None])
    assert Q.exact_quantiles(df.limit(0), ["k"], ["x"], SHARES).count() == 0


def test_no_task_holds_a_hot_group(spark):
    data = [("hot", float(k), 0.0) for k in range(20_000)] + [(f"k{k}", float(k), 0.0) for k in range(20_000)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    # Adaptive execution would put ranges of this size together; on large data it leaves them at its advisory size.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        values, ranges = Q.value_ranges(df, ["k"], "x")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in values.groupBy("part").count().collect()]
    # Half of all rows belong to one group, and still every range is near an eighth of them.
    assert len(sizes) == 8 and max(sizes) < 2.5 * len(data) / 8
    assert ranges.where("k = 'hot'").agg(F.max("size"), F.count("*")).first()[0] == 20_000


def test_average_ranks_match_windows(spark):
    df = spark.createDataFrame(rows(2), "k string, x double, y double").where("x is not null")
    got = {(r.k, r.x): (r["rank"], r["size"]) for r in Q.average_ranks(df, ["k"], "x").collect()}
    data = [d for d in rows(2) if d[1] is not None]
    for k, x in {(d[0], d[1]) for d in data}:
        own = [d[1] for d in data if d[0] == k]
        assert got[k, x] == (sum(v < x for v in own) + (sum(v == x for v in own) + 1) / 2, len(own))


def test_pairs_are_drawn_once_each(spark):
    df = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(101)], "id long, v array<double>")
    got = quality.mean_pair_distance(df, "id", "v", 2.0).first()
    assert got.pairs == 50 and got.mean_distance > 1
    assert quality.mean_pair_distance(df.limit(0), "id", "v", 2.0).first().pairs == 0


def test_product_as_a_relation_equals_the_arrow_product(spark):
    rng = np.random.default_rng(5)
    data = [(f"n{k}", rng.standard_normal(176).tolist() if k else [0.0] * 176) for k in range(40)]
    df = spark.createDataFrame(data, "node string, vector array<double>")
    weights = vectors.weight_rows(spark, 176, 128, 3)
    one = {r.node: np.maximum(r.vector, 0) for r in vectors.relation_product(df, weights, 128).collect()}
    two = {r.node: np.array(r.vector) for r in df.select("node", vectors.project(F.col("vector"), 176, 128, 3).alias("vector")).collect()}
    assert set(one) == set(two) and all(np.allclose(one[n], two[n], atol=1e-6) for n in one)
    assert not one["n0"].any()
