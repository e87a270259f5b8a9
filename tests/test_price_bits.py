"""Tiers and ranks of prices whose last bit changes whenever they are computed, as sums of shuffled rows may."""

import random

from pyspark.sql import functions as F

from basketforge.operators import brands as B


def _products(spark):
    """Six prices a category; each evaluation adds noise far below any gap."""
    noisy = F.udf(lambda x: x * (1 + random.random() * 1e-12), "double").asNondeterministic()
    rows = [(f"{c}{k}", c, float(k), 0.1) for c in "AB" for k in range(1, 7)]
    df = spark.createDataFrame(rows, "product_id string, sub_commodity string, price double, price_std double")
    return df.withColumn("mean_price", noisy("price"))


def test_a_price_that_is_a_bound_meets_it(spark):
    for _ in range(3):
        got = {r.product_id: r.price_tier for r in B.price_tiers(_products(spark)).collect()}
        assert got == {f"{c}{k}": "value" if k <= 2 else "premium" if k >= 5 else "mid" for c in "AB" for k in range(1, 7)}


def test_every_price_meets_its_rank(spark):
    got = {r.product_id: r.category_price_percentile for r in B.price_rank(_products(spark)).collect()}
    assert got == {f"{c}{k}": k / 6 for c in "AB" for k in range(1, 7)}
