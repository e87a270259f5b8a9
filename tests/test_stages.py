"""Stages in buckets, and saved aggregates of chunks."""

import pytest
from pyspark.sql import functions as F

from basketforge.operators import quality as Q
from basketforge.operators import states as ST
from basketforge.operators import vectors as V
from basketforge.session import staging_path
from basketforge.sources import transactions as files


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_buckets_meet_without_an_exchange(spark, no_broadcast):
    edges = spark.createDataFrame([(f"p{k}", f"p{k * 7 % 50}", "copurchase", 1.0 + k) for k in range(50)], "src string, dst string, edge_type string, weight double")
    vectors = spark.createDataFrame([(f"p{k}", [float(k), 1.0]) for k in range(50)], "node string, vector array<double>")
    ends, kept = files.write_bucketed(V.edge_ends(edges), "ends", ["other"], 4), files.write_bucketed(vectors, "vectors", ["node"], 4)
    near = ends.join(kept.toDF("other", "vector"), "other", "left")
    assert exchanges(near) == 0 < exchanges(V.edge_ends(edges).join(vectors.toDF("other", "vector"), "other", "left"))
    one = {r.node: r.vector for r in V.hop_from_ends(kept, ends, 2).collect()}
    want = {r.node: r.vector for r in V.aggregate_hop(vectors, edges, 2).collect()}
    assert set(one) == set(want) and all(one[n] == pytest.approx(want[n]) for n in want)


def test_price_lookup_meets_without_an_exchange(spark, no_broadcast):
    by = ["product_id", "store_id", "week"]
    cells = spark.createDataFrame([(f"p{k % 9}", f"s{k % 4}", k, float(k)) for k in range(90)], "product_id string, store_id string, week int, price double")
    items, prices = files.write_bucketed(cells.drop("price"), "items", by, 4), files.write_bucketed(cells, "cells", by, 4)
    joined = items.join(prices, by, "left")
    assert exchanges(joined) == 0 and joined.where("price is null").count() == 0


def test_saved_aggregate_equals_the_whole(spark):
    rows = spark.createDataFrame([(f"k{k % 7}", k, (k * 37) % 101) for k in range(500)], "key string, at int, x int")
    parts = [ST.counted("n"), ST.summed("total", "x"), ST.least("low", "x"), ST.greatest("high", "x"), ST.first_by("first", ["at"], ["x"])]
    saved = ST.SavedAggregate(spark, staging_path(spark, "states"), {"key": "key"}, parts)
    for k in (0, 1, 2, 1):
        saved.add(rows.where(F.col("at") % 3 == k), str(k))
    whole = {r.key: tuple(r)[1:] for r in rows.groupBy("key").agg(F.count("*"), F.sum("x"), F.min("x"), F.max("x"), F.min_by("x", "at")).collect()}
    told = lambda s: {r.key: (r.n, r.total, r.low, r.high, r["first"].x) for r in s.result().collect()}
    assert told(saved) == whole
    small = saved.compacted(staging_path(spark, "compacted"))
    assert told(small) == whole and small.states().count() == 7 < saved.states().count()
    # A new chunk reads neither the old chunks nor their states.
    small.add(spark.createDataFrame([("new", 1, 5)], rows.schema), "later")
    assert told(small) == {**whole, "new": (1, 5, 5, 5, 5)}
    saved.add(rows.limit(0), "empty")
    assert told(saved) == whole


def test_saved_activity_of_an_empty_chunk(spark):
    saved = Q.saved_activity(spark, staging_path(spark, "activity"))
    saved.add(spark.createDataFrame([], "CUST_CODE string"), "0")
    assert saved.result().count() == 0
