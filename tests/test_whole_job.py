"""Registered queries answer for all of their input."""

import pytest
from compare import duck
from test_rules import lines

from basketforge.operators import pricing as P
from basketforge.operators import sequences as S
from basketforge.operators import vectors as V
from basketforge.plans import all_queries, pricing_queries

@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_wanted_cells_and_fill_cover_late_weeks(spark):
    tx = lines(spark, [dict(BASKET_ID=1, SHOP_WEEK=200604, SPEND=4.0), dict(BASKET_ID=2, SHOP_WEEK=200630, SPEND=6.0), dict(BASKET_ID=3, SHOP_WEEK=200640, PROD_CODE="P2"), dict(BASKET_ID=4, SHOP_WEEK=200701, PROD_CODE="P2")])
    wanted = pricing_queries._cells_wanted(tx)
    got = {r.week: r.price for r in P.forward_filled(P.derive_prices(tx), wanted, tx).where("product_id = 'P1'").collect()}
    assert got == {200604: 4.0, 200630: 6.0, 200640: 6.0, 200701: 6.0}
    assert P.apply_waterfall(P.derive_prices(tx), wanted, tx).where("product_id = 'P1'").count() == 4


def test_unknown_values_take_the_default(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "basket_id long, store_id string")
    vocab = S.build_vocab(rows.where("basket_id = 1"), "store_id")
    assert {r.basket_id: r.i for r in S.encode_ids(rows, vocab, "store_id", "i").collect()} == {1: 1, 2: 0, 3: 0}
    known = spark.createDataFrame([("a", [1.0, 2.0])], "store_id string, vector array<double>")
    assert {r.basket_id: r.vector for r in V.fetch_embeddings(rows, known, "store_id", 2).collect()} == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "node string, group string")
    got = {r.node: (r.vector, r.filled) for r in V.fill_unseen(known.withColumnRenamed("store_id", "node"), groups).collect()}
    assert got == {"a": ([1.0, 2.0], False), "b": ([1.0, 2.0], True), "c": (None, True)}


def test_history_keeps_the_most_recent_baskets(spark):
    past = [dict(products=[p, "z"]) for p in "abcd"]
    rows = spark.createDataFrame([(1, past), (2, past[:1])], "basket_id long, history array<struct<products: array<string>>>")
    vocab = S.build_vocab(spark.createDataFrame([(v,) for v in "abcdz"], "v string"), "v")
    assert {r.basket_id: r.grid for r in S.encode_history(rows, vocab, 3, 2).collect()} == {1: [[2, 5], [3, 5], [4, 5]], 2: [[1, 5], [0, 0], [0, 0]]}


def test_masked_samples_hold_whole_baskets(spark, con, small):
    longest = con.sql("SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)").fetchall()[0][0]
    assert longest > 6
    assert max(len(r.masked.split(",")) for r in all_queries()["k13_masked_samples"](spark, small).select("masked").collect()) == longest
