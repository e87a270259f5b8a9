"""As-of join, hierarchical fill and next-basket sequences on small tables."""

from pyspark.sql import functions as F

from basketforge.operators import sequences as S
from basketforge.operators import temporal as T
from basketforge.operators import vectors as V


def test_last_known(spark):
    known = spark.createDataFrame([("a", 3, 1.0), ("a", 7, 2.0), ("b", 5, 3.0), (None, 1, 4.0)], "k string, at int, price double")
    wanted = spark.createDataFrame([("a", x) for x in (2, 3, 3, 6, 7, 99)] + [("b", 4), ("c", 1), (None, 2)], "k string, at int")
    got = sorted((tuple(r) for r in T.last_known(wanted, known, ["k"], "at", ["price"]).collect()), key=str)
    assert got == sorted([("a", 2, None), ("a", 3, 1.0), ("a", 6, 1.0), ("a", 7, 2.0), ("a", 99, 2.0), ("b", 4, None), ("c", 1, None), (None, 2, 4.0)], key=str)
    assert T.last_known(wanted, known.limit(0), ["k"], "at", ["price"]).where("known_price is not null").count() == 0


def test_fill_by_levels(spark):
    groups = spark.createDataFrame([("a", "c1", "d1"), ("b", "c1", "d1"), ("c", "c1", "d1"), ("d", "c2", "d1"), ("e", "c3", "d2"), ("f", None, None)], "node string, category string, department string")
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 2.0])], "node string, vector array<double>")
    got = {r.node: (r.source, r.vector) for r in V.fill_by_levels(known, groups, ["category", "department"]).collect()}
    assert got == {"a": ("own", [1.0, 0.0]), "b": ("own", [3.0, 2.0]), "c": ("category", [2.0, 1.0]), "d": ("department", [2.0, 1.0]), "e": ("none", [0.0, 0.0]), "f": ("none", [0.0, 0.0])}
    assert {r.source for r in V.fill_by_levels(known.limit(0), groups, ["category"]).collect()} == {"none"}


def test_next_basket_sequences_and_prices(spark):
    pairs = spark.createDataFrame(
        [(1, 10, 11, 5, 202005, "s", ["p", "q", "p"], ["q", "z", "q"], 1)], "customer_id long, input_basket_id long, target_basket_id long, input_week int, input_week_original int, input_store_id string, input_products array<string>, target_products array<string>, week_gap int"
    ).withColumns({c: F.lit(0) for c in ("target_store_id", "target_week_original", "target_weekday", "target_hour", "num_history_baskets", "split", "bucket")})
    vocab = spark.createDataFrame([("p", 1), ("q", 2), ("z", 3)], "value string, idx int")
    features = spark.createDataFrame([("p", "s", 202001, [1.0] * 64), ("p", "s", 202004, [4.0] * 64), ("p", "s", 202006, [6.0] * 64), ("q", "t", 202005, [9.0] * 64)], "product_id string, store_id string, week int, features array<double>")
    r = S.next_basket_samples(pairs, vocab, features).first()
    assert r.input_ids == [1, 2, 1, 4] and r.input_length == 4 and r.target_ids == [2, 3, 2, 4] and r.target_length == 4 and r.target == [2, 3]
    # The last price at or before the week, in the input's own store; zeros where there is none.
    assert r.price_weeks == [202004, 0, 202004] and [v[0] for v in r.input_price_features] == [4.0, 0.0, 4.0]
    short = S.next_basket_samples(pairs, vocab, features, 3).first()
    assert short.input_ids == [1, 2, 4] and short.target_ids == [2, 3, 4] and len(short.price_weeks) == 2
