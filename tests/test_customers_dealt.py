"""Trips, their vectors and mission patterns come from lines that are dealt by customer once."""

from pyspark.sql import functions as F

from basketforge import session
from basketforge.operators import missions as M
from basketforge.operators import temporal as T
from basketforge.operators import vectors as V

LINES = "BASKET_ID long, LINE_SEQ int, CUST_CODE string, PROD_CODE string, SHOP_WEEK int, BASKET_TYPE string, BASKET_DOMINANT_MISSION string, BASKET_PRICE_SENSITIVITY string, BASKET_SIZE string, QUANTITY double, SPEND double"


def _lines(spark):
    rows = [(b, k, None if b % 5 == 0 else f"C{b % 3}", f"p{(b + k) % 4}", 200001 + b, "Top Up", "Fresh", "LA", "S", 1.0, 2.0) for b in range(1, 12) for k in (1, 2)]
    return spark.createDataFrame(rows, LINES)


def _moves(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_move_once_on_the_way_to_customers(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 1)
    known = spark.createDataFrame([(f"p{k}", [float(k)] * 128) for k in range(4)], "node string, vector array<double>")
    trips = T.trip_attention(T.recent_trips(_lines(spark), rows=22))
    assert _moves(V.history_vectors(V.trip_vectors(trips, known))) == 1
    apart = T.trip_attention(T.recent_trips(_lines(spark)))
    assert sorted(trips.collect()) == sorted(apart.collect())


def test_baskets_of_enough_trips_meet_no_copy_of_themselves(spark):
    baskets = M.customer_baskets(_lines(spark).where("BASKET_ID <> 3 and BASKET_ID <> 6"))
    kept = M.min_trips(baskets.repartition(3, "CUST_CODE"), 3)
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    assert {r.CUST_CODE: r.n for r in kept.groupBy("CUST_CODE").agg(F.count("*").alias("n")).collect()} == {"C1": 3, "C2": 3}
