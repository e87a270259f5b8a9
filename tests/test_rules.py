"""Small hand-made tables: ties, nulls, first rows, single rows, empty tables."""

import math

import pytest
from pyspark.sql import Row

from basketforge.operators import affinity as A
from basketforge.operators import graph as G
from basketforge.operators import missions as M
from basketforge.operators import pricing as P
from basketforge.operators import ranking as R
from basketforge.operators import sequences as S
from basketforge.operators import temporal as T


def lines(spark, rows):
    base = dict(BASKET_ID=1, LINE_SEQ=1, CUST_CODE="C1", PROD_CODE="P1", PROD_CODE_10="K", PROD_CODE_20="L", PROD_CODE_30="M", PROD_CODE_40="N", STORE_CODE="S1", STORE_REGION="R1", STORE_FORMAT="LS", SHOP_WEEK=200601, SHOP_DATE=20060101, SHOP_WEEKDAY=1, SHOP_HOUR=9, QUANTITY=1.0, SPEND=2.0, BASKET_TYPE="Top Up", BASKET_DOMINANT_MISSION="Fresh", BASKET_PRICE_SENSITIVITY="LA", BASKET_SIZE="S", seg_1="AA", seg_2="N1")
    schema = "BASKET_ID long, LINE_SEQ int, CUST_CODE string, PROD_CODE string, PROD_CODE_10 string, PROD_CODE_20 string, PROD_CODE_30 string, PROD_CODE_40 string, STORE_CODE string, STORE_REGION string, STORE_FORMAT string, SHOP_WEEK int, SHOP_DATE int, SHOP_WEEKDAY int, SHOP_HOUR int, QUANTITY double, SPEND double, BASKET_TYPE string, BASKET_DOMINANT_MISSION string, BASKET_PRICE_SENSITIVITY string, BASKET_SIZE string, seg_1 string, seg_2 string"
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], schema)


def test_unit_prices_drop_bad_rows(spark):
    tx = lines(spark, [dict(QUANTITY=0.0), dict(SPEND=0.0), dict(SPEND=200.0), dict(SPEND=3.0, QUANTITY=2.0)])
    assert [r.unit_price for r in P.unit_prices(tx).collect()] == [1.5]


def test_base_price_counts_observed_weeks(spark):
    prices = spark.createDataFrame([("p", "s", w, float(v)) for w, v in ((1, 9), (2, 3), (30, 4), (40, 5), (50, 2))], "product_id string, store_id string, week int, actual_price double")
    got = {r.week: r.base_price for r in P.base_prices(prices).collect()}
    assert got == {1: 9.0, 2: 9.0, 30: 9.0, 40: 9.0, 50: 5.0}


def test_discount_is_capped_and_single_rows_are_not_volatile(spark):
    df = P.derive_prices(lines(spark, [dict(SHOP_WEEK=1, SPEND=50.0), dict(SHOP_WEEK=2, SPEND=1.0)]))
    got = {r.week: r for r in df.collect()}
    assert got[2].discount_depth == 0.7 and got[2].promo_flag and got[2].validation_flags == "high_volatility"
    alone = P.derive_prices(lines(spark, [dict()])).collect()[0]
    assert alone.validation_flags == "" and alone.quality_score == pytest.approx(0.8)


def test_primary_store_tie_takes_smaller_code(spark):
    tx = lines(spark, [dict(BASKET_ID=1, STORE_CODE="S2"), dict(BASKET_ID=2, STORE_CODE="S1")])
    row = A.assemble_affinity(tx).collect()[0]
    assert row.primary_store == "S1" and row.loyalty_score == 0.5 and row.visit_concentration == 1.0


def test_switching_looks_back_over_observed_weeks(spark):
    weeks = [("S1", 1), ("S2", 2), ("S1", 3), ("S3", 4)]
    tx = lines(spark, [dict(BASKET_ID=k, STORE_CODE=s, SHOP_WEEK=w) for k, (s, w) in enumerate(weeks)])
    row = A.switching_rate(tx).collect()[0]
    assert (row.switch_count, row.total_weeks) == (2, 3)
    assert A.switching_rate(lines(spark, [dict()])).collect()[0].switching_rate == 0.0


def test_anonymous_customers_are_left_out(spark):
    assert A.assemble_affinity(lines(spark, [dict(CUST_CODE=None)])).count() == 0


def test_mission_entropy_and_first_label_on_ties(spark):
    tx = lines(spark, [dict(BASKET_ID=1, BASKET_TYPE="Top Up"), dict(BASKET_ID=2, BASKET_TYPE="Full Shop")])
    row = M.mission_type_dist(M.customer_baskets(tx)).collect()[0]
    assert row.dominant_mission_type == "Full Shop" and row.mission_type_entropy == pytest.approx(math.log(2))


def test_edge_survives_only_in_top_of_both_ends(spark):
    edges = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    assert {(r.src, r.dst) for r in G.prune_topk(edges, 1).collect()} == {("a", "b")}


def test_components_and_clusters(spark):
    edges = spark.createDataFrame([("b", "a", 1.0), ("c", "b", 1.0), ("x", "y", 1.0), ("q", "r", 0.1)], "src string, dst string, weight double")
    got = {r.node: r.component for r in G.component_labels(edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "q": "q", "r": "q"}
    products = spark.createDataFrame([(p, "k") for p in "abcqrxz"], "product_id string, sub_commodity string")
    clusters = {r.product_id: r.substitution_cluster for r in G.substitution_clusters(products, edges).collect()}
    assert clusters["a"] == clusters["b"] == clusters["c"] == 0 and clusters["q"] == clusters["r"] == clusters["z"] != clusters["x"]
    assert {r.substitution_cluster for r in G.substitution_clusters(products, edges, 9.0).collect()} == {0}


def test_history_bucket_edges(spark):
    df = spark.createDataFrame([(w,) for w in (1, 26, 27, 118, 200)], "week int")
    assert [r.bucket for r in T.history_bucket(df).orderBy("week").collect()] == [1, 1, 2, 5, 5]


def test_tokens_keep_the_end_token(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "value string, idx int")
    baskets = spark.createDataFrame([(1, ["b", "?", "a", "b"]), (2, ["?"])], "basket_id long, products array<string>")
    got = {r.basket_id: r.tokens for r in S.tokenize(baskets, vocab, 3).collect()}
    assert got == {1: [2, 1, 3], 2: [3]}
    back = {r.basket_id: r["values"] for r in S.detokenize(S.tokenize(baskets, vocab, 9), vocab).collect()}
    assert back == {1: ["b", "a", "b"]}


def test_perfect_ranking_scores_one(spark):
    scores = spark.createDataFrame([Row(sample_id=1, item=f"i{k:02}", score=float(-k)) for k in range(30)])
    truth = spark.createDataFrame([Row(sample_id=1, item=f"i{k:02}") for k in range(20)])
    row = R.basket_metrics(scores, truth).collect()[0]
    assert [row.precision_5, row.precision_20, row.recall_20, row.ndcg_10, row.hit_rate_5] == pytest.approx([1.0] * 5)
    targets = spark.createDataFrame([Row(sample_id=1, target="i00")])
    assert R.store_metrics(scores, targets).collect()[0].mrr == 1.0


def test_empty_tables_give_empty_results(spark):
    tx = lines(spark, [dict()]).limit(0)
    for df in (P.derive_prices(tx), A.assemble_affinity(tx), G.build_graph(tx), G.graph_nodes(tx)):
        assert df.count() == 0


def test_readers_and_writers(spark, tmp_path):
    from basketforge.sources import transactions as X

    tx = spark.createDataFrame([(200601, 1.5, "P1"), (200602, float("nan"), None)], "SHOP_WEEK int, SPEND double, PROD_CODE string")
    X.write_stage(tx, str(tmp_path / "stage"), ["SHOP_WEEK"])
    assert X.read_stage(spark, str(tmp_path / "stage")).count() == 2
    X.write_csv(tx, str(tmp_path / "csv"))
    calendar = spark.createDataFrame([(200601, "20060102", "20060108")], "shop_week int, date_from string, date_to string")
    X.write_csv(calendar, str(tmp_path / "cal"))
    row = X.read_calendar(spark, str(tmp_path / "cal")).collect()[0]
    assert str(row.date_to) == "2006-01-08"
