"""Queries over time: splits, histories, pairs and calendar features."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketforge.functions.columns import tidy
from basketforge.operators import temporal as T
from basketforge.plans.registry import register
from basketforge.plans.shared_sql import TX, with_sql
from basketforge.sources.transactions import transactions as tx

#: Splits and buckets that fit the 349 weeks of the given tables.
TRAIN, VALID, EDGES = 239, 284, (0, 75, 150, 225, 300, 349)

_WEEKS = "weeks AS (SELECT week_original, row_number() OVER (ORDER BY week_original) AS week FROM (SELECT DISTINCT SHOP_WEEK AS week_original FROM tx))"
_META = """meta0 AS (SELECT BASKET_ID AS basket_id, arg_min(STORE_CODE, LINE_SEQ) AS store_id, min(CUST_CODE) AS customer_id, min(SHOP_WEEK) AS week_original, min(SHOP_DATE) AS shop_date, min(SHOP_WEEKDAY) AS shop_weekday, min(SHOP_HOUR) AS shop_hour,
  count(DISTINCT PROD_CODE) AS num_products, sum(SPEND) AS total_spend, sum(QUANTITY) AS total_quantity FROM tx GROUP BY ALL),
meta AS (SELECT *, CASE WHEN week <= 239 THEN 'train' WHEN week <= 284 THEN 'validation' ELSE 'test' END AS split, week - 1 AS history_length,
  CAST(CASE WHEN week - 1 <= 75 THEN 1 WHEN week - 1 <= 150 THEN 2 WHEN week - 1 <= 225 THEN 3 WHEN week - 1 <= 300 THEN 4 ELSE 5 END AS BIGINT) AS bucket FROM meta0 JOIN weeks USING (week_original))"""
META = f"{TX}, {_WEEKS}, {_META}"
_PRODS = "bprod AS (SELECT BASKET_ID AS basket_id, list(PROD_CODE ORDER BY LINE_SEQ) AS products FROM tx GROUP BY ALL)"
_PRIOR = "prior AS (SELECT *, CASE WHEN customer_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY customer_id ORDER BY week, basket_id) - 1 END AS prior_baskets FROM meta)"
_SEEN = "seen AS (SELECT DISTINCT PROD_CODE FROM tx JOIN weeks ON SHOP_WEEK = week_original WHERE week <= {t}), novel AS (SELECT DISTINCT BASKET_ID AS basket_id FROM tx WHERE PROD_CODE NOT IN (SELECT PROD_CODE FROM seen))"
PAIRS = f"""{META}, {_PRODS}, ahead AS (SELECT customer_id, basket_id AS input_basket_id, week AS input_week, week_original AS input_week_original, store_id AS input_store_id, products AS input_products, row_number() OVER o - 1 AS num_history_baskets,
  lead(basket_id) OVER o AS target_basket_id, lead(week) OVER o AS target_week, lead(week_original) OVER o AS target_week_original, lead(store_id) OVER o AS target_store_id, lead(shop_weekday) OVER o AS target_weekday, lead(shop_hour) OVER o AS target_hour,
  lead(products) OVER o AS target_products, lead(split) OVER o AS split, lead(bucket) OVER o AS bucket FROM meta JOIN bprod USING (basket_id) WHERE customer_id IS NOT NULL WINDOW o AS (PARTITION BY customer_id ORDER BY week, shop_date, basket_id)),
pairs AS (SELECT *, target_week - input_week AS week_gap, len(input_products) AS input_size, len(target_products) AS target_size FROM ahead WHERE target_basket_id IS NOT NULL AND len(target_products) >= 2 AND target_week - input_week <= 12 AND num_history_baskets >= 1)"""


def meta(spark, sf):
    return T.history_bucket(T.assign_split(T.basket_metadata(tx(spark, sf)), TRAIN, VALID), EDGES)


def pairs(spark, sf):
    return T.next_basket_pairs(meta(spark, sf), T.basket_products(tx(spark, sf)))


@register("e10_week_index", with_sql(f"{TX}, {_WEEKS}", "SELECT * FROM weeks"))
def e10(spark, sf):
    return tidy(T.week_index(tx(spark, sf)))


@register("d25_basket_metadata", with_sql(META, "SELECT basket_id, customer_id, store_id, week, week_original, num_products, total_spend, total_quantity FROM meta", "total_spend, total_quantity"))
def d25(spark, sf):
    return tidy(T.basket_metadata(tx(spark, sf)).select("basket_id", "customer_id", "store_id", "week", "week_original", "num_products", "total_spend", "total_quantity"))


@register("b7_splits", with_sql(META, "SELECT split, count(*) AS baskets FROM meta GROUP BY ALL"))
def b7(spark, sf):
    return tidy(meta(spark, sf).groupBy("split").agg(F.count("*").alias("baskets")))


@register("b8_history_buckets", with_sql(META, "SELECT basket_id, history_length, bucket FROM meta"))
def b8(spark, sf):
    return tidy(meta(spark, sf).select("basket_id", "history_length", "bucket"))


@register("b10_dates", with_sql(META, "SELECT basket_id, strftime(strptime(CAST(shop_date AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS iso FROM meta"))
def b10(spark, sf):
    return tidy(meta(spark, sf).select("basket_id", T.date_string("shop_date").alias("iso")))


@register("b11_min_basket", with_sql(f"{TX}, {_PRODS}", "SELECT basket_id, len(products) AS n FROM bprod WHERE len(products) >= 2"))
def b11(spark, sf):
    return tidy(T.min_basket(T.basket_products(tx(spark, sf))).select("basket_id", F.size("products").alias("n")))


@register("b12_holidays", with_sql(META, f"SELECT basket_id, week_original % 100 IN {T.HOLIDAY_WEEKS} AS is_holiday FROM meta"))
def b12(spark, sf):
    return tidy(meta(spark, sf).select("basket_id", (F.col("week_original") % 100).isin(*T.HOLIDAY_WEEKS).alias("is_holiday")))


@register("e9_prior_baskets", with_sql(f"{META}, {_PRIOR}", "SELECT basket_id, prior_baskets, prior_baskets < 5 AS is_cold_start FROM prior"))
def e9(spark, sf):
    return tidy(T.prior_baskets(meta(spark, sf)).select("basket_id", "prior_baskets", "is_cold_start"))


@register("c7_novel_products", with_sql(f"{META}, {_SEEN.format(t=3)}", "SELECT basket_id, basket_id IN (SELECT basket_id FROM novel) AS has_novel FROM meta"))
def c7(spark, sf):
    """With an early cut-off: later on every product of the given tables has been seen."""
    return tidy(T.flag_novel(meta(spark, sf), tx(spark, sf), 3).select("basket_id", "has_novel"))


@register("e11_last_visit", with_sql(META, "SELECT basket_id, lag(week_original) OVER (PARTITION BY customer_id ORDER BY week, basket_id) AS last_visit_week FROM meta WHERE customer_id IS NOT NULL"))
def e11(spark, sf):
    return tidy(T.last_visit(meta(spark, sf)).select("basket_id", "last_visit_week"))


@register("d26_basket_products", with_sql(f"{TX}, {_PRODS}", "SELECT basket_id, array_to_string(products, ',') AS products FROM bprod"))
def d26(spark, sf):
    return tidy(T.basket_products(tx(spark, sf)).withColumn("products", F.array_join("products", ",")))


@register("a4_lists", with_sql(f"{TX}, {_PRODS}", "SELECT basket_id, array_to_string(products, ',') AS as_text, len(products) AS n FROM bprod"))
def a4(spark, sf):
    """Lists to text and JSON, and back."""
    from basketforge.sources.transactions import decode_lists, encode_lists

    df = T.basket_products(tx(spark, sf)).withColumn("again", F.col("products"))
    back = decode_lists(encode_lists(df, as_json=["again"], as_text=["products"]), from_json={"again": "array<string>"}, from_text=["products"])
    return tidy(back.select("basket_id", F.array_join("again", ",").alias("as_text"), F.size("products").alias("n")))


@register("d27_basket_attributes", with_sql(TX, "SELECT BASKET_ID AS basket_id, min(BASKET_TYPE) AS basket_type, min(BASKET_DOMINANT_MISSION) AS basket_dominant_mission, min(BASKET_PRICE_SENSITIVITY) AS basket_price_sensitivity, min(BASKET_SIZE) AS basket_size FROM tx GROUP BY ALL"))
def d27(spark, sf):
    return tidy(T.basket_attributes(tx(spark, sf)))


@register("d28_basket_time", with_sql(META, "SELECT basket_id, strftime(strptime(CAST(shop_date AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS shop_date, shop_weekday, shop_hour FROM meta"))
def d28(spark, sf):
    return tidy(T.basket_time(tx(spark, sf)))


@register("d30_split_report", with_sql(f"{META}, {_PRIOR}, {_SEEN.format(t=TRAIN)}", "SELECT split, bucket, count(*) AS baskets, count(DISTINCT customer_id) AS customers, avg((prior_baskets < 5)::INT) AS cold_share, avg((basket_id IN (SELECT basket_id FROM novel))::INT) AS novel_share, avg(history_length) AS mean_history, median(history_length) AS median_history FROM prior GROUP BY ALL", "cold_share, novel_share, mean_history, median_history"))
def d30(spark, sf):
    m = T.flag_novel(T.prior_baskets(meta(spark, sf)), tx(spark, sf), TRAIN)
    return tidy(T.split_report(m))


_TRIPS = """trips0 AS (SELECT CUST_CODE AS customer_id, BASKET_ID AS basket_id, min(SHOP_WEEK) AS SHOP_WEEK, list(DISTINCT PROD_CODE) AS products FROM tx WHERE CUST_CODE IS NOT NULL GROUP BY ALL),
trips AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY SHOP_WEEK DESC, basket_id DESC) AS recency FROM trips0) WHERE recency <= 20)"""
_ATT = "att AS (SELECT *, raw / sum(raw) OVER (PARTITION BY customer_id) AS attention FROM (SELECT *, exp(CASE WHEN n = 1 THEN -1.0 ELSE -(recency - 1) / (n - 1) END) AS raw FROM (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n FROM trips)))"


@register("e12_recent_trips", with_sql(f"{TX}, {_TRIPS}", "SELECT customer_id, basket_id, recency, len(products) AS n FROM trips"))
def e12(spark, sf):
    return tidy(T.recent_trips(tx(spark, sf)).select("customer_id", "basket_id", "recency", F.size("products").alias("n")))


@register("e15_trip_attention", with_sql(f"{TX}, {_TRIPS}, {_ATT}", "SELECT customer_id, basket_id, attention FROM att", "attention"))
def e15(spark, sf):
    return tidy(T.trip_attention(T.recent_trips(tx(spark, sf))).select("customer_id", "basket_id", "attention"))


_HIST = f"{META}, {_PRODS}, hist AS (SELECT customer_id, basket_id, week, list(basket_id) OVER w AS past, list(list_slice(products, 1, 30)) OVER w AS past_products FROM meta JOIN bprod USING (basket_id) WHERE customer_id IS NOT NULL WINDOW w AS (PARTITION BY customer_id ORDER BY week, basket_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))"


@register("e13_customer_histories", with_sql(_HIST, "SELECT basket_id, coalesce(len(past), 0) AS n_baskets, coalesce(len(flatten(past_products)), 0) AS n_products, coalesce(array_to_string(past, ','), '') AS past FROM hist"))
def e13(spark, sf):
    h = T.customer_histories(meta(spark, sf), T.basket_products(tx(spark, sf)))
    return tidy(h.select("basket_id", F.size("history").alias("n_baskets"), F.size(F.flatten("history.products")).alias("n_products"), F.array_join(F.transform("history.basket_id", lambda x: x.cast("string")), ",").alias("past")))


_P_OUT = ["customer_id", "input_basket_id", "input_week", "input_store_id", "target_basket_id", "target_week", "target_week_original", "target_store_id", "target_weekday", "target_hour", "num_history_baskets", "week_gap", "input_size", "target_size", "split", "bucket"]


@register("e14_next_basket_pairs", with_sql(PAIRS, f"SELECT {', '.join(_P_OUT)} FROM pairs"))
def e14(spark, sf):
    return tidy(pairs(spark, sf).select(_P_OUT))


@register("k8_training_samples", with_sql(f"{_HIST}, tgt AS (SELECT BASKET_ID AS basket_id, list(DISTINCT PROD_CODE) AS t FROM tx GROUP BY ALL)", "SELECT h.basket_id, h.customer_id, len(past) AS n_history, len(t) AS n_targets, m.split, m.bucket FROM hist h JOIN tgt USING (basket_id) JOIN meta m USING (basket_id) WHERE len(t) >= 2 AND len(past) > 0"))
def k8(spark, sf):
    t, m = tx(spark, sf), meta(spark, sf)
    s = T.training_samples(T.customer_histories(m, T.basket_products(t)), m, t)
    return tidy(s.select("basket_id", "customer_id", F.size("history").alias("n_history"), F.size("target_products").alias("n_targets"), "split", "bucket"))


@register("k9_enhanced_samples", with_sql(META, "SELECT basket_id, split, bucket, strftime(strptime(CAST(shop_date AS VARCHAR), '%Y%m%d'), '%Y-%m-%d') AS shop_date, shop_weekday, shop_hour FROM meta"))
def k9(spark, sf):
    return tidy(T.enhanced_samples(meta(spark, sf), tx(spark, sf)).select("basket_id", "split", "bucket", "shop_date", "shop_weekday", "shop_hour"))


@register("g3_split_samples", with_sql(PAIRS, "SELECT split, bucket, count(*) AS n FROM pairs GROUP BY ALL"))
def g3(spark, sf):
    return tidy(pairs(spark, sf).groupBy("split", "bucket").agg(F.count("*").alias("n")))


@register("c10_attach_metadata", with_sql(f"{META}, {_PRODS}", "SELECT basket_id, len(products) AS n, split, week FROM bprod LEFT JOIN meta USING (basket_id)"))
def c10(spark, sf):
    return tidy(T.basket_products(tx(spark, sf)).join(meta(spark, sf), "basket_id", "left").select("basket_id", F.size("products").alias("n"), "split", "week"))


@register("p6_cold_customers", with_sql(META, f"SELECT DISTINCT customer_id FROM meta WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM meta WHERE week <= {TRAIN} AND customer_id IS NOT NULL)"))
def p6(spark, sf):
    return tidy(T.cold_customers(meta(spark, sf), TRAIN))


_CAL = f"""cal0 AS (SELECT *, lag(week_original) OVER (PARTITION BY customer_id ORDER BY week, basket_id) AS lw FROM meta WHERE customer_id IS NOT NULL UNION ALL SELECT *, NULL FROM meta WHERE customer_id IS NULL),
cal AS (SELECT basket_id, least(greatest(week_original % 100, 1), 52) AS week_of_year, CAST(least(greatest(floor((week_original % 100 - 1) / 4) + 1, 1), 12) AS BIGINT) AS month, least(shop_weekday, 7) AS weekday, least(shop_hour, 24) AS hour,
  (week_original - min(week_original) OVER ()) / greatest(max(week_original) OVER () - min(week_original) OVER (), 1) AS trend, coalesce(least((week_original - lw) / 52, 1.0), 0.5) AS recency FROM cal0)"""
CALENDAR = f"{META}, {_CAL}, calendar AS (SELECT *, CASE WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' WHEN month IN (9, 10, 11) THEN 'fall' ELSE 'winter' END AS season, week_of_year IN {T.HOLIDAY_WEEKS} AS is_holiday FROM cal)"


@register("h8_calendar_features", with_sql(CALENDAR, "SELECT basket_id, week_of_year, month, season, is_holiday, weekday, hour FROM calendar"))
def h8(spark, sf):
    return tidy(T.calendar_features(meta(spark, sf)).select("basket_id", "week_of_year", "month", "season", "is_holiday", "weekday", "hour"))


@register("h9_trend_recency", with_sql(CALENDAR, "SELECT basket_id, trend, recency FROM calendar", "trend, recency"))
def h9(spark, sf):
    return tidy(T.calendar_features(meta(spark, sf)).select("basket_id", "trend", "recency"))


@register("g1_union_parts", with_sql(META, "SELECT basket_id, split FROM meta"))
def g1(spark, sf):
    """The splits, filtered apart and put together again."""
    m = meta(spark, sf).select("basket_id", "split")
    out = m.where("split = 'train'")
    for name in ("validation", "test"):
        out = out.unionByName(m.where(F.col("split") == name))
    return tidy(out)


@register("g2_dedupe", with_sql(TX, "SELECT BASKET_ID, min(SHOP_DATE) AS SHOP_DATE FROM tx GROUP BY ALL"))
def g2(spark, sf):
    t = tx(spark, sf)
    return tidy(t.groupBy("BASKET_ID").agg(F.min_by("SHOP_DATE", "LINE_SEQ").alias("SHOP_DATE")))


@register("g4_set_operations", with_sql(META, "SELECT (SELECT count(*) FROM (SELECT customer_id FROM meta WHERE split = 'train' INTERSECT SELECT customer_id FROM meta WHERE split = 'test')) AS both_splits, (SELECT count(*) FROM (SELECT store_id FROM meta WHERE split = 'train' UNION SELECT store_id FROM meta WHERE split = 'test')) AS stores, (SELECT count(*) FROM (SELECT customer_id FROM meta WHERE split = 'test' EXCEPT SELECT customer_id FROM meta WHERE split = 'train')) AS only_test"))
def g4(spark, sf):
    m = meta(spark, sf)
    train, test = m.where("split = 'train'"), m.where("split = 'test'")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    both = one(train.select("customer_id").intersect(test.select("customer_id")), "both_splits")
    stores = one(train.select("store_id").union(test.select("store_id")).distinct(), "stores")
    only = one(test.select("customer_id").subtract(train.select("customer_id")), "only_test")
    return tidy(both.crossJoin(stores).crossJoin(only))
