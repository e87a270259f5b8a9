"""Queries over prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketforge.functions.columns import tidy
from basketforge.operators import pricing as P
from basketforge.plans.registry import register
from basketforge.plans.shared_sql import ACTUAL, ALL_PRICES, BASE, TX, UNIT, with_sql
from basketforge.sources.transactions import transactions as tx

_cells = "product_id, store_id, week"


@register("a1_transactions", with_sql(TX, "SELECT * FROM tx", "SPEND, QUANTITY"))
def a1(spark, sf):
    return tidy(tx(spark, sf))


@register("b1_unit_prices", with_sql(f"{TX}, {UNIT}", "SELECT BASKET_ID, LINE_SEQ, unit_price FROM priced", "unit_price"))
def b1(spark, sf):
    return tidy(P.unit_prices(tx(spark, sf)).select("BASKET_ID", "LINE_SEQ", "unit_price"))


@register("b2_known_customers", with_sql(TX, "SELECT BASKET_ID, LINE_SEQ, CUST_CODE FROM tx WHERE CUST_CODE IS NOT NULL"))
def b2(spark, sf):
    from basketforge.operators.affinity import known_customers

    return tidy(known_customers(tx(spark, sf)).select("BASKET_ID", "LINE_SEQ", "CUST_CODE"))


@register("d1_actual_prices", with_sql(f"{TX}, {UNIT}, {ACTUAL}", "SELECT * FROM actual", "actual_price, total_quantity, total_spend, price_std"))
def d1(spark, sf):
    return tidy(P.actual_prices(P.unit_prices(tx(spark, sf))))


@register("d1_coarse_prices", with_sql(f"{TX}, {UNIT}", "SELECT PROD_CODE_10 AS category, STORE_REGION AS region, CAST(floor(SHOP_WEEK / 100) AS BIGINT) AS year, median(unit_price) AS price, count(*) AS n FROM priced GROUP BY ALL", "price"))
def d1_coarse(spark, sf):
    """Medians over many rows, at a coarser grain."""
    year = F.floor(F.col("SHOP_WEEK") / 100).alias("year")
    priced = P.unit_prices(tx(spark, sf))
    return tidy(priced.groupBy(F.col("PROD_CODE_10").alias("category"), F.col("STORE_REGION").alias("region"), year).agg(F.median("unit_price").alias("price"), F.count("*").alias("n")))


@register("d5_observed_cells", with_sql(f"{TX}, {UNIT}", "SELECT PROD_CODE AS product_id, STORE_CODE AS store_id, SHOP_WEEK AS week, count(*) AS observations FROM priced GROUP BY ALL"))
def d5(spark, sf):
    return tidy(P.observed_cells(P.unit_prices(tx(spark, sf))))


@register("e1_base_prices", with_sql(f"{TX}, {UNIT}, {ACTUAL}, {BASE}", f"SELECT {_cells}, actual_price, base_price FROM based", "actual_price, base_price"))
def e1(spark, sf):
    return tidy(P.base_prices(P.actual_prices(P.unit_prices(tx(spark, sf)))).select(*P.CELL, "actual_price", "base_price"))


@register("b3_promotions", with_sql(f"{TX}, {UNIT}, {ACTUAL}, {BASE}", f"SELECT {_cells}, discount_depth, promo_flag FROM promo", "discount_depth"))
def b3(spark, sf):
    return tidy(P.detect_promotions(P.base_prices(P.actual_prices(P.unit_prices(tx(spark, sf))))).select(*P.CELL, "discount_depth", "promo_flag"))


@register("derived_prices", with_sql(ALL_PRICES, "SELECT * EXCLUDE (price_std) FROM prices", "actual_price, base_price, discount_depth, quality_score, total_quantity"))
def derived(spark, sf):
    return tidy(P.derive_prices(tx(spark, sf)).select(P.PRICE_COLUMNS))


@register("b4_price_flags", with_sql(ALL_PRICES, "SELECT validation_flags, count(*) AS n FROM prices GROUP BY ALL"))
def b4(spark, sf):
    return tidy(P.derive_prices(tx(spark, sf)).groupBy("validation_flags").agg(F.count("*").alias("n")))


@register("b5_quality_scores", with_sql(ALL_PRICES, f"SELECT {_cells}, quality_score FROM prices", "quality_score"))
def b5(spark, sf):
    return tidy(P.derive_prices(tx(spark, sf)).select(*P.CELL, "quality_score"))


@register("e2_price_variation", with_sql(ALL_PRICES, "SELECT product_id, store_id, stddev_samp(actual_price) / avg(actual_price) AS cv FROM prices GROUP BY ALL", "cv"))
def e2(spark, sf):
    return tidy(P.derive_prices(tx(spark, sf)).groupBy(*P.SERIES).agg((F.stddev_samp("actual_price") / F.avg("actual_price")).alias("cv")))


@register("d2_fallback_product_store", with_sql(ALL_PRICES, "SELECT product_id, store_id, median(actual_price) AS store_actual, median(base_price) AS store_base FROM prices GROUP BY ALL", "store_actual, store_base"))
def d2(spark, sf):
    return tidy(P.fallback_product_store(P.derive_prices(tx(spark, sf))))


_REGION = "regions AS (SELECT STORE_CODE AS store_id, arg_min(STORE_REGION, BASKET_ID * 1000 + LINE_SEQ) AS region FROM tx GROUP BY ALL)"


@register("c4_add_region", with_sql(f"{ALL_PRICES}, {_REGION}", f"SELECT {_cells}, region FROM prices LEFT JOIN regions USING (store_id)"))
def c4(spark, sf):
    t = tx(spark, sf)
    return tidy(P.add_region(P.derive_prices(t), t).select(*P.CELL, "region"))


@register("d3_fallback_region_week", with_sql(f"{ALL_PRICES}, {_REGION}", "SELECT product_id, region, week, median(actual_price) AS region_actual, median(base_price) AS region_base FROM prices LEFT JOIN regions USING (store_id) GROUP BY ALL", "region_actual, region_base"))
def d3(spark, sf):
    t = tx(spark, sf)
    return tidy(P.fallback_region_week(P.add_region(P.derive_prices(t), t)))


@register("d4_fallback_product", with_sql(ALL_PRICES, "SELECT product_id, median(actual_price) AS product_actual, median(base_price) AS product_base FROM prices GROUP BY ALL", "product_actual, product_base"))
def d4(spark, sf):
    return tidy(P.fallback_product(P.derive_prices(tx(spark, sf))))


def _cells_wanted(t):
    """Every product of a store in every week of that store in which it sold anything."""
    priced = P._keyed(P.unit_prices(t))
    return priced.select("product_id", "store_id").distinct().join(priced.select("store_id", "week").distinct(), "store_id").select(*P.CELL)


_WANTED = """wanted AS (
  SELECT a.product_id, a.store_id, b.week FROM (SELECT DISTINCT PROD_CODE AS product_id, STORE_CODE AS store_id FROM priced) a
  JOIN (SELECT DISTINCT STORE_CODE AS store_id, SHOP_WEEK AS week FROM priced) b USING (store_id))"""


@register(
    "p1_waterfall",
    with_sql(
        f"{ALL_PRICES}, {_REGION}, {_WANTED}, ps AS (SELECT product_id, store_id, median(actual_price) AS m FROM prices GROUP BY ALL), "
        "prw AS (SELECT product_id, region, week, median(actual_price) AS m FROM prices JOIN regions USING (store_id) GROUP BY ALL), pp AS (SELECT product_id, median(actual_price) AS m FROM prices GROUP BY ALL)",
        "SELECT w.product_id, w.store_id, w.week, coalesce(p.actual_price, ps.m, prw.m, pp.m) AS price, CASE WHEN p.actual_price IS NOT NULL THEN 'observed' WHEN ps.m IS NOT NULL THEN 'product_store' "
        "WHEN prw.m IS NOT NULL THEN 'region_week' WHEN pp.m IS NOT NULL THEN 'product' END AS imputation_method FROM wanted w JOIN regions USING (store_id) LEFT JOIN prices p USING (product_id, store_id, week) "
        "LEFT JOIN ps USING (product_id, store_id) LEFT JOIN prw ON prw.product_id = w.product_id AND prw.region = regions.region AND prw.week = w.week LEFT JOIN pp ON pp.product_id = w.product_id",
        "price",
    ),
)
def p1(spark, sf):
    t = tx(spark, sf)
    return tidy(P.apply_waterfall(P.derive_prices(t), _cells_wanted(t), t))


@register(
    "p2_forward_fill",
    with_sql(
        f"{ALL_PRICES}, {_WANTED}, places AS (SELECT STORE_CODE AS store_id, min(STORE_FORMAT) AS format, min(STORE_REGION) AS region FROM tx GROUP BY ALL), "
        "near AS (SELECT product_id, format, region, week, median(actual_price) AS m FROM prices JOIN places USING (store_id) GROUP BY ALL), ev AS (SELECT product_id, week, median(actual_price) AS m FROM prices GROUP BY ALL), "
        "found AS (SELECT w.product_id, w.store_id, w.week, coalesce(p.actual_price, near.m, ev.m) AS f FROM wanted w JOIN places USING (store_id) LEFT JOIN prices p USING (product_id, store_id, week) "
        "LEFT JOIN near ON near.product_id = w.product_id AND near.format = places.format AND near.region = places.region AND near.week = w.week LEFT JOIN ev ON ev.product_id = w.product_id AND ev.week = w.week)",
        "SELECT product_id, store_id, week, last_value(f IGNORE NULLS) OVER (PARTITION BY product_id, store_id ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM found",
        "price",
    ),
)
def p2(spark, sf):
    t = tx(spark, sf)
    return tidy(P.forward_filled(P.derive_prices(t), _cells_wanted(t), t))


@register("p3_discount_bins", with_sql(ALL_PRICES, "SELECT discount_bin, count(*) AS n FROM (SELECT CASE WHEN discount_depth <= 0.05 THEN 'none' WHEN discount_depth <= 0.15 THEN 'shallow' WHEN discount_depth <= 0.30 THEN 'medium' ELSE 'deep' END AS discount_bin FROM prices) GROUP BY ALL"))
def p3(spark, sf):
    return tidy(P.discount_bins(P.derive_prices(tx(spark, sf))).groupBy("discount_bin").agg(F.count("*").alias("n")))


@register("p4_outlier_filter", with_sql(ALL_PRICES + ", b AS (SELECT product_id, quantile_cont(actual_price, 0.05) AS lo, quantile_cont(actual_price, 0.95) AS hi FROM prices GROUP BY ALL)", f"SELECT {_cells}, actual_price FROM prices JOIN b USING (product_id) WHERE actual_price >= lo - 1.5 * (hi - lo) AND actual_price <= hi + 1.5 * (hi - lo)", "actual_price"))
def p4(spark, sf):
    return tidy(P.outlier_filter(P.derive_prices(tx(spark, sf))).select(*P.CELL, "actual_price"))


@register("p5_series_checks", with_sql(ALL_PRICES + ", o AS (SELECT *, lag(actual_price) OVER (PARTITION BY product_id, store_id ORDER BY week) AS before FROM prices)", "SELECT product_id, store_id, count(*) AS weeks_observed, CAST(count(*) FILTER (WHERE actual_price > before) AS BIGINT) AS rises, CAST(count(*) FILTER (WHERE actual_price < before) AS BIGINT) AS falls, 1 - count(*) / 349 AS missing_share, 1 - count(*) / 349 > 0.3 AS too_sparse FROM o GROUP BY ALL", "missing_share"))
def p5(spark, sf):
    return tidy(P.series_checks(P.derive_prices(tx(spark, sf)), 349))


@register("p5_cross_store", with_sql(ALL_PRICES, "SELECT product_id, week, count(*) AS stores, max(actual_price) / min(actual_price) AS price_ratio FROM prices GROUP BY ALL", "price_ratio"))
def p5_stores(spark, sf):
    return tidy(P.cross_store_check(P.derive_prices(tx(spark, sf))))


@register("p8_zero_prices", with_sql(f"{TX}, {UNIT}, m AS (SELECT PROD_CODE_10, SHOP_WEEK, median(unit_price) AS category_price FROM unit WHERE unit_price > 0 GROUP BY ALL)", "SELECT BASKET_ID, LINE_SEQ, CASE WHEN unit_price <= 0 THEN category_price ELSE unit_price END AS unit_price, unit_price <= 0 AS was_zero FROM unit LEFT JOIN m USING (PROD_CODE_10, SHOP_WEEK)", "unit_price"))
def p8(spark, sf):
    return tidy(P.replace_zero_prices(tx(spark, sf)))
