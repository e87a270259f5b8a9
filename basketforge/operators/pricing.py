"""Derived prices: unit prices, medians, base prices, promotions, checks and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketforge.functions.columns import flag
from basketforge.operators.quantiles import exact_quantiles

CELL = ["product_id", "store_id", "week"]
SERIES = ["product_id", "store_id"]


def unit_prices(tx: DataFrame, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """Lines with a positive quantity and a unit price strictly between the bounds."""
    return tx.where("QUANTITY > 0").withColumn("unit_price", F.col("SPEND") / F.col("QUANTITY")).where((F.col("unit_price") > low) & (F.col("unit_price") < high))


def _keyed(tx: DataFrame) -> DataFrame:
    return tx.withColumnsRenamed({"PROD_CODE": "product_id", "STORE_CODE": "store_id", "SHOP_WEEK": "week"})


def actual_prices(priced: DataFrame) -> DataFrame:
    """Median unit price, counts and spread of each product, store and week."""
    spread = F.coalesce(F.stddev_samp("unit_price"), F.lit(0.0))
    return _keyed(priced).groupBy(*CELL).agg(
        F.median("unit_price").alias("actual_price"), F.count("*").alias("transaction_count"), F.sum("QUANTITY").alias("total_quantity"), F.sum("SPEND").alias("total_spend"), spread.alias("price_std")
    )


def observed_cells(priced: DataFrame) -> DataFrame:
    """Product, store and week combinations with their number of lines."""
    return _keyed(priced).groupBy(*CELL).agg(F.count("*").alias("observations"))


def base_prices(prices: DataFrame, weeks: int = 4) -> DataFrame:
    """Highest price of the last observed weeks, never below the actual price."""
    recent = Window.partitionBy(*SERIES).orderBy("week").rowsBetween(1 - weeks, 0)
    return prices.withColumn("base_price", F.greatest("actual_price", F.max("actual_price").over(recent)))


def detect_promotions(prices: DataFrame, threshold: float = 0.05, cap: float = 0.7) -> DataFrame:
    """Discount depth between 0 and the cap, and whether it exceeds the threshold."""
    depth = F.greatest(F.lit(0.0), F.least(F.lit(cap), 1 - F.col("actual_price") / F.col("base_price")))
    return prices.withColumn("discount_depth", depth).withColumn("promo_flag", F.col("discount_depth") > threshold)


def validate_prices(prices: DataFrame, high: float = 100.0, cap: float = 0.7, volatile: float = 0.5) -> DataFrame:
    """Rule flags, joined by ``|``, and a quality score between 0 and 1."""
    series = Window.partitionBy(*SERIES)
    cv = F.stddev_samp("actual_price").over(series) / F.avg("actual_price").over(series)
    rules = (
        ("negative_price", F.col("actual_price") <= 0),
        ("price_too_high", F.col("actual_price") > high),
        ("excessive_discount", F.col("discount_depth") > cap),
        ("high_volatility", cv > volatile),
    )
    df = prices.withColumn("validation_flags", F.concat_ws("|", *(F.when(fails, F.lit(name)) for name, fails in rules)))
    if "imputation_method" not in df.columns:
        df = df.withColumn("imputation_method", F.lit("observed"))
    score = (
        F.lit(1.0)
        - 0.2 * flag(F.col("transaction_count") < 3)
        - 0.1 * F.least(F.lit(0.3), F.greatest(F.lit(0.0), F.col("price_std") / F.col("actual_price")))
        - 0.3 * flag(F.col("imputation_method") != "observed")
        - 0.2 * flag(F.col("validation_flags") != "")
    )
    return df.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


PRICE_COLUMNS = [*CELL, "actual_price", "base_price", "discount_depth", "promo_flag", "imputation_method", "quality_score", "validation_flags", "transaction_count", "total_quantity"]


def derive_prices(tx: DataFrame) -> DataFrame:
    """The price table: actual, base, promotion, checks. The rolling and the whole-series
    windows share one partitioning by product and store."""
    return validate_prices(detect_promotions(base_prices(actual_prices(unit_prices(tx)))))


def fallback_product_store(prices: DataFrame) -> DataFrame:
    """Medians of each series, which has no more rows than there are weeks."""
    return prices.groupBy(*SERIES).agg(F.median("actual_price").alias("store_actual"), F.median("base_price").alias("store_base"))


def add_region(prices: DataFrame, tx: DataFrame) -> DataFrame:
    """Region of each store: that of its first line in basket order."""
    regions = tx.groupBy(F.col("STORE_CODE").alias("store_id")).agg(F.min_by("STORE_REGION", F.struct("BASKET_ID", "LINE_SEQ")).alias("region"))
    return prices.join(regions, "store_id", "left")


def fallback_region_week(prices_with_region: DataFrame) -> DataFrame:
    return prices_with_region.groupBy("product_id", "region", "week").agg(F.median("actual_price").alias("region_actual"), F.median("base_price").alias("region_base"))


def fallback_product(prices: DataFrame) -> DataFrame:
    """Medians of each product over all its stores and weeks, by ranges: a product may hold a large share of all rows."""
    found = exact_quantiles(prices, ["product_id"], ["actual_price", "base_price"], {"median": 0.5})
    return found.select("product_id", F.col("actual_price_median").alias("product_actual"), F.col("base_price_median").alias("product_base"))


def apply_waterfall(prices: DataFrame, cells: DataFrame, tx: DataFrame) -> DataFrame:
    """Prices of wanted cells: observed, else product and store, else region and week, else product."""
    known = add_region(prices, tx)
    df = add_region(cells, tx).join(prices.select(*CELL, "actual_price"), CELL, "left")
    df = df.join(fallback_product_store(prices), SERIES, "left").join(fallback_region_week(known), ["product_id", "region", "week"], "left").join(fallback_product(prices), "product_id", "left")
    order = (("observed", "actual_price"), ("product_store", "store_actual"), ("region_week", "region_actual"), ("product", "product_actual"))
    method = F.lit(None).cast("string")
    for name, c in reversed(order):
        method = F.when(F.col(c).isNotNull(), name).otherwise(method)
    return df.select(*CELL, F.coalesce(*(c for _, c in order)).alias("price"), method.alias("imputation_method"))


def forward_filled(prices: DataFrame, cells: DataFrame, tx: DataFrame) -> DataFrame:
    """Cells priced by format and region of the week, then the week, then the last price of the series."""
    places = tx.groupBy(F.col("STORE_CODE").alias("store_id")).agg(*(F.min_by(c, F.struct("BASKET_ID", "LINE_SEQ")).alias(a) for c, a in (("STORE_FORMAT", "format"), ("STORE_REGION", "region"))))
    known = prices.join(places, "store_id")
    near = known.groupBy("product_id", "format", "region", "week").agg(F.median("actual_price").alias("near_price"))
    everywhere = known.groupBy("product_id", "week").agg(F.median("actual_price").alias("week_price"))
    df = cells.join(places, "store_id").join(prices.select(*CELL, "actual_price"), CELL, "left")
    df = df.join(near, ["product_id", "format", "region", "week"], "left").join(everywhere, ["product_id", "week"], "left")
    df = df.withColumn("found", F.coalesce("actual_price", "near_price", "week_price"))
    past = Window.partitionBy(*SERIES).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*CELL, F.last("found", ignorenulls=True).over(past).alias("price"))


def discount_bins(prices: DataFrame) -> DataFrame:
    """none, shallow, medium or deep, with bounds at 0.05, 0.15 and 0.30."""
    depth = F.col("discount_depth")
    return prices.withColumn("discount_bin", F.when(depth <= 0.05, "none").when(depth <= 0.15, "shallow").when(depth <= 0.30, "medium").otherwise("deep"))


def outlier_filter(prices: DataFrame, reach: float = 1.5) -> DataFrame:
    """Rows within the 5th to 95th percentile of their product, widened by ``reach`` ranges."""
    bounds = exact_quantiles(prices, ["product_id"], ["actual_price"], {"low": 0.05, "high": 0.95}).toDF("product_id", "low", "high")
    span = F.col("high") - F.col("low")
    return prices.join(bounds, "product_id").where((F.col("actual_price") >= F.col("low") - reach * span) & (F.col("actual_price") <= F.col("high") + reach * span)).drop("low", "high")


def series_checks(prices: DataFrame, weeks: int, missing: float = 0.3) -> DataFrame:
    """Per series: observed weeks, share missing and its flag, rises and falls of price."""
    order = Window.partitionBy(*SERIES).orderBy("week")
    df = prices.withColumn("before", F.lag("actual_price").over(order))
    out = df.groupBy(*SERIES).agg(F.count("*").alias("weeks_observed"), F.sum(F.when(F.col("actual_price") > F.col("before"), 1).otherwise(0)).alias("rises"), F.sum(F.when(F.col("actual_price") < F.col("before"), 1).otherwise(0)).alias("falls"))
    share = 1 - F.col("weeks_observed") / weeks
    return out.withColumn("missing_share", share).withColumn("too_sparse", share > missing)


def cross_store_check(prices: DataFrame) -> DataFrame:
    """Per product and week: stores, and the highest price over the lowest."""
    return prices.groupBy("product_id", "week").agg(F.count("*").alias("stores"), (F.max("actual_price") / F.min("actual_price")).alias("price_ratio"))


def replace_zero_prices(tx: DataFrame) -> DataFrame:
    """Unit price of each line; zero spend takes the median of its category and week, and is flagged."""
    df = tx.where("QUANTITY > 0").withColumn("unit_price", F.col("SPEND") / F.col("QUANTITY"))
    medians = df.where("unit_price > 0").groupBy("PROD_CODE_10", "SHOP_WEEK").agg(F.median("unit_price").alias("category_price"))
    zero = F.col("unit_price") <= 0
    return df.join(medians, ["PROD_CODE_10", "SHOP_WEEK"], "left").select("BASKET_ID", "LINE_SEQ", F.when(zero, F.col("category_price")).otherwise(F.col("unit_price")).alias("unit_price"), zero.alias("was_zero"))
