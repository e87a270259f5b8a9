"""Pseudo-brands: price tiers, ranks, substitution clusters and brand features of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketforge.operators.graph import LEVELS, competitive_intensity, product_dim, substitution_clusters
from basketforge.operators.quantiles import average_ranks, exact_quantiles
from basketforge.session import staged


def _category():
    return Window.partitionBy("sub_commodity")


def product_price_stats(prices: DataFrame) -> DataFrame:
    medians = exact_quantiles(prices, ["product_id"], ["actual_price"], {"median": 0.5}).toDF("product_id", "median_price")
    stats = prices.groupBy("product_id").agg(
        F.avg("actual_price").alias("mean_price"),
        F.stddev_samp("actual_price").alias("price_std"),
        F.avg("base_price").alias("base_price"),
        F.avg("discount_depth").alias("avg_discount"),
        F.avg(F.col("promo_flag").cast("double")).alias("promo_frequency"),
    )
    return stats.join(medians, "product_id", "left").select("product_id", "mean_price", "median_price", "price_std", "base_price", "avg_discount", "promo_frequency")


def product_info(tx: DataFrame, prices: DataFrame) -> DataFrame:
    """Hierarchy and prices of products; spend over quantity where no derived price exists."""
    names = dict(zip(LEVELS, ("sub_commodity", "commodity", "sub_department", "department")))
    own = F.col("total_spend") / F.greatest("total_quantity", F.lit(1.0))
    df = product_dim(tx).drop("category_path").withColumnsRenamed(names).join(product_price_stats(prices), "product_id", "left")
    for c in ("mean_price", "median_price", "base_price"):
        df = df.withColumn(c, F.coalesce(c, own))
    return df.fillna(0.0, ["price_std", "avg_discount", "promo_frequency"])


def price_tiers(products: DataFrame, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """premium, value or mid by percentiles of the category; small categories are mid.

    Products are written first: a mean that is computed twice may differ in its last
    bit, and a price that is itself a bound would miss it.
    """
    products = staged(products, "priced-products")
    bounds = products.groupBy("sub_commodity").agg(F.count("*").alias("n"), F.percentile("mean_price", high).alias("high"), F.percentile("mean_price", low).alias("low"))
    tier = F.when(F.col("n") < 3, "mid").when(F.col("mean_price") >= F.col("high"), "premium").when(F.col("mean_price") <= F.col("low"), "value").otherwise("mid")
    return products.join(bounds, "sub_commodity").withColumn("price_tier", tier).drop("n", "high", "low")


def price_rank(products: DataFrame) -> DataFrame:
    """Average rank of the price in its category as a share, and the price's coefficient of variation.

    Every product has a mean price; ranks come by ranges, so no task orders a category.
    Products are written first, since prices meet their ranks again by equality.
    """
    products = staged(products, "tiered-products")
    ranks = average_ranks(products, ["sub_commodity"], "mean_price").withColumnsRenamed({"sub_commodity": "_category", "mean_price": "_price"})
    cv = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("price_std") / F.greatest("mean_price", F.lit(0.01))))
    same = F.col("sub_commodity").eqNullSafe(F.col("_category")) & (F.col("mean_price") == F.col("_price"))
    return products.join(ranks, same, "left").withColumn("category_price_percentile", F.col("rank") / F.col("size")).withColumn("price_cv", cv).drop("_category", "_price", "rank", "size")


def brand_positioning(products: DataFrame) -> DataFrame:
    """Share of the category's quantity, and price over the category's mean price."""
    share = F.col("total_quantity") / F.greatest(F.sum("total_quantity").over(_category()), F.lit(1.0))
    price = F.col("mean_price") / F.greatest(F.avg("mean_price").over(_category()), F.lit(0.01))
    return products.withColumn("market_share_proxy", share).withColumn("relative_price", price)


def pseudo_brand_id(products: DataFrame) -> DataFrame:
    """Category, tier, and eight digits of the md5 of category, tier and cluster."""
    parts = F.concat_ws("_", "sub_commodity", "price_tier", F.col("substitution_cluster").cast("string"))
    return products.withColumn("pseudo_brand_id", F.concat_ws("_", "sub_commodity", "price_tier", F.substring(F.md5(parts), 1, 8)))


BRAND_COLUMNS = [
    "product_id", "sub_commodity", "commodity", "sub_department", "department", "pseudo_brand_id", "pseudo_brand_idx", "price_tier", "category_price_percentile", "price_cv",
    "competitive_intensity", "market_share_proxy", "relative_price", "brand_size", "mean_price", "base_price", "avg_discount", "promo_frequency",
]


def pseudo_brands(tx: DataFrame, prices: DataFrame, substitution: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The pseudo-brand table, one row per product."""
    products = price_rank(price_tiers(product_info(tx, prices)))
    clusters = substitution_clusters(products.select("product_id", "sub_commodity"), substitution, threshold).select("product_id", "substitution_cluster")
    df = pseudo_brand_id(products.join(clusters, "product_id")).join(competitive_intensity(substitution), "product_id", "left").fillna(0, ["competitive_intensity"])
    # Brands are few: their numbers are dealt on the distinct names, not on the products.
    ids = df.select("pseudo_brand_id").distinct().withColumn("pseudo_brand_idx", F.row_number().over(Window.orderBy("pseudo_brand_id")) - 1)
    df = brand_positioning(df).withColumn("brand_size", F.count("*").over(Window.partitionBy("pseudo_brand_id"))).join(ids, "pseudo_brand_id")
    return df.select(BRAND_COLUMNS)
