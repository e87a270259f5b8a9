"""Customers and their stores: visits, loyalty, switching, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketforge.functions.columns import flag


def known_customers(tx: DataFrame) -> DataFrame:
    """Lines with a customer; the filter reaches the scan."""
    return tx.where("CUST_CODE is not null")


def customer_store_visits(tx: DataFrame) -> DataFrame:
    """Distinct baskets, spend, items, first and last week of each customer and store."""
    return known_customers(tx).groupBy(F.col("CUST_CODE").alias("customer_id"), F.col("STORE_CODE").alias("store_id")).agg(
        F.count_distinct("BASKET_ID").alias("visit_count"), F.sum("SPEND").alias("total_spend"), F.sum("QUANTITY").alias("total_items"), F.min("SHOP_WEEK").alias("first_visit_week"), F.max("SHOP_WEEK").alias("last_visit_week")
    )


def primary_store(visits: DataFrame) -> DataFrame:
    """Most visited store (ties: smallest code), its visits and share."""
    total, most = F.sum("visit_count"), F.max("visit_count")
    named = F.min_by("store_id", F.struct(-F.col("visit_count"), F.col("store_id")))
    return visits.groupBy("customer_id").agg(named.alias("primary_store"), most.alias("primary_store_visits"), (most / total).alias("primary_store_share"))


def loyalty_hhi(visits: DataFrame) -> DataFrame:
    """Sum of squared visit shares."""
    shares = visits.withColumn("share", F.col("visit_count") / F.sum("visit_count").over(Window.partitionBy("customer_id")))
    return shares.groupBy("customer_id").agg(F.sum(F.col("share") * F.col("share")).alias("loyalty_score"))


def switching_rate(tx: DataFrame, lookback: int = 4) -> DataFrame:
    """Share of a customer's weeks, after the first, with a store unseen in the last observed weeks."""
    weeks = known_customers(tx).groupBy(F.col("CUST_CODE").alias("customer_id"), F.col("SHOP_WEEK").alias("week")).agg(F.collect_set("STORE_CODE").alias("stores"))
    order = Window.partitionBy("customer_id").orderBy("week")
    before = F.flatten(F.collect_list("stores").over(order.rowsBetween(-lookback, -1)))
    novel = (F.row_number().over(order) > 1) & (F.size(F.array_except("stores", before)) > 0)
    n = F.count("*")
    switches = F.sum(F.when(F.col("novel"), 1).otherwise(0))
    total = F.when(n < 2, n).otherwise(n - 1)
    return weeks.withColumn("novel", novel).groupBy("customer_id").agg((switches / F.greatest(n - 1, F.lit(1))).alias("switching_rate"), switches.alias("switch_count"), total.alias("total_weeks"))


def region_diversity(tx: DataFrame) -> DataFrame:
    regions = F.sort_array(F.collect_set("STORE_REGION"))
    return known_customers(tx).groupBy(F.col("CUST_CODE").alias("customer_id")).agg(F.size(regions).alias("region_diversity"), regions.alias("regions_visited"))


def visit_concentration(visits: DataFrame, top: int = 3) -> DataFrame:
    """Share of visits to the most visited stores."""
    rank = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("visit_count"), "store_id"))
    return visits.withColumn("rank", rank).groupBy("customer_id").agg((F.sum(F.when(F.col("rank") <= top, F.col("visit_count"))) / F.sum("visit_count")).alias("visit_concentration"))


def tenure_spend(visits: DataFrame) -> DataFrame:
    """Stores visited, weeks from first to last visit (YYYYWW arithmetic), spend."""
    return visits.groupBy("customer_id").agg(F.count("*").alias("total_stores_visited"), (F.max("last_visit_week") - F.min("first_visit_week") + 1).alias("tenure_weeks"), F.sum("total_spend").alias("total_spend"))


def additional_affinity(visits: DataFrame) -> DataFrame:
    return tenure_spend(visits).join(visit_concentration(visits), "customer_id")


AFFINITY_COLUMNS = ["customer_id", "primary_store", "loyalty_score", "switching_rate", "region_diversity", "total_stores_visited", "visit_concentration", "primary_store_share", "tenure_weeks", "total_spend"]


def assemble_affinity(tx: DataFrame) -> DataFrame:
    """One row per customer; every side is keyed by customer, so the joins reuse one partitioning."""
    visits = customer_store_visits(tx)
    df = primary_store(visits).join(loyalty_hhi(visits), "customer_id", "left").join(switching_rate(tx), "customer_id", "left")
    df = df.join(region_diversity(tx), "customer_id", "left").join(additional_affinity(visits), "customer_id", "left")
    return fill_defaults(df, {"switching_rate": 0.0, "switch_count": 0, "region_diversity": 1, "loyalty_score": 1.0}).select(AFFINITY_COLUMNS)


def fill_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.fillna({k: v for k, v in defaults.items() if k in df.columns})


def loyal_flag(affinity: DataFrame, above: float = 0.8) -> DataFrame:
    return affinity.withColumn("is_loyal", flag(F.col("loyalty_score") > above))
