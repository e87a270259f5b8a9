"""Shopping missions of customers: what kind of trips they make, and how steadily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketforge.functions.columns import entropy, safe_name
from basketforge.operators.affinity import known_customers
from basketforge.session import dealt, rows_of, staged

#: Numbers of ordinal labels, and the labels of the given tables.
SENSITIVITY = {"LA": 0.0, "MM": 0.5, "UM": 1.0}
SIZES = {"S": 0.33, "M": 0.67, "L": 1.0}
MISSION_TYPES = ["Emergency", "Full Shop", "Small Shop", "Top Up"]
MISSION_FOCUSES = ["Fresh", "Grocery", "Mixed"]


def ordinal(column: str, values: dict[str, float]) -> Column:
    """The number of a label; unknown labels are null."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def customer_baskets(tx: DataFrame) -> DataFrame:
    """One row per customer and basket: first attributes, summed quantity and spend."""
    first = [F.min_by(c, "LINE_SEQ").alias(c) for c in ("BASKET_TYPE", "BASKET_DOMINANT_MISSION", "BASKET_PRICE_SENSITIVITY", "BASKET_SIZE", "SHOP_WEEK")]
    return known_customers(tx).groupBy("CUST_CODE", "BASKET_ID").agg(*first, F.sum("QUANTITY").alias("QUANTITY"), F.sum("SPEND").alias("SPEND"))


def min_trips(baskets: DataFrame, trips: int = 3) -> DataFrame:
    """Baskets of customers with at least so many."""
    n = F.count("*").over(Window.partitionBy("CUST_CODE"))
    return baskets.where("CUST_CODE is not null").withColumn("_n", n).where(F.col("_n") >= trips).drop("_n")


def distribution(baskets: DataFrame, column: str, labels: list[str], prefix: str, names: tuple[str, str, str]) -> DataFrame:
    """Shares of each label per customer, the largest (ties: first label), entropy and JSON."""
    dominant, spread, text = names
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"n_{k}") for k, v in enumerate(labels)]
    df = baskets.where(F.col(column).isNotNull()).groupBy(F.col("CUST_CODE").alias("customer_id")).agg(F.count("*").alias("n"), *counts)
    shares = [F.col(f"n_{k}") / F.col("n") for k in range(len(labels))]
    most = F.greatest(*(F.col(f"n_{k}") for k in range(len(labels))))
    top = F.lit(None).cast("string")
    for k in reversed(range(len(labels))):
        top = F.when(F.col(f"n_{k}") == most, labels[k]).otherwise(top)
    as_map = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*shares))
    return df.select("customer_id", top.alias(dominant), entropy(F.array(*shares)).alias(spread), F.to_json(as_map).alias(text), *(s.alias(prefix + safe_name(v)) for s, v in zip(shares, labels)))


def mission_type_dist(baskets: DataFrame) -> DataFrame:
    return distribution(baskets, "BASKET_TYPE", MISSION_TYPES, "p_mission_", ("dominant_mission_type", "mission_type_entropy", "mission_type_dist"))


def mission_focus_dist(baskets: DataFrame) -> DataFrame:
    return distribution(baskets, "BASKET_DOMINANT_MISSION", MISSION_FOCUSES, "p_focus_", ("dominant_focus", "focus_entropy", "mission_focus_dist"))


def price_sensitivity(baskets: DataFrame) -> DataFrame:
    """Mean and spread of the ordinal sensitivity, and the most frequent label (ties: smallest)."""
    df = baskets.withColumn("level", ordinal("BASKET_PRICE_SENSITIVITY", SENSITIVITY))
    return df.groupBy(F.col("CUST_CODE").alias("customer_id")).agg(
        F.avg("level").alias("mean_price_sensitivity"), F.coalesce(F.stddev_samp("level"), F.lit(0.0)).alias("sensitivity_volatility"), F.coalesce(F.mode("BASKET_PRICE_SENSITIVITY", True), F.lit("MM")).alias("typical_sensitivity")
    )


def basket_size_tendency(baskets: DataFrame) -> DataFrame:
    df = baskets.withColumn("size", ordinal("BASKET_SIZE", SIZES))
    share = [F.avg(F.when(F.col("BASKET_SIZE").isNotNull(), (F.col("BASKET_SIZE") == v).cast("double"))).alias(f"p_size_{v.lower()}") for v in ("S", "M", "L")]
    return df.groupBy(F.col("CUST_CODE").alias("customer_id")).agg(
        F.avg("size").alias("mean_basket_size"), F.coalesce(F.var_samp("size"), F.lit(0.0)).alias("basket_size_variance"), F.count_distinct("BASKET_ID").alias("total_trips"), F.avg("QUANTITY").alias("avg_items_per_trip"), F.avg("SPEND").alias("avg_spend_per_trip"), *share
    )


VARIABILITY = ["mission_type_entropy", "focus_entropy", "sensitivity_volatility", "basket_size_variance"]


def mission_consistency(patterns: DataFrame) -> DataFrame:
    """1 minus the mean of four variabilities, each over its largest value (a one-row broadcast)."""
    top = patterns.agg(*(F.max(c).alias(f"max_{c}") for c in VARIABILITY))
    parts = [F.col(c) / (F.col(f"max_{c}") + 1e-6) for c in VARIABILITY]
    score = 1 - (parts[0] + parts[1] + parts[2] + parts[3]) / 4
    return patterns.crossJoin(F.broadcast(top)).select(*patterns.columns, score.alias("mission_consistency"))


def assemble_missions(tx: DataFrame, trips: int = 2) -> DataFrame:
    """Mission patterns, one row per customer with at least ``trips`` baskets.

    Lines are dealt by customer once, and baskets written where they are: each pattern,
    and the largest variabilities, read them with a customer's baskets in one task.
    """
    lines = dealt(known_customers(tx), rows_of(tx), "CUST_CODE")
    baskets = staged(min_trips(customer_baskets(lines), trips), "customer-baskets")
    df = mission_type_dist(baskets).join(mission_focus_dist(baskets), "customer_id", "left").join(price_sensitivity(baskets), "customer_id", "left").join(basket_size_tendency(baskets), "customer_id", "left")
    return mission_consistency(df).fillna(dict.fromkeys(VARIABILITY, 0.0) | {"mission_consistency": 0.5})


def trip_stats(baskets: DataFrame) -> DataFrame:
    """Mission statistics straight from trips: population spread halved, entropies with a small constant."""
    eps = 1e-10
    per = baskets.groupBy(F.col("CUST_CODE").alias("customer_id"))
    levels = baskets.select("CUST_CODE", ordinal("BASKET_PRICE_SENSITIVITY", SENSITIVITY).alias("level"), ordinal("BASKET_SIZE", SIZES).alias("size"), "BASKET_TYPE", "BASKET_DOMINANT_MISSION")
    per = levels.groupBy(F.col("CUST_CODE").alias("customer_id"))
    shares = [F.avg((F.col("BASKET_TYPE") == v).cast("double")).alias(f"t{k}") for k, v in enumerate(MISSION_TYPES)]
    focuses = [F.avg((F.col("BASKET_DOMINANT_MISSION") == v).cast("double")).alias(f"f{k}") for k, v in enumerate(MISSION_FOCUSES)]
    df = per.agg(F.avg("level").alias("mean_sensitivity"), (F.stddev_pop("level") / 2).alias("sensitivity_spread"), F.avg("size").alias("mean_size"), (F.stddev_pop("size") / 2).alias("size_spread"), F.count("*").alias("trips"), *shares, *focuses)

    def spread(prefix: str, n: int) -> Column:
        out = F.lit(0.0)
        for k in range(n):
            p = F.col(f"{prefix}{k}")
            out = out - p * F.log(p + eps)
        return out

    h1, h2 = spread("t", len(MISSION_TYPES)), spread("f", len(MISSION_FOCUSES))
    return df.select("customer_id", "mean_sensitivity", "sensitivity_spread", "mean_size", "size_spread", "trips", h1.alias("type_entropy"), h2.alias("focus_entropy"), (1 / (1 + h1 + h2)).alias("consistency"))
