"""Time: week numbers, basket metadata, splits, histories and next-basket pairs without leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketforge.operators.states import SavedAggregate, first_by
from basketforge.session import dealt

#: Weeks of holidays, and season by month.
HOLIDAY_WEEKS = (1, 13, 14, 15, 26, 27, 28, 29, 30, 31, 32, 33, 47, 51, 52)
SEASONS = (("spring", (3, 4, 5)), ("summer", (6, 7, 8)), ("fall", (9, 10, 11)))


def week_index(tx: DataFrame) -> DataFrame:
    """Dense numbers of the weeks; ranked over the distinct weeks, not over the lines."""
    weeks = tx.select(F.col("SHOP_WEEK").alias("week_original")).distinct()
    return weeks.withColumn("week", F.row_number().over(Window.orderBy("week_original")))


def basket_metadata(tx: DataFrame) -> DataFrame:
    """One row per basket: customer, store, week (dense and original), time, products, spend."""
    first = [F.min_by(c, "LINE_SEQ").alias(a) for c, a in (("CUST_CODE", "customer_id"), ("STORE_CODE", "store_id"), ("SHOP_WEEK", "week_original"), ("SHOP_DATE", "shop_date"), ("SHOP_WEEKDAY", "shop_weekday"), ("SHOP_HOUR", "shop_hour"))]
    df = tx.groupBy(F.col("BASKET_ID").alias("basket_id")).agg(*first, F.count_distinct("PROD_CODE").alias("num_products"), F.sum("SPEND").alias("total_spend"), F.sum("QUANTITY").alias("total_quantity"))
    return df.join(F.broadcast(week_index(tx)), "week_original")


def assign_split(df: DataFrame, train_end: int = 80, val_end: int = 95) -> DataFrame:
    return df.withColumn("split", F.when(F.col("week") <= train_end, "train").when(F.col("week") <= val_end, "validation").otherwise("test"))


def history_bucket(df: DataFrame, edges: tuple[int, ...] = (0, 25, 50, 75, 100, 117)) -> DataFrame:
    """Weeks before, and their bucket: right-closed, the last one open-ended."""
    length = F.col("week") - 1
    bucket = F.lit(len(edges) - 1)
    for k in reversed(range(1, len(edges) - 1)):
        bucket = F.when(length <= edges[k], k).otherwise(bucket)
    return df.withColumn("history_length", length).withColumn("bucket", bucket)


def prior_baskets(meta: DataFrame, cold: int = 5) -> DataFrame:
    """Number of the customer's earlier baskets, and whether they are few; anonymous baskets have none."""
    nth = F.row_number().over(Window.partitionBy("customer_id").orderBy("week", "basket_id")) - 1
    known = meta.where("customer_id is not null").withColumn("prior_baskets", nth)
    nobody = meta.where("customer_id is null").withColumn("prior_baskets", F.lit(0))
    return known.union(nobody).withColumn("is_cold_start", F.col("prior_baskets") < cold)


def flag_novel(meta: DataFrame, tx: DataFrame, train_end: int) -> DataFrame:
    """Whether a basket holds a product that no training week has."""
    weeks = F.broadcast(week_index(tx))
    rows = tx.select(F.col("BASKET_ID").alias("basket_id"), F.col("PROD_CODE").alias("product_id"), F.col("SHOP_WEEK").alias("week_original")).join(weeks, "week_original")
    seen = rows.where(F.col("week") <= train_end).select("product_id").distinct()
    novel = rows.join(seen, "product_id", "left_anti").select("basket_id").distinct().withColumn("has_novel", F.lit(True))
    return meta.join(novel, "basket_id", "left").withColumn("has_novel", F.coalesce("has_novel", F.lit(False)))


def last_visit(meta: DataFrame) -> DataFrame:
    """Week of the customer's previous basket."""
    order = Window.partitionBy("customer_id").orderBy("week", "basket_id")
    return meta.where("customer_id is not null").withColumn("last_visit_week", F.lag("week_original").over(order))


def basket_products(tx: DataFrame, cap: int | None = None, distinct: bool = False) -> DataFrame:
    """Products of each basket in line order, or its distinct set in code order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("LINE_SEQ", "PROD_CODE"))), lambda x: x["PROD_CODE"])
    products = F.sort_array(F.collect_set("PROD_CODE")) if distinct else ordered
    df = tx.groupBy(F.col("BASKET_ID").alias("basket_id")).agg(products.alias("products"))
    return df.withColumn("products", F.slice("products", 1, cap)) if cap else df


def min_basket(baskets: DataFrame, least: int = 2) -> DataFrame:
    return baskets.where(F.size("products") >= least)


def basket_attributes(tx: DataFrame) -> DataFrame:
    return tx.groupBy(F.col("BASKET_ID").alias("basket_id")).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("LINE_SEQ"))).alias(c.lower()) for c in ("BASKET_TYPE", "BASKET_DOMINANT_MISSION", "BASKET_PRICE_SENSITIVITY", "BASKET_SIZE")))


def date_string(column: str) -> Column:
    """YYYYMMDD as an ISO date."""
    return F.date_format(F.to_date(F.col(column).cast("string"), "yyyyMMdd"), "yyyy-MM-dd")


def basket_time(tx: DataFrame) -> DataFrame:
    df = tx.groupBy(F.col("BASKET_ID").alias("basket_id")).agg(*(F.min_by(c, "LINE_SEQ").alias(c.lower()) for c in ("SHOP_DATE", "SHOP_WEEKDAY", "SHOP_HOUR")))
    return df.withColumn("shop_date", date_string("shop_date"))


def saved_basket_time(spark: SparkSession, path: str) -> SavedAggregate:
    """``basket_time`` as a saved aggregate: the first line of each basket over all chunks that hold some of its lines."""
    return SavedAggregate(spark, path, {"basket_id": "BASKET_ID"}, [first_by("first", ["LINE_SEQ"], ["SHOP_DATE", "SHOP_WEEKDAY", "SHOP_HOUR"])])


def split_report(meta: DataFrame) -> DataFrame:
    """Baskets, customers, cold starts, novel baskets and history of each split and bucket."""
    return meta.groupBy("split", "bucket").agg(
        F.count("*").alias("baskets"), F.count_distinct("customer_id").alias("customers"), F.avg(F.col("is_cold_start").cast("double")).alias("cold_share"), F.avg(F.col("has_novel").cast("double")).alias("novel_share"),
        F.avg("history_length").alias("mean_history"), F.median("history_length").alias("median_history"),
    )


def pair_report(pairs: DataFrame) -> DataFrame:
    """Samples, customers, mean history, basket sizes and week gap of each split of next-basket pairs."""
    return pairs.groupBy("split").agg(
        F.count("*").alias("samples"), F.count_distinct("customer_id").alias("customers"), F.avg("num_history_baskets").alias("mean_history"),
        F.avg(F.size("input_products")).alias("mean_input_size"), F.avg(F.size("target_products")).alias("mean_target_size"), F.avg("week_gap").alias("mean_week_gap"),
    )


def split_document(meta: DataFrame) -> DataFrame:
    """One row: the samples' metadata as a JSON document, by split: samples, customers, range of weeks, cold starts."""
    by_split = meta.groupBy("split").agg(
        F.count("*").alias("n_samples"), F.count_distinct("customer_id").alias("n_customers"), F.array(F.min("week"), F.max("week")).alias("week_range"),
        F.array(F.min("week_original"), F.max("week_original")).alias("week_original_range"), F.count_if("is_cold_start").alias("cold_start_count"),
    )
    entry = F.struct("split", F.struct("n_samples", "n_customers", "week_range", "week_original_range", "cold_start_count").alias("s"))
    whole = by_split.agg(F.sum("n_samples").alias("total_baskets"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("splits"))
    return whole.select(F.to_json(F.struct("total_baskets", "splits")).alias("document"))


def recent_trips(tx: DataFrame, trips: int = 20, products: int = 50, rows: int = 0) -> DataFrame:
    """The last trips of each customer, oldest first, with at most so many products each.

    Lines are dealt by customer into as many tasks as ``rows`` ask for; trips, and what
    is made of them for each customer, stay where their lines are.
    """
    known = dealt(tx.where("CUST_CODE is not null"), rows, "CUST_CODE")
    first = [F.min_by(c, "LINE_SEQ").alias(c) for c in ("SHOP_WEEK", "BASKET_TYPE", "BASKET_DOMINANT_MISSION", "BASKET_PRICE_SENSITIVITY", "BASKET_SIZE")]
    baskets = known.groupBy(F.col("CUST_CODE").alias("customer_id"), F.col("BASKET_ID").alias("basket_id")).agg(*first, F.slice(F.sort_array(F.collect_set("PROD_CODE")), 1, products).alias("products"))
    last = F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("SHOP_WEEK"), F.desc("basket_id")))
    return baskets.withColumn("recency", last).where(F.col("recency") <= trips)


def trip_attention(trips: DataFrame, score: Column | None = None) -> DataFrame:
    """Recency weights exp(-1..0) from oldest to newest trip, times exp(score), summing to 1."""
    per = Window.partitionBy("customer_id")
    n = F.count("*").over(per)
    step = F.when(n == 1, F.lit(-1.0)).otherwise(-(F.col("recency") - 1) / F.greatest(n - 1, F.lit(1)))
    weighed = trips.withColumn("raw", F.exp(step) * F.exp(score if score is not None else F.lit(0.0)))
    return weighed.withColumn("attention", F.col("raw") / F.sum("raw").over(per)).drop("raw")


def customer_histories(meta: DataFrame, baskets: DataFrame, past: int = 50, products: int = 30, rows: int = 0) -> DataFrame:
    """The baskets before each basket of a customer, oldest first, with products and weeks.

    Products (labels, or their numbers) are joined before the window, once for each basket, and cut to ``products``.
    Baskets are dealt by customer into as many tasks as ``rows`` ask for.
    """
    kind = baskets.schema["products"].dataType
    own = meta.where("customer_id is not null").select("customer_id", "basket_id", "week").join(baskets.withColumn("products", F.slice("products", 1, products)), "basket_id", "left")
    own = dealt(own, rows, "customer_id")
    before = Window.partitionBy("customer_id").orderBy("week", "basket_id").rowsBetween(-past, -1)
    history = F.collect_list(F.struct("basket_id", "week", F.coalesce("products", F.array().cast(kind)).alias("products"))).over(before)
    return own.select("customer_id", "basket_id", "week", history.alias("history"))


def next_basket_pairs(meta: DataFrame, baskets: DataFrame, least: int = 2, gap: int = 12, history: int = 1) -> DataFrame:
    """Each basket of a customer with the next, where the next is large and near enough."""
    order = Window.partitionBy("customer_id").orderBy("week", "shop_date", "basket_id")
    rows = meta.where("customer_id is not null").join(baskets, "basket_id", "left").withColumn("products", F.coalesce("products", F.array().cast("array<string>")))
    ahead = {"target_basket_id": "basket_id", "target_week": "week", "target_week_original": "week_original", "target_store_id": "store_id", "target_weekday": "shop_weekday", "target_hour": "shop_hour", "target_products": "products", "split": "split", "bucket": "bucket"}
    df = rows.select(
        "customer_id", F.col("basket_id").alias("input_basket_id"), F.col("week").alias("input_week"), F.col("week_original").alias("input_week_original"), F.col("store_id").alias("input_store_id"), F.col("products").alias("input_products"),
        (F.row_number().over(order) - 1).alias("num_history_baskets"), *(F.lead(c).over(order).alias(a) for a, c in ahead.items()),
    )
    df = df.where("target_basket_id is not null").withColumn("week_gap", F.col("target_week") - F.col("input_week"))
    df = df.withColumn("input_size", F.size("input_products")).withColumn("target_size", F.size("target_products"))
    return df.where((F.col("target_size") >= least) & (F.col("input_size") > 0) & (F.col("week_gap") <= gap) & (F.col("num_history_baskets") >= history))


def last_known(wanted: DataFrame, known: DataFrame, by: list[str], at: str, carried: list[str]) -> DataFrame:
    """As-of join: each distinct (``by``, ``at``) of ``wanted`` with the ``carried`` columns of the last row of ``known`` at or before it.

    Both streams are merged in order in one window. It holds the distinct places of a
    group, never its rows: a group asked for a million times is one row a place. Rows
    of ``known`` are one a place too. Without an earlier row the carried columns are null.
    """
    asked = wanted.select(*by, at).distinct().withColumn("_row", F.lit(None).cast(known.select(F.struct(*carried).alias("s")).schema["s"].dataType))
    both = known.select(*by, at, F.struct(*carried).alias("_row"), F.lit(0).alias("_side")).unionByName(asked.withColumn("_side", F.lit(1)))
    past = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(past)).where("_side = 1")
    return found.select(*by, at, *(F.col("_row").getField(c).alias(f"known_{c}") for c in carried))


def training_samples(histories: DataFrame, meta: DataFrame, tx: DataFrame, least: int = 2) -> DataFrame:
    """History, distinct target products and flags of each basket that is large enough."""
    targets = min_basket(basket_products(tx, distinct=True), least).withColumnRenamed("products", "target_products")
    context = meta.drop("customer_id", "week")
    return histories.join(context, "basket_id").join(targets, "basket_id").where(F.size("history") > 0)


def enhanced_samples(meta: DataFrame, tx: DataFrame) -> DataFrame:
    """Split tables with weekday, hour and date."""
    return meta.drop("shop_date", "shop_weekday", "shop_hour").join(basket_time(tx), "basket_id", "left")


def calendar_features(meta: DataFrame) -> DataFrame:
    """Week of year, month, season, holiday, weekday, hour, trend and recency of each basket."""
    week = F.least(F.greatest(F.col("week_original") % 100, F.lit(1)), F.lit(52))
    month = F.least(F.greatest(F.floor((F.col("week_original") % 100 - 1) / 4).cast("int") + 1, F.lit(1)), F.lit(12))
    season = F.lit("winter")
    for name, months in SEASONS:
        season = F.when(month.isin(*months), name).otherwise(season)
    bounds = meta.agg(F.min("week_original").alias("lo"), F.max("week_original").alias("hi"))
    trend = (F.col("week_original") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    order = Window.partitionBy("customer_id").orderBy("week", "basket_id")
    before = F.when(F.col("customer_id").isNotNull(), F.lag("week_original").over(order))
    df = meta.withColumn("last_week", before).crossJoin(F.broadcast(bounds))
    recency = F.coalesce(F.least((F.col("week_original") - F.col("last_week")) / 52, F.lit(1.0)), F.lit(0.5))
    return df.select(
        "basket_id", week.alias("week_of_year"), month.alias("month"), season.alias("season"), week.isin(*HOLIDAY_WEEKS).alias("is_holiday"), F.least("shop_weekday", F.lit(7)).alias("weekday"), F.least("shop_hour", F.lit(24)).alias("hour"),
        trend.alias("trend"), recency.alias("recency"),
    )


def cold_customers(meta: DataFrame, train_end: int) -> DataFrame:
    """Customers seen only after the training weeks."""
    known = meta.where("customer_id is not null")
    return known.select("customer_id").distinct().join(known.where(F.col("week") <= train_end).select("customer_id").distinct(), "customer_id", "left_anti")
