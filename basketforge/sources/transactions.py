"""The canonical transactions table, and its readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketforge.session import LEAST_TASKS, ROWS_A_TASK, dealt, once, staging_path, told_rows
from basketforge.sources.tables import table

#: Schema of transaction files; readers prune it to the columns asked for.
TRANSACTIONS = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("SHOP_WEEK", "SHOP_DATE", "SHOP_WEEKDAY", "SHOP_HOUR")]
    + [T.StructField(c, T.DoubleType()) for c in ("QUANTITY", "SPEND")]
    + [T.StructField(c, T.StringType()) for c in ("PROD_CODE", "PROD_CODE_10", "PROD_CODE_20", "PROD_CODE_30", "PROD_CODE_40", "CUST_CODE", "seg_1", "seg_2", "BASKET_ID", "BASKET_SIZE", "BASKET_PRICE_SENSITIVITY", "BASKET_TYPE", "BASKET_DOMINANT_MISSION", "STORE_CODE", "STORE_FORMAT", "STORE_REGION")]
)
CALENDAR = T.StructType([T.StructField("shop_week", T.IntegerType()), T.StructField("date_from", T.StringType()), T.StructField("date_to", T.StringType())])


def read_transactions(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Transaction CSV with a header, declared types, chosen columns; NaN becomes null."""
    df = spark.read.schema(TRANSACTIONS).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*(columns or df.columns)).replace(float("nan"), None)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar CSV: week and its first and last date."""
    df = spark.read.schema(CALENDAR).option("header", True).csv(path)
    return df.select("shop_week", *(F.to_date(c, "yyyyMMdd").alias(c) for c in ("date_from", "date_to")))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in each part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A stage table as Parquet, partitioned where asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, by: list[str], buckets: int = 8) -> DataFrame:
    """A stage table in buckets of ``by``, sorted within: joins and groups on ``by`` that read it need no exchange.

    Tables that are joined need the same number of buckets. The table is registered
    under a name of its own in the session's catalog; its files are in the shared folder.
    """
    spark, place = df.sparkSession, staging_path(df.sparkSession, name)
    table = f"basketforge_{name}_{place.rpartition('-')[2]}"
    df.write.format("parquet").option("path", place).bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    return spark.table(table)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode_lists(df: DataFrame, as_json: list[str] = (), as_text: list[str] = ()) -> DataFrame:
    """Array columns as JSON documents or comma-joined strings."""
    for c in as_json:
        df = df.withColumn(c, F.to_json(c))
    for c in as_text:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


def decode_lists(df: DataFrame, from_json: dict[str, str] | None = None, from_text: list[str] = ()) -> DataFrame:
    """The reverse of ``encode_lists``; an empty string is an empty array."""
    for c, kind in (from_json or {}).items():
        df = df.withColumn(c, F.from_json(c, kind))
    for c in from_text:
        df = df.withColumn(c, F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ",")))
    return df


#: Labels of the order columns that stand for basket attributes.
BASKET_TYPES = {"1-URGENT": "Emergency", "2-HIGH": "Small Shop", "3-MEDIUM": "Top Up", "4-NOT SPECIFIED": "Full Shop", "5-LOW": "Top Up"}
MISSIONS = {"O": "Fresh", "F": "Grocery", "P": "Mixed"}
FORMATS = {0: "LS", 1: "MS", 2: "SS"}
SENSITIVITY_TERCILES = (163_000, 335_000)


def _labels(column, labels: dict):
    out = F.lit(None).cast("string")
    for k, v in labels.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical transactions; written once in queries that read them several times."""
    return once("transactions", lambda: _transactions(spark, folder), folder)


def _transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Basket lines in the canonical schema, from lineitem, orders, part and customer.

    Lines and orders meet on the order key; the windows that number a basket's
    lines and count them use the same partitioning, so they add no shuffle.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    basket = Window.partitionBy("l_orderkey")
    nth = basket.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    # Products and customers are joined first, so that lines are dealt by basket last: in as many
    # tasks as the lines ask for, whatever the session's number of shuffle partitions.
    rows, parts, customers = lines.count(), part.count(), customer.count()
    if parts >= ROWS_A_TASK * LEAST_TASKS:
        lines, part = dealt(lines, rows, "l_partkey"), dealt(part, rows, "p_partkey")
    if customers >= ROWS_A_TASK * LEAST_TASKS:
        orders, customer = dealt(orders, rows, "o_custkey"), dealt(customer, rows, "c_custkey")
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    orders = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    df = dealt(lines, rows, "l_orderkey").join(dealt(orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.withColumn("LINE_SEQ", F.row_number().over(nth)).withColumn("nl", F.count("*").over(basket))
    bn = F.substring("p_brand", 7, 10).cast("int")
    st = ((F.col("o_custkey") + F.col("o_orderkey") % 3) % 25).cast("int")
    day = F.col("o_orderdate")
    total = F.col("o_totalprice")
    df = df.select(
        F.col("l_orderkey").alias("BASKET_ID"),
        "LINE_SEQ",
        F.when(F.col("o_custkey") % 20 != 0, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("CUST_CODE"),
        F.concat("p_brand", F.lit("|"), "p_type").alias("PROD_CODE"),
        F.col("p_brand").alias("PROD_CODE_10"),
        F.concat(F.lit("DEP"), (bn % 10).cast("string")).alias("PROD_CODE_20"),
        F.concat(F.lit("G"), (bn % 5).cast("string")).alias("PROD_CODE_30"),
        F.when(bn % 5 < 2, "D0").otherwise("D1").alias("PROD_CODE_40"),
        F.concat(F.lit("ST"), st.cast("string")).alias("STORE_CODE"),
        F.concat(F.lit("R"), (st % 5).cast("string")).alias("STORE_REGION"),
        _labels(st % 3, FORMATS).alias("STORE_FORMAT"),
        (F.year(day) * 100 + F.floor((F.dayofyear(day) - 1) / 7).cast("int") + 1).alias("SHOP_WEEK"),
        F.date_format(day, "yyyyMMdd").cast("int").alias("SHOP_DATE"),
        (F.weekday(day) + 1).alias("SHOP_WEEKDAY"),
        (8 + F.col("o_orderkey") % 14).cast("int").alias("SHOP_HOUR"),
        F.col("l_quantity").alias("QUANTITY"),
        (F.col("l_extendedprice") / 100).alias("SPEND"),
        _labels(F.col("o_orderpriority"), BASKET_TYPES).alias("BASKET_TYPE"),
        _labels(F.col("o_orderstatus"), MISSIONS).alias("BASKET_DOMINANT_MISSION"),
        F.when(total < SENSITIVITY_TERCILES[0], "LA").when(total < SENSITIVITY_TERCILES[1], "MM").otherwise("UM").alias("BASKET_PRICE_SENSITIVITY"),
        F.when(F.col("nl") <= 4, "S").when(F.col("nl") <= 6, "M").otherwise("L").alias("BASKET_SIZE"),
        F.substring("c_mktsegment", 1, 2).alias("seg_1"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("seg_2"),
    )
    return told_rows(df, rows)
