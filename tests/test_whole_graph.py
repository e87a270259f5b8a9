"""Graph queries answer for all products of a basket and of a category."""

import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F
from test_rules import lines

from basketforge.operators import graph as G
from basketforge.plans import all_queries, all_sql

TABLES = "region nation customer supplier part orders lineitem".split()
#: Queries that once left out products after the 50th of a basket or the 100th of a category.
WHOLE = [
    "i3_substitution_edges",
    "f2_prune_topk",
    "a3_embedding_stage",
    "a3_graph_stage",
    "d35_brand_size",
    "f4_sampled_neighbours",
    "h10_pseudo_brand_ids",
    "i10_substitution_funnel",
    "i11_pseudo_brands",
    "i5_edge_type_counts",
    "i6_adjacency",
    "i7_substitution_clusters",
    "i8_competitive_intensity",
    "j3_node_features",
    "j4_neighbour_hop",
    "m4_brand_report",
    "j5_product_embeddings",
    "j17_item_features",
    "k13_masked_samples",
    "m8_context_checks",
    "m9_quality_summary",
]
#: Those of them whose SQL is slow in the other engine: their graph and brands are those of the others.
SLOW = ["j5_product_embeddings", "j17_item_features", "k13_masked_samples", "m8_context_checks", "m9_quality_summary"]


def test_category_pairs_cover_all_products(spark):
    tx = lines(spark, [dict(BASKET_ID=k, PROD_CODE=f"P{k:03}", PROD_CODE_10="A", CUST_CODE="C1") for k in range(120)])
    pairs = G.category_pairs(tx)
    assert pairs.count() == 120 * 119 // 2
    assert pairs.where("shared = 1").count() == 120 * 119 // 2
    assert G.category_pairs(tx, G.CATEGORY_CAP).count() == 100 * 99 // 2


def test_basket_pairs_cover_all_products(spark):
    tx = lines(spark, [dict(BASKET_ID=b, LINE_SEQ=k, PROD_CODE=f"P{k:03}") for b in (1, 2) for k in range(70)])
    pairs = G.basket_pairs(tx)
    assert pairs.count() == 70 * 69 // 2
    assert pairs.where("pair_count = 2 and product_a < product_b").count() == 70 * 69 // 2
    assert G.basket_pairs(tx, G.BASKET_CAP).count() == 50 * 49 // 2


@pytest.fixture(scope="module")
def wide(spark, small, tmp_path_factory):
    """Tables with 150 products in one category, and with baskets of 75 products."""
    folder = str(tmp_path_factory.mktemp("wide"))
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet")
        if t == "part":
            df = df.withColumn("p_brand", F.when(F.col("p_partkey") <= 150, "Brand#11").otherwise("Brand#12")).withColumn("p_type", F.format_string("TYPE %03d", "p_partkey"))
        if t == "lineitem":
            order = spark.read.parquet(f"{small}/orders.parquet").orderBy("o_orderkey").limit(6).select("o_orderkey")
            many = df.limit(1).drop("l_orderkey", "l_partkey", "l_linenumber").crossJoin(order).crossJoin(spark.range(75).select(F.col("id").alias("k")))
            many = many.select("*", F.col("o_orderkey").alias("l_orderkey"), (F.col("k") * 2 + 1).alias("l_partkey"), (F.col("k") + 100).alias("l_linenumber"))
            df = df.union(many.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema)))
        df.write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", WHOLE)
def test_same_rows_without_caps(spark, wide, name):
    sql = all_sql()[name]
    assert "r <= 50)" not in sql and "r <= 100)" not in sql
    if name not in SLOW:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{wide}/{t}.parquet/*.parquet'")
        assert differences(spark, con, all_queries()[name], sql, wide) == ""
