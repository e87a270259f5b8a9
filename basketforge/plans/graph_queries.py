"""Queries over the product graph and pseudo-brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketforge.functions.columns import tidy
from basketforge.operators import brands as B
from basketforge.operators import graph as G
from basketforge.operators import pricing as P
from basketforge.plans.registry import register
from basketforge.plans.shared_sql import ALL_PRICES, TX, with_sql
from basketforge.session import once
from basketforge.sources.transactions import transactions as tx

#: The given tables share few customers between products: thresholds at which edges exist.
JACCARD, GAP, STRONG = 0.10, 0.5, 0.05

_DIM = """dim AS (SELECT PROD_CODE AS product_id, min(PROD_CODE_10) AS PROD_CODE_10, min(PROD_CODE_20) AS PROD_CODE_20, min(PROD_CODE_30) AS PROD_CODE_30, min(PROD_CODE_40) AS PROD_CODE_40, sum(QUANTITY) AS total_quantity, sum(SPEND) AS total_spend FROM tx GROUP BY ALL)"""
_CAPPED_PAIRS = """bp0 AS (SELECT DISTINCT BASKET_ID, PROD_CODE AS p FROM tx), bp AS (SELECT BASKET_ID, p FROM (SELECT *, row_number() OVER (PARTITION BY BASKET_ID ORDER BY p) AS r FROM bp0) WHERE r <= 50),
pairs AS (SELECT a.p AS product_a, b.p AS product_b, count(*) AS pair_count FROM bp a JOIN bp b ON a.BASKET_ID = b.BASKET_ID AND a.p < b.p GROUP BY ALL)"""
_PAIRS = """bp0 AS (SELECT DISTINCT BASKET_ID, PROD_CODE AS p FROM tx),
pairs AS (SELECT a.p AS product_a, b.p AS product_b, count(*) AS pair_count FROM bp0 a JOIN bp0 b ON a.BASKET_ID = b.BASKET_ID AND a.p < b.p GROUP BY ALL)"""
_LIFT = """singles AS (SELECT p, count(*) AS n FROM bp0 GROUP BY ALL), tot AS (SELECT count(DISTINCT BASKET_ID) AS t FROM tx),
lifts AS (SELECT product_a, product_b, pair_count, (pair_count / t) / ((x.n / t) * (y.n / t)) AS lift FROM pairs JOIN singles x ON x.p = product_a JOIN singles y ON y.p = product_b, tot WHERE pair_count >= 5)"""
_CO = """co0 AS (SELECT product_a AS src, product_b AS dst, lift AS weight, pair_count FROM lifts WHERE lift >= 1.5),
ends AS (SELECT src AS node, * FROM co0 UNION ALL SELECT dst, * FROM co0), ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, src, dst) AS r FROM ends),
co AS (SELECT src, dst, any_value(weight) AS weight, any_value(pair_count) AS pair_count FROM ranked WHERE r <= 10 GROUP BY src, dst HAVING count(*) = 2)"""
_CAPPED_CAT = """prods AS (SELECT * FROM (SELECT product_id, PROD_CODE_10 AS category, total_spend / greatest(total_quantity, 1.0::DOUBLE) AS price, row_number() OVER (PARTITION BY PROD_CODE_10 ORDER BY product_id) AS r FROM dim WHERE PROD_CODE_10 IS NOT NULL) WHERE r <= 100),
buyers AS (SELECT DISTINCT PROD_CODE AS product_id, CUST_CODE AS c FROM tx WHERE CUST_CODE IS NOT NULL), nb AS (SELECT product_id, count(*) AS n FROM buyers GROUP BY ALL),
cat0 AS (SELECT a.product_id AS product_a, b.product_id AS product_b, a.category, a.price AS price_a, b.price AS price_b,
  (SELECT count(*) FROM buyers x JOIN buyers y USING (c) WHERE x.product_id = a.product_id AND y.product_id = b.product_id) AS shared,
  coalesce(na.n, 0) AS customers_a, coalesce(nbb.n, 0) AS customers_b
  FROM prods a JOIN prods b ON a.category = b.category AND a.product_id < b.product_id LEFT JOIN nb na ON na.product_id = a.product_id LEFT JOIN nb nbb ON nbb.product_id = b.product_id),
cat AS (SELECT *, coalesce(shared / nullif(customers_a + customers_b - shared, 0), 0.0) AS jaccard, CASE WHEN price_a > 0 AND price_b > 0 THEN abs(price_a - price_b) / ((price_a + price_b) / 2) END AS price_gap FROM cat0)"""
_CAT = _CAPPED_CAT.replace("""SELECT * FROM (SELECT product_id, PROD_CODE_10 AS category, total_spend / greatest(total_quantity, 1.0::DOUBLE) AS price, row_number() OVER (PARTITION BY PROD_CODE_10 ORDER BY product_id) AS r FROM dim WHERE PROD_CODE_10 IS NOT NULL) WHERE r <= 100""", "SELECT product_id, PROD_CODE_10 AS category, total_spend / greatest(total_quantity, 1.0::DOUBLE) AS price FROM dim WHERE PROD_CODE_10 IS NOT NULL")
_SUB = f"""sub AS (SELECT product_a AS src, product_b AS dst, jaccard * (1 - least(coalesce(lift, 0.5), 1.0)) AS weight, jaccard, coalesce(lift, 0.5) AS lift, price_gap FROM cat LEFT JOIN lifts USING (product_a, product_b)
  WHERE customers_a >= 5 AND customers_b >= 5 AND jaccard >= {JACCARD}::DOUBLE AND coalesce(lift, 0.5) <= 1.2 AND price_gap <= {GAP}::DOUBLE)"""
_HIER = """hier AS (SELECT DISTINCT * FROM (SELECT product_id AS src, PROD_CODE_10 AS dst, 1.0::DOUBLE AS weight, 1::BIGINT AS hierarchy_distance FROM dim UNION ALL SELECT PROD_CODE_10, PROD_CODE_20, 0.5, 2 FROM dim UNION ALL SELECT PROD_CODE_20, PROD_CODE_30, 0.25, 3 FROM dim UNION ALL SELECT PROD_CODE_30, PROD_CODE_40, 0.125, 4 FROM dim))"""
_EDGES = "edges AS (SELECT src, dst, 'copurchase' AS edge_type, weight FROM co UNION ALL SELECT src, dst, 'substitution', weight FROM sub UNION ALL SELECT src, dst, 'hierarchy', weight FROM hier)"
_NODES = "nodes AS (SELECT node_id, min(l)::BIGINT AS hierarchy_level FROM (SELECT product_id AS node_id, 0 AS l FROM dim UNION ALL SELECT PROD_CODE_10, 1 FROM dim UNION ALL SELECT PROD_CODE_20, 2 FROM dim UNION ALL SELECT PROD_CODE_30, 3 FROM dim UNION ALL SELECT PROD_CODE_40, 4 FROM dim) WHERE node_id IS NOT NULL GROUP BY ALL)"
LIFTS = f"{TX}, {_DIM}, {_PAIRS}, {_LIFT}"
SUBSTITUTION = f"{LIFTS}, {_CAT}, {_SUB}"
GRAPH = f"{SUBSTITUTION}, {_CO}, {_HIER}, {_NODES}, {_EDGES}"
#: The same of the first 50 products of a basket and 100 of a category, for the queries that ask for no more.
CAPPED_LIFTS = f"{TX}, {_DIM}, {_CAPPED_PAIRS}, {_LIFT}"
CAPPED_SUBSTITUTION = f"{CAPPED_LIFTS}, {_CAPPED_CAT}, {_SUB}"
CAPPED_GRAPH = f"{CAPPED_SUBSTITUTION}, {_CO}, {_HIER}, {_NODES}, {_EDGES}"
CAPS = (G.BASKET_CAP, G.CATEGORY_CAP)


def _sub(spark, sf):
    return G.substitution_edges(tx(spark, sf), JACCARD, gap=GAP)


@register("d6_product_dim", with_sql(f"{TX}, {_DIM}", "SELECT *, concat_ws('/', PROD_CODE_40, PROD_CODE_30, PROD_CODE_20, PROD_CODE_10) AS category_path FROM dim", "total_quantity, total_spend", 4))
def d6(spark, sf):
    return tidy(G.product_dim(tx(spark, sf)), 4)


@register("c8_basket_pairs", with_sql(f"{TX}, {_CAPPED_PAIRS}", "SELECT * FROM pairs"))
def c8(spark, sf):
    return tidy(G.basket_pairs(tx(spark, sf), G.BASKET_CAP))


@register("c9_category_pairs", with_sql(f"{TX}, {_DIM}, {_CAPPED_CAT}", "SELECT product_a, product_b, shared, customers_a, customers_b, jaccard, price_gap FROM cat", "jaccard, price_gap"))
def c9(spark, sf):
    return tidy(G.category_pairs(tx(spark, sf), G.CATEGORY_CAP).select("product_a", "product_b", "shared", "customers_a", "customers_b", "jaccard", "price_gap"))


@register("i1_graph_nodes", with_sql(f"{TX}, {_DIM}, {_NODES}", "SELECT *, CASE WHEN hierarchy_level = 0 THEN 'product' ELSE 'category' END AS node_type FROM nodes"))
def i1(spark, sf):
    return tidy(G.graph_nodes(tx(spark, sf)))


@register("i2_pair_lifts", with_sql(CAPPED_LIFTS, "SELECT * FROM lifts", "lift"))
def i2_lifts(spark, sf):
    return tidy(G.pair_lifts(tx(spark, sf), cap=G.BASKET_CAP))


@register("i2_copurchase_edges", with_sql(f"{CAPPED_LIFTS}, {_CO}", "SELECT * FROM co", "weight"))
def i2(spark, sf):
    t = tx(spark, sf)
    return tidy(G.copurchase_edges(t, lifts=G.pair_lifts(t, cap=G.BASKET_CAP)))


@register("f2_prune_topk", with_sql(f"{LIFTS}, {_CO}", "SELECT n, count(*) AS nodes FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM co UNION ALL SELECT dst FROM co) GROUP BY ALL) GROUP BY ALL"))
def f2(spark, sf):
    kept = G.copurchase_edges(tx(spark, sf))
    degrees = kept.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    return tidy(degrees.groupBy("n").agg(F.count("*").alias("nodes")))


@register("f3_capped_baskets", with_sql(f"{TX}, b AS (SELECT DISTINCT BASKET_ID, PROD_CODE AS product_id FROM tx)", "SELECT BASKET_ID, product_id FROM (SELECT *, row_number() OVER (PARTITION BY BASKET_ID ORDER BY product_id) AS r FROM b) WHERE r <= 3"))
def f3(spark, sf):
    return tidy(G.capped_baskets(tx(spark, sf), 3))


@register("i3_substitution_edges", with_sql(SUBSTITUTION, "SELECT * FROM sub", "weight, jaccard, lift, price_gap"))
def i3(spark, sf):
    return tidy(_sub(spark, sf))


@register("i4_hierarchy_edges", with_sql(f"{TX}, {_DIM}, {_HIER}", "SELECT * FROM hier"))
def i4(spark, sf):
    return tidy(G.hierarchy_edges(tx(spark, sf)))


@register("i5_build_graph", with_sql(CAPPED_GRAPH, "SELECT * FROM edges", "weight"), shared=True)
def i5(spark, sf):
    return tidy(G.build_graph(tx(spark, sf), JACCARD, GAP, CAPS))


@register("i5_edge_type_counts", with_sql(GRAPH, "SELECT edge_type, count(*) AS n FROM edges GROUP BY ALL"))
def i5_counts(spark, sf):
    return tidy(G.build_graph(tx(spark, sf), JACCARD, GAP).groupBy("edge_type").agg(F.count("*").alias("n")))


@register("i6_adjacency", with_sql(GRAPH, "SELECT node, edge_type, count(*) AS degree, string_agg(nb, ',' ORDER BY nb) AS neighbours FROM (SELECT src AS node, dst AS nb, edge_type FROM edges UNION ALL SELECT dst, src, edge_type FROM edges) GROUP BY ALL"))
def i6(spark, sf):
    adj = G.adjacency(G.build_graph(tx(spark, sf), JACCARD, GAP))
    return tidy(adj.select("node", "edge_type", F.size("neighbours").alias("degree"), F.array_join("neighbours.neighbour", ",").alias("neighbours")))


_REACH = f"""strong AS (SELECT src, dst FROM sub WHERE weight >= {STRONG}::DOUBLE), both_ways AS (SELECT src AS a, dst AS b FROM strong UNION SELECT dst, src FROM strong),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
comp AS (SELECT a AS product_id, least(a, min(b)) AS component FROM reach GROUP BY a),
withc AS (SELECT product_id, PROD_CODE_10 AS sub_commodity, coalesce(component, '') AS component FROM dim LEFT JOIN comp USING (product_id)),
clusters AS (SELECT product_id, sub_commodity, CASE WHEN (SELECT count(*) FROM strong) = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY sub_commodity ORDER BY least) - 1 END AS substitution_cluster
  FROM (SELECT *, min(product_id) OVER (PARTITION BY sub_commodity, component) AS least FROM withc))"""


def _clusters(spark, sf):
    t = tx(spark, sf)
    return G.substitution_clusters(G.product_dim(t).select("product_id", F.col("PROD_CODE_10").alias("sub_commodity")), _sub(spark, sf), STRONG)


@register("i7_substitution_clusters", with_sql(f"RECURSIVE {SUBSTITUTION}, {_REACH}", "SELECT product_id, sub_commodity, CAST(substitution_cluster AS BIGINT) AS substitution_cluster FROM clusters"))
def i7(spark, sf):
    return tidy(_clusters(spark, sf).select("product_id", "sub_commodity", "substitution_cluster"))


@register("i8_competitive_intensity", with_sql(SUBSTITUTION, "SELECT product_id, count(*) AS competitive_intensity FROM (SELECT src AS product_id FROM sub UNION ALL SELECT dst FROM sub) GROUP BY ALL"))
def i8(spark, sf):
    return tidy(G.competitive_intensity(_sub(spark, sf)))


@register(
    "i9_graph_metrics",
    with_sql(
        f"RECURSIVE {CAPPED_GRAPH}, bw AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), hop AS (SELECT node_id AS a, node_id AS root FROM nodes UNION SELECT bw.b, hop.root FROM hop JOIN bw ON hop.a = bw.a WHERE hop.root <= bw.b), "
        "lab AS (SELECT node_id, coalesce((SELECT min(root) FROM hop WHERE hop.a = node_id), node_id) AS c FROM nodes), sizes AS (SELECT c, count(*) AS s FROM lab GROUP BY ALL), "
        "deg AS (SELECT node_id, count(nd) AS d FROM nodes LEFT JOIN (SELECT src AS nd FROM edges UNION ALL SELECT dst FROM edges) ON nd = node_id GROUP BY ALL)",
        "SELECT *, 100.0 - CASE WHEN edges = 0 THEN 30.0 ELSE 0.0 END - CASE WHEN largest_share < 0.5 THEN 20.0 ELSE 0.0 END - CASE WHEN mean_degree < 2 THEN 10.0 ELSE 0.0 END AS score FROM ("
        "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE hierarchy_level = 0) AS product_nodes, (SELECT count(*) FROM nodes WHERE hierarchy_level > 0) AS category_nodes, "
        "(SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT edge_type) FROM edges) AS edge_types, "
        + "".join(f"(SELECT count(*) FROM edges WHERE edge_type = '{k}') AS {k}_edges, " for k in ("copurchase", "substitution", "hierarchy"))
        + "(SELECT count(*) FROM sizes) AS components, "
        "(SELECT max(s) FROM sizes) / (SELECT count(*) FROM nodes) AS largest_share, 2 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1)) AS density, "
        "(SELECT avg(d) FROM deg) AS mean_degree, (SELECT max(d) FROM deg) AS max_degree, (SELECT min(d) FROM deg) AS min_degree, (SELECT count(*) FROM deg WHERE d = 0) AS isolated)",
        "largest_share, density, mean_degree, score",
    ),
    shared=True,
)
def i9(spark, sf):
    t = tx(spark, sf)
    return tidy(G.graph_metrics(G.graph_nodes(t), graph(spark, sf, CAPS)))


_RULES = {"enough_customers": "customers_a >= 5 AND customers_b >= 5", "shared_customers": f"jaccard >= {JACCARD}::DOUBLE", "low_lift": "coalesce(lift, 0.5) <= 1.2", "priced": "coalesce(price_a > 0 AND price_b > 0, false)", "alike_prices": f"coalesce(price_gap <= {GAP}::DOUBLE, false)"}
_STEPS = ", ".join(
    f"count(*) FILTER (WHERE {' AND '.join(f'({r})' for r in list(_RULES.values())[: k + 1])}) AS {name}, count(*) FILTER (WHERE {' AND '.join([f'({r})' for r in list(_RULES.values())[:k]] + [f'NOT ({rule})'])}) AS not_{name}"
    for k, (name, rule) in enumerate(_RULES.items())
)


@register(
    "i10_substitution_funnel",
    with_sql(
        SUBSTITUTION,
        f"SELECT *, not_enough_customers > pairs * 0.5 AS lower_min_customers, not_shared_customers > enough_customers * 0.8 AS lower_jaccard, not_priced > shared_customers * 0.3 AS impute_prices, not_alike_prices > priced * 0.5 AS widen_price_gap "
        f"FROM (SELECT count(*) AS pairs, {_STEPS} FROM cat LEFT JOIN lifts USING (product_a, product_b))",
    ),
)
def i10(spark, sf):
    return tidy(G.substitution_funnel(tx(spark, sf), JACCARD, GAP))


_INFO = f"""stats AS (SELECT product_id, avg(actual_price) AS mean_price, median(actual_price) AS median_price, stddev_samp(actual_price) AS price_std, avg(base_price) AS base_price, avg(discount_depth) AS avg_discount, avg(promo_flag::INT) AS promo_frequency FROM prices GROUP BY ALL),
info AS (SELECT product_id, PROD_CODE_10 AS sub_commodity, PROD_CODE_20 AS commodity, PROD_CODE_30 AS sub_department, PROD_CODE_40 AS department, total_quantity, total_spend,
  coalesce(mean_price, total_spend / greatest(total_quantity, 1.0::DOUBLE)) AS mean_price, coalesce(median_price, total_spend / greatest(total_quantity, 1.0::DOUBLE)) AS median_price, coalesce(price_std, 0) AS price_std,
  coalesce(stats.base_price, total_spend / greatest(total_quantity, 1.0::DOUBLE)) AS base_price, coalesce(avg_discount, 0) AS avg_discount, coalesce(promo_frequency, 0) AS promo_frequency FROM dim LEFT JOIN stats USING (product_id))"""
_TIERS = """q AS (SELECT sub_commodity, count(*) AS n, quantile_cont(mean_price, 0.8) AS hi, quantile_cont(mean_price, 0.2) AS lo FROM info GROUP BY ALL),
tiers AS (SELECT info.*, CASE WHEN n < 3 THEN 'mid' WHEN mean_price >= hi THEN 'premium' WHEN mean_price <= lo THEN 'value' ELSE 'mid' END AS price_tier,
  (rank() OVER (PARTITION BY sub_commodity ORDER BY mean_price) + (count(*) OVER (PARTITION BY sub_commodity, mean_price) - 1) / 2) / count(*) OVER (PARTITION BY sub_commodity) AS category_price_percentile,
  least(2.0, greatest(0.0, price_std / greatest(mean_price, 0.01::DOUBLE))) AS price_cv FROM info JOIN q USING (sub_commodity))"""
INFO = f"{ALL_PRICES}, {_DIM}, {_INFO}"
TIERS = f"{INFO}, {_TIERS}"
_BRANDS = """named AS (SELECT t.*, substitution_cluster, sub_commodity || '_' || price_tier || '_' || substr(md5(sub_commodity || '_' || price_tier || '_' || substitution_cluster), 1, 8) AS pseudo_brand_id FROM tiers t JOIN clusters USING (product_id, sub_commodity)),
intens AS (SELECT product_id, count(*) AS competitive_intensity FROM (SELECT src AS product_id FROM sub UNION ALL SELECT dst FROM sub) GROUP BY ALL),
brands AS (SELECT product_id, sub_commodity, commodity, sub_department, department, pseudo_brand_id, dense_rank() OVER (ORDER BY pseudo_brand_id) - 1 AS pseudo_brand_idx, price_tier, category_price_percentile, price_cv,
  coalesce(competitive_intensity, 0) AS competitive_intensity, total_quantity / greatest(sum(total_quantity) OVER (PARTITION BY sub_commodity), 1.0::DOUBLE) AS market_share_proxy,
  mean_price / greatest(avg(mean_price) OVER (PARTITION BY sub_commodity), 0.01::DOUBLE) AS relative_price, count(*) OVER (PARTITION BY pseudo_brand_id) AS brand_size, mean_price, base_price, avg_discount, promo_frequency
  FROM named LEFT JOIN intens USING (product_id))"""
BRANDS = f"RECURSIVE {ALL_PRICES}, {_DIM}, {_PAIRS}, {_LIFT}, {_CAT}, {_SUB}, {_REACH}, {_INFO}, {_TIERS}, {_BRANDS}"
BRANDS_AND_EDGES = f"{BRANDS}, {_CO}, {_HIER}, {_NODES}, {_EDGES}"
CAPPED_BRANDS = f"RECURSIVE {ALL_PRICES}, {_DIM}, {_CAPPED_PAIRS}, {_LIFT}, {_CAPPED_CAT}, {_SUB}, {_REACH}, {_INFO}, {_TIERS}, {_BRANDS}"


def brands(spark, sf, caps=(None, None)):
    def substitutes():
        t = tx(spark, sf)
        return G.substitution_edges(t, JACCARD, gap=GAP, lifts=G.pair_lifts(t, cap=caps[0]), cap=caps[1])

    return once("brands", lambda: B.pseudo_brands(tx(spark, sf), prices(spark, sf), once("substitution", substitutes, sf, *caps), STRONG), sf, *caps)


def prices(spark, sf):
    return once("prices", lambda: P.derive_prices(tx(spark, sf)), sf)


def graph(spark, sf, caps=(None, None)):
    return once("graph", lambda: G.build_graph(tx(spark, sf), JACCARD, GAP, caps), sf, *caps)


def _info(spark, sf):
    t = tx(spark, sf)
    return B.product_info(t, P.derive_prices(t))


@register("d19_price_stats", with_sql(INFO, "SELECT * FROM stats", "mean_price, median_price, price_std, base_price, avg_discount, promo_frequency"))
def d19(spark, sf):
    return tidy(B.product_price_stats(P.derive_prices(tx(spark, sf))))


@register("c3_product_info", with_sql(INFO, "SELECT product_id, sub_commodity, mean_price, median_price, price_std, base_price, avg_discount, promo_frequency FROM info", "mean_price, median_price, price_std, base_price, avg_discount, promo_frequency"))
def c3(spark, sf):
    return tidy(_info(spark, sf).select("product_id", "sub_commodity", "mean_price", "median_price", "price_std", "base_price", "avg_discount", "promo_frequency"))


@register("e4_price_tiers", with_sql(TIERS, "SELECT product_id, price_tier FROM tiers"))
def e4(spark, sf):
    return tidy(B.price_tiers(_info(spark, sf)).select("product_id", "price_tier"))


@register("e5_price_rank", with_sql(TIERS, "SELECT product_id, category_price_percentile, price_cv FROM tiers", "category_price_percentile, price_cv"))
def e5(spark, sf):
    return tidy(B.price_rank(_info(spark, sf)).select("product_id", "category_price_percentile", "price_cv"))


@register("e6_brand_positioning", with_sql(CAPPED_BRANDS, "SELECT product_id, market_share_proxy, relative_price FROM brands", "market_share_proxy, relative_price"))
def e6(spark, sf):
    return tidy(B.brand_positioning(_info(spark, sf)).select("product_id", "market_share_proxy", "relative_price"))


@register("h10_pseudo_brand_ids", with_sql(BRANDS, "SELECT product_id, pseudo_brand_id FROM brands"))
def h10(spark, sf):
    return tidy(brands(spark, sf).select("product_id", "pseudo_brand_id"))


@register("d35_brand_size", with_sql(BRANDS, "SELECT pseudo_brand_id, count(*) AS brand_size FROM brands GROUP BY ALL"))
def d35(spark, sf):
    return tidy(brands(spark, sf).select("pseudo_brand_id", "brand_size").distinct())


@register("i11_pseudo_brands", with_sql(BRANDS, "SELECT * FROM brands", "category_price_percentile, price_cv, market_share_proxy, relative_price, mean_price, base_price, avg_discount, promo_frequency"), shared=True)
def i11(spark, sf):
    return tidy(brands(spark, sf))


@register("h11_names", with_sql(f"{TX}, {_DIM}", "SELECT product_id, concat_ws('/', PROD_CODE_40, PROD_CODE_30, PROD_CODE_20, PROD_CODE_10) AS path, substr(product_id, 1, 7) AS prefix FROM dim"))
def h11(spark, sf):
    return tidy(G.product_dim(tx(spark, sf)).select("product_id", F.col("category_path").alias("path"), F.substring("product_id", 1, 7).alias("prefix")))
