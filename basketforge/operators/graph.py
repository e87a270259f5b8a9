"""Product graph as node and edge tables: co-purchase, substitution and hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketforge.functions.columns import category_path
from basketforge.operators.affinity import known_customers
from basketforge.session import dealt, rows_of, staged

LEVELS = ["PROD_CODE_10", "PROD_CODE_20", "PROD_CODE_30", "PROD_CODE_40"]
#: Weights of hierarchy edges by level.
HIERARCHY_WEIGHTS = (1.0, 0.5, 0.25, 0.125)


def product_dim(tx: DataFrame) -> DataFrame:
    """First hierarchy codes, quantity and spend of each product, and its path of categories."""
    place = F.struct("BASKET_ID", "LINE_SEQ")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in LEVELS]
    df = tx.groupBy(F.col("PROD_CODE").alias("product_id")).agg(*first, F.sum("QUANTITY").alias("total_quantity"), F.sum("SPEND").alias("total_spend"))
    return df.withColumn("category_path", category_path(*reversed(LEVELS)))


def graph_nodes(tx: DataFrame) -> DataFrame:
    """Products (level 0) and categories; a code seen at several levels keeps the lowest."""
    products = product_dim(tx)
    pairs = F.explode(F.array(*(F.struct(F.col(c).alias("node_id"), F.lit(k + 1).alias("hierarchy_level")) for k, c in enumerate(LEVELS)))).alias("n")
    categories = products.select(pairs).select("n.*").where("node_id is not null")
    everything = products.select(F.col("product_id").alias("node_id"), F.lit(0).alias("hierarchy_level")).union(categories)
    out = everything.groupBy("node_id").agg(F.min("hierarchy_level").alias("hierarchy_level"))
    return out.withColumn("node_type", F.when(F.col("hierarchy_level") == 0, "product").otherwise("category"))


#: Caps of queries whose SQL has them: products of a basket, and of a category. Operators take all unless they are told a cap.
BASKET_CAP, CATEGORY_CAP = 50, 100


def capped_baskets(tx: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct products of each basket: all, or the first ``cap`` by code."""
    pairs = tx.select("BASKET_ID", F.col("PROD_CODE").alias("product_id")).distinct()
    if cap is None:
        return pairs
    rank = F.row_number().over(Window.partitionBy("BASKET_ID").orderBy("product_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def listed_pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """product_a < product_b of each group of distinct ``product_id``, from one list a group.

    A group's pairs are made one product at a time: a task holds a list of products, never all pairs of a group.
    """
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list("product_id")).alias("p")).where(F.size("p") > 1)
    firsts = lists.select("p", F.posexplode("p").alias("k", "product_a"))
    return firsts.select("product_a", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("product_b"))


def basket_pairs(tx: DataFrame, cap: int | None = None) -> DataFrame:
    """Unordered product pairs bought together, with the number of baskets."""
    rows = capped_baskets(tx, cap).where("BASKET_ID is not null")
    return listed_pairs(rows, ["BASKET_ID"]).groupBy("product_a", "product_b").agg(F.count("*").alias("pair_count"))


def pair_lifts(tx: DataFrame, min_count: int = 5, cap: int | None = None) -> DataFrame:
    """Lift of every pair with enough baskets: n_ab N / (n_a n_b)."""
    pairs = tx.select("BASKET_ID", F.col("PROD_CODE").alias("product_id")).distinct()
    singles = pairs.groupBy("product_id").agg(F.count("*").alias("n"))
    total = tx.agg(F.count_distinct("BASKET_ID").alias("baskets"))
    df = basket_pairs(tx, cap).where(F.col("pair_count") >= min_count)
    df = df.join(singles.toDF("product_a", "n_a"), "product_a").join(singles.toDF("product_b", "n_b"), "product_b").crossJoin(F.broadcast(total))
    share = F.col("pair_count") / F.col("baskets") / ((F.col("n_a") / F.col("baskets")) * (F.col("n_b") / F.col("baskets")))
    return df.select("product_a", "product_b", "pair_count", share.alias("lift"))


def prune_topk(edges: DataFrame, k: int = 10) -> DataFrame:
    """Edges (src, dst, weight) among the ``k`` heaviest of both ends; ranks are taken before pruning."""
    ends = edges.select(F.col("src").alias("node"), "src", "dst", "weight").union(edges.select(F.col("dst"), "src", "dst", "weight"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "src", "dst"))
    kept = ends.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("src", "dst").agg(F.count("*").alias("ends")).where("ends = 2")
    return edges.join(kept.select("src", "dst"), ["src", "dst"], "left_semi")


def copurchase_edges(tx: DataFrame, min_count: int = 5, lift: float = 1.5, k: int | None = 10, lifts: DataFrame | None = None) -> DataFrame:
    """Pairs bought together more often than by chance; ``lifts``: those of ``pair_lifts``, where they are at hand."""
    lifts = pair_lifts(tx, min_count) if lifts is None else lifts
    edges = lifts.where(F.col("lift") >= lift).select(F.col("product_a").alias("src"), F.col("product_b").alias("dst"), F.col("lift").alias("weight"), "pair_count")
    return prune_topk(edges, k) if k else edges


def category_pairs(tx: DataFrame, cap: int | None = None) -> DataFrame:
    """Pairs of one category (of all its products, or its first ``cap``) with their customers and how many are shared."""
    dim = product_dim(tx)
    price = F.col("total_spend") / F.greatest("total_quantity", F.lit(1.0))
    products = dim.select("product_id", F.col("PROD_CODE_10").alias("category"), price.alias("price")).where("category is not null")
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("category").orderBy("product_id"))
        products = products.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")
    lines = known_customers(tx).select(F.col("PROD_CODE").alias("product_id"), F.col("CUST_CODE").alias("customer_id"))
    rows = rows_of(tx)
    buyers = dealt(lines, rows, "customer_id", "product_id").distinct()
    counts = buyers.groupBy("product_id").agg(F.count("*").alias("customers"))
    bought = dealt(buyers.join(products.select("product_id", "category"), "product_id"), rows, "category", "customer_id")
    shared = listed_pairs(bought, ["category", "customer_id"]).groupBy("product_a", "product_b").agg(F.count("*").alias("shared"))
    x, y = products.toDF("product_a", "category", "price_a"), products.toDF("product_b", "category", "price_b")
    df = x.join(y, "category").where("product_a < product_b").join(shared, ["product_a", "product_b"], "left")
    df = df.join(counts.toDF("product_a", "customers_a"), "product_a", "left").join(counts.toDF("product_b", "customers_b"), "product_b", "left")
    df = df.fillna(0, ["shared", "customers_a", "customers_b"])
    union = F.col("customers_a") + F.col("customers_b") - F.col("shared")
    gap = F.abs(F.col("price_a") - F.col("price_b")) / ((F.col("price_a") + F.col("price_b")) / 2)
    return df.withColumn("jaccard", F.coalesce(F.try_divide("shared", union), F.lit(0.0))).withColumn("price_gap", F.when((F.col("price_a") > 0) & (F.col("price_b") > 0), gap))


def substitution_edges(tx: DataFrame, jaccard: float = 0.6, max_lift: float = 1.2, gap: float = 0.3, buyers: int = 5, default_lift: float = 0.5, min_count: int = 5, lifts: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Products of one category that share customers, are seldom bought together and cost alike; ``lifts`` as above, ``cap`` as in ``category_pairs``."""
    lifts = (pair_lifts(tx, min_count) if lifts is None else lifts).select("product_a", "product_b", "lift")
    enough = (F.col("customers_a") >= buyers) & (F.col("customers_b") >= buyers) & (F.col("jaccard") >= jaccard)
    df = category_pairs(tx, cap).where(enough).join(lifts, ["product_a", "product_b"], "left").fillna(default_lift, ["lift"])
    df = df.where((F.col("lift") <= max_lift) & (F.col("price_gap") <= gap))
    weight = F.col("jaccard") * (1 - F.least("lift", F.lit(1.0)))
    return df.select(F.col("product_a").alias("src"), F.col("product_b").alias("dst"), weight.alias("weight"), "jaccard", "lift", "price_gap")


def hierarchy_edges(tx: DataFrame) -> DataFrame:
    """Product to first level, and each level to the next; category edges once."""
    dim = product_dim(tx)
    chain = ["product_id", *LEVELS]
    steps = [dim.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(w).alias("weight"), F.lit(k + 1).alias("hierarchy_distance")) for k, (a, b, w) in enumerate(zip(chain, chain[1:], HIERARCHY_WEIGHTS))]
    out = steps[0]
    for step in steps[1:]:
        out = out.union(step)
    return out.where("src is not null and dst is not null").distinct()


def build_graph(tx: DataFrame, jaccard: float = 0.6, gap: float = 0.3, caps: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """All edges: src, dst, edge_type, weight. Pairs of baskets are joined once, for both kinds of edges; ``caps``: of baskets and categories."""
    lifts = staged(pair_lifts(tx, cap=caps[0]), "lifts")
    parts = (("copurchase", copurchase_edges(tx, lifts=lifts)), ("substitution", substitution_edges(tx, jaccard, gap=gap, lifts=lifts, cap=caps[1])), ("hierarchy", hierarchy_edges(tx)))
    out = None
    for name, edges in parts:
        rows = edges.select("src", "dst", F.lit(name).alias("edge_type"), "weight")
        out = rows if out is None else out.union(rows)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours of each node by edge type, both directions, as sorted arrays of (neighbour, weight)."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "edge_type", "weight").union(edges.select("dst", "src", "edge_type", "weight"))
    return both.groupBy("node", "edge_type").agg(F.sort_array(F.collect_list(F.struct("neighbour", "weight"))).alias("neighbours"))


def component_labels(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Smallest node reachable from each node of an edge table (src, dst): node, component.

    Labels spread along edges and jump to the label of their label, each round
    written to the shared folder, until none changes.
    """
    both = staged(edges.select("src", "dst").union(edges.select("dst", "src")).toDF("node", "other").distinct(), "graph-edges")
    labels = staged(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "graph-labels")
    for _ in range(rounds):
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jumped = spread.join(labels.toDF("at", "further"), spread["component"] == F.col("at"), "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component"), "old")
        after = staged(jumped, "graph-labels")
        if after.where("component <> old").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
    raise RuntimeError("labels did not settle")


def substitution_clusters(products: DataFrame, edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``products`` (product_id, sub_commodity) with a cluster number within the category.

    Clusters are components over edges of enough weight, numbered by smallest
    product; all other products of a category share one cluster. Without any
    such edge every product gets 0.
    """
    strong = edges.where(F.col("weight") >= threshold)
    if strong.isEmpty():
        return products.withColumn("substitution_cluster", F.lit(0))
    labels = component_labels(strong).toDF("product_id", "component")
    df = products.join(labels, "product_id", "left").withColumn("component", F.coalesce("component", F.lit("")))
    least = df.groupBy("sub_commodity", "component").agg(F.min("product_id").alias("least"))
    number = (F.row_number().over(Window.partitionBy("sub_commodity").orderBy("least")) - 1).alias("substitution_cluster")
    numbers = least.select("sub_commodity", "component", number)
    return df.join(numbers, ["sub_commodity", "component"]).drop("component")


def competitive_intensity(edges: DataFrame) -> DataFrame:
    """Number of substitution edges at each product."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("product_id"))
    return ends.groupBy("product_id").agg(F.count("*").alias("competitive_intensity"))


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges by kind, density, components, degrees and a score.

    Points lost: 30 without edges, 20 if the largest component holds less than half
    of the nodes, 10 if the mean degree is below 2.
    """
    labels = nodes.select(F.col("node_id").alias("node"), "node_type").join(component_labels(edges), "node", "left").select("node_type", F.coalesce("component", "node").alias("component"))
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"), F.count_if(F.col("node_type") == "product").alias("products"))
    parts = sizes.agg(F.count("*").alias("components"), F.max("size").alias("largest"), F.sum("size").alias("nodes"), F.sum("products").alias("product_nodes"))
    degree = nodes.select(F.col("node_id").alias("node")).join(edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")), "node", "left").fillna(0)
    degrees = degree.agg(F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    kinds = [F.count_if(F.col("edge_type") == k).alias(f"{k}_edges") for k in ("copurchase", "substitution", "hierarchy")]
    count = edges.agg(F.count("*").alias("edges"), F.count_distinct("edge_type").alias("edge_types"), *kinds)
    n, share = F.col("nodes"), F.col("largest") / F.col("nodes")
    lost = F.when(F.col("edges") == 0, 30.0).otherwise(0.0) + F.when(share < 0.5, 20.0).otherwise(0.0) + F.when(F.col("mean_degree") < 2, 10.0).otherwise(0.0)
    return parts.crossJoin(degrees).crossJoin(count).select(
        "nodes", "product_nodes", (n - F.col("product_nodes")).alias("category_nodes"), "edges", "edge_types", "copurchase_edges", "substitution_edges", "hierarchy_edges", "components", share.alias("largest_share"),
        F.try_divide(2 * F.col("edges"), n * (n - 1)).alias("density"), "mean_degree", "max_degree", "min_degree", "isolated", (100.0 - lost).alias("score"),
    )


def substitution_funnel(tx: DataFrame, jaccard: float = 0.6, gap: float = 0.3, buyers: int = 5, max_lift: float = 1.2, lift_unknown: float = 0.5) -> DataFrame:
    """One row: how many category pairs pass each rule in turn, how many fail at each, and which rule to loosen.

    A pair that no basket holds has the lift ``lift_unknown``.
    """
    lifts = pair_lifts(tx).select("product_a", "product_b", "lift")
    p = category_pairs(tx).join(lifts, ["product_a", "product_b"], "left").fillna(lift_unknown, ["lift"])
    rules = {
        "enough_customers": (F.col("customers_a") >= buyers) & (F.col("customers_b") >= buyers),
        "shared_customers": F.col("jaccard") >= jaccard,
        "low_lift": F.col("lift") <= max_lift,
        "priced": F.coalesce((F.col("price_a") > 0) & (F.col("price_b") > 0), F.lit(False)),
        "alike_prices": F.coalesce(F.col("price_gap") <= gap, F.lit(False)),
    }
    passed, counts = F.lit(True), [F.count("*").alias("pairs")]
    for name, rule in rules.items():
        failed, passed = passed & ~rule, passed & rule
        counts += [F.count_if(passed).alias(name), F.count_if(failed).alias(f"not_{name}")]
    out = p.agg(*counts)
    advice = {
        "lower_min_customers": F.col("not_enough_customers") > F.col("pairs") * 0.5,
        "lower_jaccard": F.col("not_shared_customers") > F.col("enough_customers") * 0.8,
        "impute_prices": F.col("not_priced") > F.col("shared_customers") * 0.3,
        "widen_price_gap": F.col("not_alike_prices") > F.col("priced") * 0.5,
    }
    return out.withColumns(advice)
