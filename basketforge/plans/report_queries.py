"""Queries that report on features, contexts and splits, and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketforge.functions.columns import tidy
from basketforge.operators import affinity as A
from basketforge.operators import graph as G
from basketforge.operators import missions as M
from basketforge.operators import pricing as P
from basketforge.operators import quality as Q
from basketforge.operators import sequences as S
from basketforge.operators import stores as ST
from basketforge.operators import temporal as T
from basketforge.operators import vectors as V
from basketforge.plans.evaluation_queries import _PR, _SCORED, _check_sql
from basketforge.plans.feature_queries import _FOUR, FEATURES, PROFILE, told
from basketforge.plans.customer_queries import AFFINITY, MISSIONS
from basketforge.plans.graph_queries import BRANDS, CAPPED_GRAPH, GAP, GRAPH, JACCARD, brands, graph, prices
from basketforge.plans.registry import SQL, register
from basketforge.plans.sample_queries import (
    _EACH_WAY, _IDENT, _NORM10, _SV, _TEMP, CUSTOMERS, EMBEDDINGS, T1, T5, T6, _attributes, _customer_context, _embedded, _stores, concat_sql, hash_sql, label_sql, price_vectors, product_vectors,
)
from basketforge.plans.shared_sql import ALL_PRICES, TX, with_sql
from basketforge.plans.temporal_queries import _PRIOR, CALENDAR, META, PAIRS, meta, pairs
from basketforge.session import staging_path
from basketforge.sources import transactions as files
from basketforge.sources.transactions import transactions as tx

_MOSTLY = _SCORED.replace("constant_dims > 32", "constant_dims > 6.4")
_STORE_VECTORS = f"{PROFILE}, {_SV}, svec AS (SELECT store_id, format, {concat_sql(_IDENT, label_sql('format', 'format', 16), label_sql('region', 'region', 16), 'ops_vec')} AS vector FROM (SELECT *, {hash_sql(chr(39) + 'store:' + chr(39) + ' || store_id', 32)} AS ident FROM sv))"
_STORE_REPORT = "SELECT *, 100.0 - CASE WHEN nulls > 0 THEN 30.0 ELSE 0.0 END - CASE WHEN wrong_width > 0 THEN 20.0 ELSE 0.0 END AS score FROM (SELECT (SELECT count(*) FROM svec) AS stores, (SELECT count(*) FROM svec WHERE len(vector) <> 96) AS wrong_width, (SELECT '{' || string_agg('\"' || format || '\":' || n, ',' ORDER BY format) || '}' FROM (SELECT format, count(*) AS n FROM svec GROUP BY ALL)) AS formats, count(*) FILTER (WHERE x IS NULL) AS nulls, avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT unnest(vector) AS x FROM svec))"


def _store_vectors(spark, sf):
    stores = _stores(spark, sf)
    vectors = V.store_features(stores, ST.operations_vector([F.col(c) for c in _NORM10]))
    return vectors.join(stores.select("store_id", "format"), "store_id")


@register("m5_price_feature_report", with_sql(f"{FEATURES}, {_check_sql('features', 'pf', 64)}", f"SELECT *, (SELECT max(list_max(list_slice(features, 1, 24))) FROM pf) AS fourier_max, (SELECT min(list_min(list_slice(features, 1, 24))) FROM pf) AS fourier_min FROM ({_MOSTLY})", "mean, mean_std, score, fourier_max, fourier_min", 4))
def m5(spark, sf):
    return tidy(Q.price_feature_report(price_vectors(spark, sf)), 4)


_CUSTOMER_REPORT = f"""WITH ce AS ({CUSTOMERS}), {_check_sql('vector', 'ce', 160)}, nm AS (SELECT sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM ce)
SELECT *, 100.0 - CASE WHEN bad_rows > 0 THEN 30.0 ELSE 0.0 END - CASE WHEN constant_dims > 16 THEN 20.0 ELSE 0.0 END AS score FROM (
  SELECT (SELECT count(*) FROM ce) AS rows, (SELECT avg(n) FROM nm) AS mean_norm, (SELECT stddev_samp(n) FROM nm) AS std_norm, (SELECT CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) FROM nm) AS zero_norm, avg(s2) AS mean_variance, CAST(count(*) FILTER (WHERE s2 < 1e-10) AS BIGINT) AS constant_dims,
    (SELECT avg(trips) FROM ce) AS mean_trips, (SELECT CAST(count(*) FILTER (WHERE trips < 5) AS BIGINT) FROM ce) AS cold_start, (SELECT CAST(count(*) FILTER (WHERE len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) > 0) AS BIGINT) FROM ce) AS bad_rows FROM dims)"""


@register("m6_customer_report", with_sql("one AS (SELECT 1)", _CUSTOMER_REPORT, "mean_norm, std_norm, mean_variance, mean_trips, score"), shared=True)
def m6_customers(spark, sf):
    return tidy(Q.customer_embedding_report(_embedded(spark, sf)))


@register("m7_store_report", with_sql(_STORE_VECTORS, _STORE_REPORT, "mean, std, score"), shared=True)
def m7(spark, sf):
    return tidy(Q.store_report(_store_vectors(spark, sf)))


_TENSORS = {
    "T1": (T1, 192), "T2": (EMBEDDINGS, 256), "T3": (f"WITH {CALENDAR} SELECT {_TEMP} AS vector FROM calendar", 64), "T4": (f"WITH {FEATURES} SELECT features AS vector FROM pf", 64), "T5": (T5, 96), "T6": (T6, 48),
}


def _tensor_sql(name: str) -> str:
    sql, width = _TENSORS[name]
    return f"SELECT '{name}' AS context, * FROM (WITH t AS ({sql}), {_check_sql('vector', 't', width)} {_SCORED.replace('> 32', f'> {width / 2}')})"


def tensor_checks(spark, sf):
    """Checks of all six contexts: customers, products, time, prices, stores and trips."""
    store = V.store_context(_stores(spark, sf), ST.context_vector(*(F.col(c) for c in _FOUR)))
    tables = {
        "T1": _customer_context(spark, sf), "T2": product_vectors(spark, sf), "T3": V.tallied_vectors(T.calendar_features(meta(spark, sf)), V.TIME_LABELS, V.temporal_vector()), "T4": price_vectors(spark, sf).select(F.col("features").alias("vector")),
        "T5": store, "T6": V.tallied_vectors(_attributes(spark, sf), V.TRIP_LABELS, F.concat(*V.mission_embeddings())),
    }
    return {name: Q.vector_check(df, _TENSORS[name][1], times="times" if "times" in df.columns else None) for name, df in tables.items()}


@register("m8_context_checks", with_sql("one AS (SELECT 1)", " UNION ALL ".join(map(_tensor_sql, _TENSORS)), "mean, mean_std, score", 4), shared=True)
def m8_contexts(spark, sf):
    """Width, bad numbers, constant places and score of T1 to T6."""
    out = None
    for name, check in tensor_checks(spark, sf).items():
        row = check.select(F.lit(name).alias("context"), "*")
        out = row if out is None else out.union(row)
    return tidy(out, 4)


@register("m8_customer_context_check", with_sql("one AS (SELECT 1)", f"SELECT * EXCLUDE (context) FROM ({_tensor_sql('T1')})", "mean, mean_std, score"), shared=True)
def m8_customers(spark, sf):
    """Check of the customer context T1, all 192 places."""
    return tidy(Q.vector_check(_customer_context(spark, sf).select("customer_id", "vector"), 192))


_PRODUCT_SCORE = """SELECT 100.0 - CASE WHEN (SELECT sum(bad) FROM dims) > 0 THEN 30.0 ELSE 0.0 END - CASE WHEN (SELECT count(*) FROM e WHERE list_sum(list_transform(vector, lambda x: x * x)) = 0) > 0 THEN 20.0 ELSE 0.0 END
- CASE WHEN (SELECT count(*) FROM dims WHERE s2 < 1e-10) > 25.6 THEN 20.0 ELSE 0.0 END AS score"""
_SECTIONS = {
    "data_pipeline": {
        "prices": f"WITH {ALL_PRICES} {_PR}", "graph": SQL["i9_graph_metrics"].replace(CAPPED_GRAPH, GRAPH),
        "affinity": f"WITH {AFFINITY} SELECT CASE WHEN count(*) = 0 THEN 0.0 WHEN count(*) > count(loyalty_score) THEN 80.0 ELSE 100.0 END AS score FROM affinity",
        "missions": f"WITH {MISSIONS} SELECT CASE WHEN count(*) = 0 THEN 0.0 WHEN avg((abs(p_mission_full_shop + p_mission_top_up + p_mission_small_shop + p_mission_emergency - 1) <= 0.01)::INT) < 0.95 THEN 70.0 ELSE 100.0 END AS score FROM missions",
    },
    "features": {
        "pseudo_brands": f"WITH {BRANDS}, sz AS (SELECT pseudo_brand_id, count(*) AS n FROM brands GROUP BY ALL) SELECT 100.0 - CASE WHEN avg((n = 1)::INT) > 0.5 THEN 20.0 ELSE 0.0 END - CASE WHEN count(*) < 10 THEN 20.0 ELSE 0.0 END AS score FROM sz",
        "price_features": f"WITH {FEATURES}, {_check_sql('features', 'pf', 64)} {_MOSTLY}", "product_embeddings": f"WITH e AS ({EMBEDDINGS}), {_check_sql('vector', 'e', 256)} {_PRODUCT_SCORE}",
        "customer_embeddings": _CUSTOMER_REPORT, "stores": f"WITH {_STORE_VECTORS} {_STORE_REPORT}",
    },
    "tensors": {name: _tensor_sql(name) for name in _TENSORS},
}
_SCORES = " UNION ALL ".join(f"SELECT '{part}' AS part, '{name}' AS section, score FROM ({sql})" for part, own in _SECTIONS.items() for name, sql in own.items())


@register("m9_quality_summary", f"WITH s AS ({_SCORES}), m AS (SELECT part, 'mean' AS section, avg(score) AS score FROM s GROUP BY part) SELECT part, section, floor(CAST(score AS DOUBLE) * 1000000 + 0.5001) / 1000000 AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT 'overall', 'mean', avg(score) FROM m)", shared=True)
def m9(spark, sf):
    """Scores of all sections of the three parts, the mean of each part, and the mean of those."""
    t = tx(spark, sf)
    missions = M.assemble_missions(t)
    parts = {
        "data_pipeline": {
            "prices": Q.price_report(prices(spark, sf)), "graph": G.graph_metrics(G.graph_nodes(t), graph(spark, sf)), "affinity": Q.affinity_score(A.assemble_affinity(t)),
            "missions": Q.mission_score(missions, ["p_mission_full_shop", "p_mission_top_up", "p_mission_small_shop", "p_mission_emergency"]),
        },
        "features": {
            "pseudo_brands": Q.brand_score(brands(spark, sf)), "price_features": Q.price_feature_report(price_vectors(spark, sf)), "product_embeddings": Q.embedding_score(product_vectors(spark, sf), 256),
            "customer_embeddings": Q.customer_embedding_report(_embedded(spark, sf)), "stores": Q.store_report(_store_vectors(spark, sf)),
        },
        "tensors": tensor_checks(spark, sf),
    }
    return tidy(Q.quality_summary(parts))


@register("d30_pair_report", with_sql(PAIRS, "SELECT split, count(*) AS samples, count(DISTINCT customer_id) AS customers, avg(num_history_baskets) AS mean_history, avg(len(input_products)) AS mean_input_size, avg(len(target_products)) AS mean_target_size, avg(week_gap) AS mean_week_gap FROM pairs GROUP BY ALL", "mean_history, mean_input_size, mean_target_size, mean_week_gap"))
def d30_pairs(spark, sf):
    return tidy(T.pair_report(pairs(spark, sf)))


_DOC = "'\"' || split || '\":{\"n_samples\":' || n || ',\"n_customers\":' || c || ',\"week_range\":[' || a || ',' || b || '],\"week_original_range\":[' || x || ',' || y || '],\"cold_start_count\":' || cold || '}'"


@register("d30_split_document", with_sql(f"{META}, {_PRIOR}, sp AS (SELECT split, count(*) AS n, count(DISTINCT customer_id) AS c, min(week) AS a, max(week) AS b, min(week_original) AS x, max(week_original) AS y, count(*) FILTER (WHERE prior_baskets < 5) AS cold FROM prior GROUP BY ALL)", f"SELECT '{{\"total_baskets\":' || sum(n) || ',\"splits\":{{' || string_agg({_DOC}, ',' ORDER BY split) || '}}}}' AS document FROM sp"))
def d30_document(spark, sf):
    return T.split_document(T.prior_baskets(meta(spark, sf)))


# Files: what is read is what was written.


@register("a2_calendar", with_sql(TX, "SELECT SHOP_WEEK AS shop_week, strptime(CAST(min(SHOP_DATE) AS VARCHAR), '%Y%m%d')::DATE AS date_from, strptime(CAST(max(SHOP_DATE) AS VARCHAR), '%Y%m%d')::DATE AS date_to FROM tx GROUP BY ALL"))
def a2(spark, sf):
    """The calendar of the weeks with sales, through a CSV file."""
    days = tx(spark, sf).groupBy(F.col("SHOP_WEEK").alias("shop_week")).agg(F.min("SHOP_DATE").alias("date_from"), F.max("SHOP_DATE").alias("date_to"))
    path = staging_path(spark, "calendar")
    files.write_csv(days, path)
    return tidy(files.read_calendar(spark, path))


@register("a3_stage_table", with_sql(ALL_PRICES, "SELECT product_id, store_id, week, actual_price, base_price FROM prices", "actual_price, base_price"))
def a3(spark, sf):
    """Derived prices, through a stage table that is partitioned by week."""
    path = staging_path(spark, "prices")
    files.write_stage(P.derive_prices(tx(spark, sf)).select(*P.CELL, "actual_price", "base_price"), path, ["week"])
    return tidy(files.read_stage(spark, path).select("product_id", "store_id", "week", "actual_price", "base_price"))


@register("a3_graph_stage", with_sql(f"{GRAPH}, {_EACH_WAY}", "SELECT node, other, edge_type, weight FROM each_way", "weight"))
def a3_graph(spark, sf):
    """Every edge from both ends, through a stage in buckets of the other end."""
    return tidy(files.write_bucketed(V.edge_ends(G.build_graph(tx(spark, sf), JACCARD, GAP)), "ends", ["other"]))


@register("a3_embedding_stage", SQL["j4_neighbour_hop"])
def a3_embeddings(spark, sf):
    """The neighbour hop of J4, from a stage of edges and one of vectors that meet without an exchange."""
    t = tx(spark, sf)
    ends = files.write_bucketed(V.edge_ends(G.build_graph(t, JACCARD, GAP)), "ends", ["other"])
    vectors = S.build_vocab(t, "PROD_CODE").select(F.col("value").alias("node"), V.hash_vector(F.col("value"), 8).alias("vector"))
    hop = V.hop_from_ends(files.write_bucketed(vectors, "vectors", ["node"]), ends, 8)
    return tidy(hop.select("node", told("vector")))


@register("d28_chunked_time", SQL["d28_basket_time"])
def d28_chunks(spark, sf):
    """Basket times from saved states of three chunks that share baskets, each added without reading the others."""
    t = tx(spark, sf)
    saved = T.saved_basket_time(spark, staging_path(spark, "time-states"))
    for k in range(3):
        saved.add(t.where(F.col("LINE_SEQ") % 3 == k), str(k))
    found = saved.result()
    return tidy(found.select("basket_id", T.date_string("first.SHOP_DATE").alias("shop_date"), F.col("first.SHOP_WEEKDAY").alias("shop_weekday"), F.col("first.SHOP_HOUR").alias("shop_hour")))


@register("d31_chunked_activity", SQL["d31_customer_activity"])
def d31_chunks(spark, sf):
    """Lines of each customer from saved states of three chunks of weeks; one chunk is added twice, and the states are compacted before the last."""
    known = tx(spark, sf).where("CUST_CODE is not null")
    chunk = lambda k: known.where(F.col("SHOP_WEEK") % 3 == k)
    saved = Q.saved_activity(spark, staging_path(spark, "activity-states"))
    for k in (0, 1, 0):
        saved.add(chunk(k), str(k))
    saved = saved.compacted(staging_path(spark, "activity-compacted"))
    saved.add(chunk(2), "2")
    return tidy(saved.result())


_CSV = ["BASKET_ID", "CUST_CODE", "PROD_CODE", "STORE_CODE", "SHOP_WEEK", "QUANTITY", "SPEND"]


@register("a5_sample_csv", with_sql(f"{TX}, chosen AS (SELECT CUST_CODE FROM tx WHERE CUST_CODE IS NOT NULL GROUP BY CUST_CODE ORDER BY count(*) DESC, CUST_CODE LIMIT 25)", "SELECT CAST(BASKET_ID AS VARCHAR) AS BASKET_ID, CUST_CODE, PROD_CODE, STORE_CODE, SHOP_WEEK, CAST(QUANTITY AS DOUBLE) AS QUANTITY, CAST(SPEND AS DOUBLE) AS SPEND FROM tx JOIN chosen USING (CUST_CODE)", "QUANTITY, SPEND"))
def a5(spark, sf):
    """All lines of the 25 most active customers, through CSV files of the transactions' schema."""
    t = tx(spark, sf)
    path = staging_path(spark, "sample")
    names = [f.name for f in files.TRANSACTIONS]
    files.write_csv(Q.extract_customers(t, Q.top_customers(t, 25)).select(*(F.col(c) for c in names)), path)
    return tidy(files.read_transactions(spark, path, _CSV))
