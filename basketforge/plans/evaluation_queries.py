"""Queries that rank and evaluate, report on quality, and sample.

Scores come from the tables: the share of training baskets of a store that hold a
product, or a customer's visits to each store, shifted by a hash so that ties are few.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from basketforge.functions.columns import tidy
from basketforge.operators import affinity as A
from basketforge.operators import graph as G
from basketforge.operators import missions as M
from basketforge.operators import pricing as P
from basketforge.operators import quality as Q
from basketforge.operators import ranking as R
from basketforge.operators import sequences as S
from basketforge.operators import vectors as V
from basketforge.operators.labels import label_code
from basketforge.plans.customer_queries import AFFINITY, MISSIONS
from basketforge.plans.graph_queries import BRANDS, GAP, GRAPH, JACCARD, brands
from basketforge.plans.registry import register
from basketforge.plans.shared_sql import ALL_PRICES, TX, with_sql
from basketforge.plans.temporal_queries import META, PAIRS, TRAIN, meta, pairs
from basketforge.sources.transactions import transactions as tx

#: Item scores: sample = a basket of the test weeks; items = products of its store, scored by lines in training weeks.
_ITEM = f"""pop AS (SELECT store_id, item, n + ('0x' || substr(md5(store_id || item), 1, 6))::BIGINT / 16777216.0::DOUBLE AS score FROM (
  SELECT STORE_CODE AS store_id, PROD_CODE AS item, count(*) AS n FROM tx JOIN weeks ON SHOP_WEEK = week_original WHERE week <= {TRAIN} GROUP BY ALL)),
truth AS (SELECT DISTINCT t.BASKET_ID AS sample_id, PROD_CODE AS item FROM tx t JOIN meta m ON m.basket_id = t.BASKET_ID WHERE split = 'test'),
scores AS (SELECT basket_id AS sample_id, item, score FROM meta JOIN pop USING (store_id) WHERE split = 'test'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, item) AS rank FROM scores)"""
ITEMS = f"{META}, {_ITEM}"
#: Store scores: sample = a next-basket pair of the test weeks; items = stores the customer visited in training weeks.
_STORE = f"""vis AS (SELECT customer_id, item, n + ('0x' || substr(md5(customer_id || item), 1, 6))::BIGINT / 16777216.0::DOUBLE AS score FROM (SELECT customer_id, store_id AS item, count(*) AS n FROM meta WHERE customer_id IS NOT NULL AND week <= {TRAIN} GROUP BY ALL)),
targets AS (SELECT target_basket_id AS sample_id, customer_id, input_store_id AS previous, target_store_id AS target, bucket, target_week AS week FROM pairs WHERE split = 'test'),
scores AS (SELECT sample_id, item, score FROM targets JOIN vis USING (customer_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, item) AS rank FROM scores),
tr AS (SELECT targets.*, rank FROM targets LEFT JOIN ranked ON ranked.sample_id = targets.sample_id AND item = target),
pred AS (SELECT targets.*, item AS predicted FROM targets JOIN ranked USING (sample_id) WHERE rank = 1)"""
STORES = f"{PAIRS}, {_STORE}"


def _md5_share(*parts):
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 6), 16, 10).cast("double") / 16777216.0


def _item_scores(spark, sf, best=None, over=None):
    """Scores and truth; with ``best``, the best items of each sample alone, with ``over``, those of a higher score.

    A sample's scores are those of its store, so a store's items are picked before they are joined.
    """
    m = meta(spark, sf)
    lines = tx(spark, sf).select(F.col("BASKET_ID").alias("basket_id"), F.col("PROD_CODE").alias("item"))
    known = lines.join(m.select("basket_id", "store_id", "split"), "basket_id")
    pop = known.where("split = 'train'").groupBy("store_id", "item").agg(F.count("*").alias("n")).withColumn("score", F.col("n") + _md5_share("store_id", "item"))
    if over is not None:
        pop = R.above_threshold(pop, over)
    if best:
        pop = R.topk(pop.withColumnRenamed("store_id", "sample_id"), best).select(F.col("sample_id").alias("store_id"), "item", "n", "score")
    scores = m.where("split = 'test'").select(F.col("basket_id").alias("sample_id"), "store_id").join(pop, "store_id").select("sample_id", "item", "score")
    truth = known.where("split = 'test'").select(F.col("basket_id").alias("sample_id"), "item").distinct()
    return scores, truth


def _store_scores(spark, sf):
    m = meta(spark, sf).where("customer_id is not null and split = 'train'")
    visits = m.groupBy("customer_id", F.col("store_id").alias("item")).agg(F.count("*").alias("n")).withColumn("score", F.col("n") + _md5_share("customer_id", "item"))
    targets = pairs(spark, sf).where("split = 'test'").select(F.col("target_basket_id").alias("sample_id"), "customer_id", F.col("input_store_id").alias("previous"), F.col("target_store_id").alias("target"), "bucket", F.col("target_week").alias("week"))
    return targets.join(visits, "customer_id").select("sample_id", "item", "score"), targets


def _pred(spark, sf):
    return R.predictions(*_store_scores(spark, sf))


@register("f7_topk", with_sql(ITEMS, "SELECT sample_id, item, rank FROM ranked WHERE rank <= 3"))
def f7(spark, sf):
    return tidy(R.topk(_item_scores(spark, sf, 3)[0], 3).select("sample_id", "item", "rank"))


@register("f8_above_threshold", with_sql(ITEMS, "SELECT sample_id, count(*) AS n FROM scores WHERE score > 4 GROUP BY ALL"))
def f8(spark, sf):
    return tidy(_item_scores(spark, sf, over=4.0)[0].groupBy("sample_id").agg(F.count("*").alias("n")))


@register("f9_sampled_items", with_sql(ITEMS, "SELECT sample_id, arg_max(item, (score / 2.0::DOUBLE - ln(-ln((('0x' || substr(md5('5:' || sample_id || ':' || item), 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE)), item)) AS item FROM scores GROUP BY ALL"))
def f9(spark, sf):
    return tidy(R.sample_from_scores(_item_scores(spark, sf)[0], 2.0))


def _basket_sql(k: int) -> str:
    p, r = f"h{k} / {k}", f"h{k} / greatest(n, 1)"
    return f"avg({p}) AS precision_{k}, avg({r}) AS recall_{k}, avg(2 * {p} * {r} / ({p} + {r} + 1e-8)) AS f1_{k}, avg((h{k} > 0)::INT) AS hit_rate_{k}, avg(CASE WHEN n > 0 THEN d{k} / list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END) AS ndcg_{k}"


_KS = (5, 10, 20)
_NAMES = [f"{m}_{k}" for k in _KS for m in ("precision", "recall", "f1", "hit_rate", "ndcg")]


@register("l1_basket_metrics", with_sql(f"{ITEMS}, best AS (SELECT r.*, t.item IS NOT NULL AS hit FROM ranked r LEFT JOIN truth t USING (sample_id, item) WHERE rank <= 20), per AS (SELECT sample_id, {', '.join(f'sum((hit AND rank <= {k})::INT) AS h{k}, sum(CASE WHEN hit AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS d{k}' for k in _KS)} FROM best GROUP BY ALL), act AS (SELECT sample_id, count(*) AS n FROM truth GROUP BY ALL)", f"SELECT {', '.join(map(_basket_sql, _KS))} FROM per JOIN act USING (sample_id)", ", ".join(_NAMES)))
def l1(spark, sf):
    return tidy(R.basket_metrics(*_item_scores(spark, sf, max(_KS))))


_MASKED = "count(*) AS items, avg(coalesce((rank <= 1)::INT, 0)) AS accuracy, avg(coalesce((rank <= 5)::INT, 0)) AS hit_at_5, avg(coalesce((rank <= 10)::INT, 0)) AS hit_at_10, avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END) AS mrr"
_MD = "accuracy, hit_at_5, hit_at_10, mrr"


@register("l2_masked_metrics", with_sql(STORES, f"SELECT {_MASKED} FROM tr", _MD))
def l2(spark, sf):
    return tidy(R.masked_metrics(*_store_scores(spark, sf)))


@register("l4_metrics_by_bucket", with_sql(STORES, f"SELECT bucket, {_MASKED} FROM tr GROUP BY ALL", _MD))
def l4(spark, sf):
    return tidy(R.masked_metrics(*_store_scores(spark, sf), ["bucket"]))


@register("l5_metrics_by_week", with_sql(STORES, f"SELECT week, {_MASKED} FROM tr GROUP BY ALL", _MD))
def l5(spark, sf):
    return tidy(R.masked_metrics(*_store_scores(spark, sf), ["week"]))


_TASKS = {"size": ("BASKET_SIZE", ["S", "M", "L"]), "sensitivity": ("BASKET_PRICE_SENSITIVITY", ["LA", "MM", "UM"]), "type": ("BASKET_TYPE", list(M.MISSION_TYPES)), "focus": ("BASKET_DOMINANT_MISSION", list(M.MISSION_FOCUSES))}


def _code_sql(column: str, labels: list[str]) -> str:
    return f"CASE {' '.join(f"WHEN min({column}) = '{x}' THEN {k + 1}" for k, x in enumerate(labels))} ELSE 0 END"


_LABELLED = " UNION ALL ".join(f"SELECT BASKET_ID AS basket_id, '{task}' AS task, {_code_sql(c, labels)} AS label FROM tx GROUP BY ALL" for task, (c, labels) in _TASKS.items())
_USUAL = f"lab AS ({_LABELLED}), known AS (SELECT lab.*, customer_id, split FROM lab JOIN meta USING (basket_id) WHERE customer_id IS NOT NULL), often AS (SELECT customer_id, task, label, count(*) AS n FROM known WHERE split = 'train' AND label > 0 GROUP BY ALL), usual AS (SELECT customer_id, task, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, task ORDER BY n DESC, label) AS r FROM often) WHERE r = 1)"


@register("l3_label_accuracy", with_sql(f"{META}, {_USUAL}", "SELECT task, count(*) AS n, avg((predicted = label)::INT) AS accuracy FROM known JOIN usual USING (customer_id, task) WHERE split = 'test' AND label > 0 GROUP BY ALL", "accuracy"))
def l3(spark, sf):
    """Each label of a test basket, predicted as the customer's most frequent one in training weeks."""
    t, m = tx(spark, sf), meta(spark, sf).where("customer_id is not null").select("basket_id", "customer_id", "split")
    codes = t.groupBy(F.col("BASKET_ID").alias("basket_id")).agg(*(F.min(c).alias(c) for c, _ in _TASKS.values()))
    tasks = F.array(*(F.struct(F.lit(task).alias("task"), label_code(c, labels, 1, 0).alias("label")) for task, (c, labels) in _TASKS.items()))
    known = codes.select("basket_id", F.explode(tasks).alias("t")).select("basket_id", "t.*").where("label > 0").join(m, "basket_id")
    often = known.where("split = 'train'").groupBy("customer_id", "task", "label").agg(F.count("*").alias("n"))
    usual = often.groupBy("customer_id", "task").agg((-F.max(F.struct("n", -F.col("label")))["col2"]).alias("predicted"))
    return tidy(R.label_accuracy(known.where("split = 'test'").join(usual, ["customer_id", "task"]).select("task", "predicted", "label")))


@register("l6_store_metrics", with_sql(STORES, "SELECT avg(coalesce((rank <= 1)::INT, 0)) AS accuracy, avg(coalesce((rank <= 3)::INT, 0)) AS top_3_accuracy, avg(coalesce((rank <= 5)::INT, 0)) AS top_5_accuracy, avg(coalesce((rank <= 10)::INT, 0)) AS top_10_accuracy, avg(1 / rank) AS mrr FROM tr", "accuracy, top_3_accuracy, top_5_accuracy, top_10_accuracy, mrr"))
def l6(spark, sf):
    return tidy(R.store_metrics(*_store_scores(spark, sf)))


_PER = "per AS (SELECT target AS store, count(*) AS samples, avg((predicted = target)::INT) AS accuracy FROM pred GROUP BY ALL), made AS (SELECT predicted AS store, count(*) AS times FROM pred GROUP BY ALL)"


@register("l7_per_store", with_sql(f"{STORES}, {_PER}", "SELECT store, samples, accuracy, coalesce(times, 0) AS times_predicted FROM per LEFT JOIN made USING (store)", "accuracy"))
def l7(spark, sf):
    return tidy(R.per_store_metrics(_pred(spark, sf)))


@register("l7_summary", with_sql(f"{STORES}, {_PER}", "SELECT avg(accuracy) AS mean, median(accuracy) AS median, min(accuracy) AS lowest, max(accuracy) AS highest, CAST(count(*) FILTER (WHERE accuracy = 0) AS BIGINT) AS zero_stores FROM per", "mean, median, lowest, highest"))
def l7_summary(spark, sf):
    return tidy(R.per_store_summary(R.per_store_metrics(_pred(spark, sf))))


@register("l8_transitions", with_sql(STORES, "SELECT previous = target AS same_store, count(*) AS samples, avg((predicted = target)::INT) AS accuracy, count(*) / (SELECT count(*) FROM pred) AS share FROM pred GROUP BY ALL", "accuracy, share"))
def l8(spark, sf):
    return tidy(R.transition_metrics(_pred(spark, sf)))


@register("l9_confusions", with_sql(STORES, "SELECT predicted, target, count(*) AS n FROM pred WHERE predicted <> target GROUP BY ALL ORDER BY n DESC, predicted, target LIMIT 10"))
def l9(spark, sf):
    return tidy(R.confusions(_pred(spark, sf)))


@register(
    "l10_examples",
    with_sql(
        f"{STORES}, firsts AS (SELECT * FROM targets ORDER BY sample_id LIMIT 10), "
        "shifted AS (SELECT *, exp(score - max(score) OVER (PARTITION BY sample_id)) AS e FROM ranked), probs AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id) AS p FROM shifted)",
        "SELECT f.sample_id, previous, target, string_agg(item, ',' ORDER BY rank) AS best, sum(CASE WHEN rank = 1 THEN p END) AS first_probability, sum(p) AS best_probability FROM firsts f JOIN probs USING (sample_id) WHERE rank <= 5 GROUP BY ALL",
        "first_probability, best_probability",
    ),
)
def l10(spark, sf):
    scores, targets = _store_scores(spark, sf)
    found = R.prediction_examples(scores, targets)
    return tidy(found.select("sample_id", "previous", "target", F.array_join("best.item", ",").alias("best"), F.get("best.p", F.lit(0)).alias("first_probability"), F.aggregate("best.p", F.lit(0.0), lambda a, x: a + x).alias("best_probability")))


@register("l11_log_loss", with_sql(f"{STORES}, z AS (SELECT sample_id, ln(sum(exp(score))) AS z FROM scores GROUP BY ALL)", "SELECT avg(z - score) AS log_loss FROM targets JOIN scores ON scores.sample_id = targets.sample_id AND item = target JOIN z ON z.sample_id = targets.sample_id", "log_loss"))
def l11(spark, sf):
    return tidy(R.log_loss(*_store_scores(spark, sf)))


@register("d34_class_weights", with_sql(f"{STORES}, c AS (SELECT target, count(*) AS n FROM targets GROUP BY ALL), w AS (SELECT *, pow(sum(n) OVER () / n, 0.1) AS raw FROM c)", "SELECT target, n, raw / avg(raw) OVER () AS weight FROM w", "weight"))
def d34(spark, sf):
    return tidy(R.class_weights(_store_scores(spark, sf)[1], "target"))


@register("f5_batches", with_sql(META, "SELECT basket_id, bucket, CAST(floor((row_number() OVER (PARTITION BY bucket ORDER BY md5('3:' || basket_id), basket_id) - 1) / 64) AS BIGINT) AS batch FROM meta"))
def f5(spark, sf):
    return tidy(S.plan_batches(meta(spark, sf), "basket_id", "bucket", 64).drop("batch_order"))


@register("f6_evaluation_groups", with_sql(META, "SELECT basket_id, week, CAST(floor((row_number() OVER (PARTITION BY week ORDER BY basket_id) - 1) / 16) AS BIGINT) AS batch FROM meta"))
def f6(spark, sf):
    return tidy(S.evaluation_groups(meta(spark, sf), "basket_id", "week", 16))


@register("f4_sampled_neighbours", with_sql(GRAPH, "SELECT node, edge_type, nb AS neighbour, nth FROM (SELECT *, row_number() OVER (PARTITION BY node, edge_type ORDER BY md5('6:' || node || ':' || nb), nb) AS nth FROM (SELECT src AS node, dst AS nb, edge_type FROM edges UNION ALL SELECT dst, src, edge_type FROM edges)) WHERE nth <= 3"))
def f4(spark, sf):
    return tidy(Q.sample_neighbors(G.adjacency(G.build_graph(tx(spark, sf), JACCARD, GAP)), 3).drop("weight"))


_TYPES = {v: f"p_mission_{n}" for v, n in (("Emergency", "emergency"), ("Full Shop", "full_shop"), ("Small Shop", "small_shop"), ("Top Up", "top_up"))}
_FOCUS = {v: f"p_focus_{v.lower()}" for v in ("Fresh", "Grocery", "Mixed")}


def _draw_sql(salt: int, columns: dict[str, str]) -> str:
    names, total = list(columns), " + ".join(columns.values())
    u = f"('0x' || substr(md5('{salt}:' || customer_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    tests = " ".join(f"WHEN {u} * ({total}) < {' + '.join(['0.0', *list(columns.values())[: k + 1]])} THEN '{n}'" for k, n in enumerate(names[:-1]))
    return f"CASE {tests} ELSE '{names[-1]}' END"


@register("f10_trip_contexts", with_sql(MISSIONS, f"SELECT customer_id, {_draw_sql(8, _TYPES)} AS mission_type, {_draw_sql(9, _FOCUS)} AS mission_focus, CASE WHEN mean_price_sensitivity < 0.33::DOUBLE THEN 'LA' WHEN mean_price_sensitivity < 0.67::DOUBLE THEN 'MM' ELSE 'UM' END AS price_sensitivity, CASE WHEN mean_basket_size < 0.4::DOUBLE THEN 'S' WHEN mean_basket_size < 0.75::DOUBLE THEN 'M' ELSE 'L' END AS basket_size FROM missions"))
def f10(spark, sf):
    return tidy(Q.sample_trip_context(M.assemble_missions(tx(spark, sf)), _TYPES, _FOCUS))


_ACT = "act AS (SELECT CUST_CODE AS customer_id, count(*) AS rows FROM tx WHERE CUST_CODE IS NOT NULL GROUP BY ALL)"


@register("d31_customer_activity", with_sql(f"{TX}, {_ACT}", "SELECT * FROM act"))
def d31(spark, sf):
    return tidy(Q.customer_activity(tx(spark, sf)))


@register("f1_top_customers", with_sql(f"{TX}, {_ACT}", "SELECT * FROM act ORDER BY rows DESC, customer_id LIMIT 10"))
def f1(spark, sf):
    return tidy(Q.top_customers(tx(spark, sf), 10))


@register("c6_extract_customers", with_sql(f"{TX}, {_ACT}", "SELECT BASKET_ID, LINE_SEQ, CUST_CODE FROM tx WHERE CUST_CODE IN (SELECT customer_id FROM act ORDER BY rows DESC, customer_id LIMIT 10)"))
def c6(spark, sf):
    t = tx(spark, sf)
    return tidy(Q.extract_customers(t, Q.top_customers(t, 10)).select("BASKET_ID", "LINE_SEQ", "CUST_CODE"))


_PR = "SELECT *, greatest(0.0, 100.0 - CASE WHEN negative > 0 THEN 20.0 ELSE 0.0 END - CASE WHEN nulls > 0 THEN 20.0 ELSE 0.0 END - CASE WHEN zero > 0 THEN 10.0 ELSE 0.0 END) AS score FROM (SELECT count(*) AS rows, count(DISTINCT product_id) AS products, count(DISTINCT store_id) AS stores, count(DISTINCT week) AS weeks, CAST(count(*) FILTER (WHERE actual_price < 0) AS BIGINT) AS negative, CAST(count(*) FILTER (WHERE actual_price = 0) AS BIGINT) AS zero, CAST(count(*) FILTER (WHERE actual_price IS NULL) AS BIGINT) AS nulls, avg(actual_price) AS mean_price, median(actual_price) AS median_price, min(actual_price) AS min_price, max(actual_price) AS max_price, avg(discount_depth) AS mean_discount, avg(promo_flag::INT) AS promo_share FROM prices)"


@register("m1_price_report", with_sql(ALL_PRICES, _PR, "mean_price, median_price, min_price, max_price, mean_discount, promo_share, score"))
def m1(spark, sf):
    return tidy(Q.price_report(P.derive_prices(tx(spark, sf))))


@register("m2_affinity_report", with_sql(AFFINITY, "SELECT count(*) AS customers, avg(loyalty_score) AS mean_loyalty, stddev_samp(loyalty_score) AS std_loyalty, avg((loyalty_score > 0.8)::INT) AS high_share, avg((loyalty_score < 0.3)::INT) AS low_share, avg((switching_rate = 0)::INT) AS never_switch_share FROM affinity", "mean_loyalty, std_loyalty, high_share, low_share, never_switch_share"))
def m2(spark, sf):
    return tidy(Q.affinity_report(A.assemble_affinity(tx(spark, sf))))


_MC = list(_TYPES.values())


@register("m3_mission_report", with_sql(MISSIONS, f"SELECT count(*) AS customers, {', '.join(f'avg({c}) AS mean_{c}' for c in _MC)}, avg((abs({' + '.join(_MC)} - 1) <= 0.01)::INT) AS valid_share FROM missions", ", ".join(f"mean_{c}" for c in _MC) + ", valid_share"))
def m3(spark, sf):
    return tidy(Q.mission_report(M.assemble_missions(tx(spark, sf)), _MC))


@register("m4_brand_report", with_sql(BRANDS + ", sz AS (SELECT pseudo_brand_id, count(*) AS size FROM brands GROUP BY ALL)", "SELECT count(*) AS brands, avg(size) AS mean_size, max(size) AS max_size, avg((size = 1)::INT) AS singleton_share, (SELECT avg((price_tier = 'premium')::INT) FROM brands) AS premium_share, (SELECT avg((price_tier = 'mid')::INT) FROM brands) AS mid_share, (SELECT avg((price_tier = 'value')::INT) FROM brands) AS value_share FROM sz", "mean_size, singleton_share, premium_share, mid_share, value_share"), shared=True)
def m4(spark, sf):
    return tidy(Q.brand_report(brands(spark, sf)))


def _check_sql(v: str, table: str, width: int) -> str:
    return f"dims AS (SELECT d, avg(x) AS m, var_pop(x) AS s2, count(*) FILTER (WHERE x IS NULL OR isnan(x) OR isinf(x)) AS bad FROM (SELECT unnest({v}) AS x, generate_subscripts({v}, 1) AS d FROM {table}) GROUP BY ALL), chk AS (SELECT (SELECT count(*) FROM {table}) AS rows, (SELECT CAST(count(*) FILTER (WHERE len({v}) <> {width}) AS BIGINT) FROM {table}) AS wrong_width, CAST(sum(bad) AS BIGINT) AS bad, CAST(count(*) FILTER (WHERE s2 < 1e-10) AS BIGINT) AS constant_dims, avg(m) AS mean, avg(sqrt(s2)) AS mean_std FROM dims)"


_SCORED = "SELECT *, greatest(0.0, 100.0 - CASE WHEN wrong_width > 0 THEN 30.0 ELSE 0.0 END - CASE WHEN bad > 0 THEN 30.0 ELSE 0.0 END - CASE WHEN constant_dims > 32 THEN 20.0 ELSE 0.0 END) AS score FROM chk"


_EMB = "emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"


def _emb(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


@register("m6_embedding_report", with_sql(f"{_EMB}, {_check_sql('vector', 'emb', 64)}, nm AS (SELECT sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM emb)", "SELECT (SELECT count(*) FROM emb) AS rows, (SELECT avg(n) FROM nm) AS mean_norm, (SELECT stddev_samp(n) FROM nm) AS std_norm, (SELECT CAST(count(*) FILTER (WHERE n = 0) AS BIGINT) FROM nm) AS zero_norm, avg(s2) AS mean_variance, CAST(count(*) FILTER (WHERE s2 < 1e-10) AS BIGINT) AS constant_dims FROM dims", "mean_norm, std_norm, mean_variance"))
def m6(spark, sf):
    return tidy(Q.embedding_report(_emb(spark, sf)))


_DRAWN = "drawn AS (SELECT vector, row_number() OVER (ORDER BY md5('4:' || vec_id), vec_id) - 1 AS nth FROM emb WHERE (('0x' || substr(md5('4:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.5)"


@register("m6_pair_distance", with_sql(f"{_EMB}, {_DRAWN}", "SELECT count(*) AS pairs, avg(list_distance(a.vector, b.vector)) AS mean_distance FROM drawn a JOIN drawn b ON b.nth = a.nth + 1 WHERE a.nth % 2 = 0", "mean_distance"))
def m6_pairs(spark, sf):
    return tidy(Q.mean_pair_distance(_emb(spark, sf), "vec_id", "vector", 0.5))


@register("m8_vector_check", with_sql(f"{_EMB}, {_check_sql('vector', 'emb', 64)}", _SCORED, "mean, mean_std, score"))
def m8(spark, sf):
    return tidy(Q.vector_check(_emb(spark, sf), 64))
