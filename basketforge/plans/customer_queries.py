"""Queries over customers: affinity and missions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketforge.functions.columns import tidy
from basketforge.operators import affinity as A
from basketforge.operators import missions as M
from basketforge.plans.registry import register
from basketforge.plans.shared_sql import ALL_VISITS, KNOWN, TX, with_sql
from basketforge.sources.transactions import transactions as tx

_PRIMARY = "prim AS (SELECT customer_id, arg_min(store_id, (-visit_count, store_id)) AS primary_store, max(visit_count) AS primary_store_visits, max(visit_count) / sum(visit_count) AS primary_store_share FROM visits GROUP BY ALL)"
_HHI = "hhi AS (SELECT customer_id, sum(s * s) AS loyalty_score FROM (SELECT customer_id, visit_count / sum(visit_count) OVER (PARTITION BY customer_id) AS s FROM visits) GROUP BY ALL)"
_SWITCH = """weeks AS (SELECT CUST_CODE AS customer_id, SHOP_WEEK AS week, list(DISTINCT STORE_CODE) AS stores FROM known GROUP BY ALL),
prior AS (SELECT *, flatten(list(stores) OVER (PARTITION BY customer_id ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS before, row_number() OVER (PARTITION BY customer_id ORDER BY week) AS n FROM weeks),
sw AS (SELECT customer_id, CAST(count(*) FILTER (WHERE n > 1 AND len(list_filter(stores, lambda x: NOT list_contains(before, x))) > 0) AS BIGINT) AS switch_count, count(*) AS k FROM prior GROUP BY ALL),
switching AS (SELECT customer_id, switch_count / greatest(k - 1, 1) AS switching_rate, switch_count, CASE WHEN k < 2 THEN k ELSE k - 1 END AS total_weeks FROM sw)"""
_CONC = "conc AS (SELECT customer_id, sum(visit_count) FILTER (WHERE r <= 3) / sum(visit_count) AS visit_concentration FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY visit_count DESC, store_id) AS r FROM visits) GROUP BY ALL)"
_TENURE = "tenure AS (SELECT customer_id, count(*) AS total_stores_visited, CAST(max(last_visit_week) - min(first_visit_week) + 1 AS BIGINT) AS tenure_weeks, sum(total_spend) AS total_spend FROM visits GROUP BY ALL)"
_REG = "reg AS (SELECT CUST_CODE AS customer_id, count(DISTINCT STORE_REGION) AS region_diversity FROM known GROUP BY ALL)"
AFFINITY = f"{ALL_VISITS}, {_PRIMARY}, {_HHI}, {_SWITCH}, {_CONC}, {_TENURE}, {_REG}, affinity AS (SELECT customer_id, primary_store, loyalty_score, switching_rate, region_diversity, total_stores_visited, visit_concentration, primary_store_share, tenure_weeks, total_spend FROM prim JOIN hhi USING (customer_id) JOIN switching USING (customer_id) JOIN reg USING (customer_id) JOIN tenure USING (customer_id) JOIN conc USING (customer_id))"


@register("d7_customer_store_visits", with_sql(ALL_VISITS, "SELECT * FROM visits", "total_spend, total_items"))
def d7(spark, sf):
    return tidy(A.customer_store_visits(tx(spark, sf)))


@register("d8_primary_store", with_sql(f"{ALL_VISITS}, {_PRIMARY}", "SELECT * FROM prim", "primary_store_share"))
def d8(spark, sf):
    return tidy(A.primary_store(A.customer_store_visits(tx(spark, sf))))


@register("d9_loyalty_hhi", with_sql(f"{ALL_VISITS}, {_HHI}", "SELECT * FROM hhi", "loyalty_score"))
def d9(spark, sf):
    return tidy(A.loyalty_hhi(A.customer_store_visits(tx(spark, sf))))


@register("d10_region_diversity", with_sql(f"{TX}, {KNOWN}", "SELECT CUST_CODE AS customer_id, count(DISTINCT STORE_REGION) AS region_diversity, string_agg(DISTINCT STORE_REGION, ',' ORDER BY STORE_REGION) AS regions_visited FROM known GROUP BY ALL"))
def d10(spark, sf):
    return tidy(A.region_diversity(tx(spark, sf)).withColumn("regions_visited", F.array_join("regions_visited", ",")))


@register("d11_visit_concentration", with_sql(f"{ALL_VISITS}, {_CONC}", "SELECT * FROM conc", "visit_concentration"))
def d11(spark, sf):
    return tidy(A.visit_concentration(A.customer_store_visits(tx(spark, sf))))


@register("d12_tenure_spend", with_sql(f"{ALL_VISITS}, {_TENURE}", "SELECT * FROM tenure", "total_spend"))
def d12(spark, sf):
    return tidy(A.tenure_spend(A.customer_store_visits(tx(spark, sf))))


@register("e3_switching_rate", with_sql(f"{TX}, {KNOWN}, {_SWITCH}", "SELECT * FROM switching", "switching_rate"))
def e3(spark, sf):
    return tidy(A.switching_rate(tx(spark, sf)))


@register("c2_additional_affinity", with_sql(f"{ALL_VISITS}, {_CONC}, {_TENURE}", "SELECT * FROM tenure JOIN conc USING (customer_id)", "total_spend, visit_concentration"))
def c2(spark, sf):
    return tidy(A.additional_affinity(A.customer_store_visits(tx(spark, sf))))


@register("c1_affinity", with_sql(AFFINITY, "SELECT * FROM affinity", "loyalty_score, switching_rate, visit_concentration, primary_store_share, total_spend"))
def c1(spark, sf):
    return tidy(A.assemble_affinity(tx(spark, sf)))


_BASKETS = """baskets AS (SELECT CUST_CODE, BASKET_ID, arg_min(BASKET_TYPE, LINE_SEQ) AS BASKET_TYPE, arg_min(BASKET_DOMINANT_MISSION, LINE_SEQ) AS BASKET_DOMINANT_MISSION,
  arg_min(BASKET_PRICE_SENSITIVITY, LINE_SEQ) AS BASKET_PRICE_SENSITIVITY, arg_min(BASKET_SIZE, LINE_SEQ) AS BASKET_SIZE, arg_min(SHOP_WEEK, LINE_SEQ) AS SHOP_WEEK, sum(QUANTITY) AS QUANTITY, sum(SPEND) AS SPEND FROM known GROUP BY ALL)"""
BASKETS = f"{TX}, {KNOWN}, {_BASKETS}"
_TRIPS = "kept AS (SELECT * FROM baskets WHERE CUST_CODE IN (SELECT CUST_CODE FROM baskets GROUP BY 1 HAVING count(*) >= 2))"


def _dist(column: str, labels: list[str], prefix: str, names: tuple[str, str, str], cte: str) -> str:
    dominant, spread, _ = names
    n = [f"count(*) FILTER (WHERE {column} = '{v}')" for v in labels]
    shares = ", ".join(f"{x} / count(*) AS p{k}" for k, x in enumerate(n))
    top = " ".join(f"WHEN p{k} = greatest({', '.join(f'p{j}' for j in range(len(labels)))}) THEN '{v}'" for k, v in enumerate(labels))
    ent = " ".join(f"- CASE WHEN p{k} > 0 THEN p{k} * ln(p{k}) ELSE 0 END" for k in range(len(labels)))
    out = ", ".join(f"p{k} AS {prefix}{M.safe_name(v)}" for k, v in enumerate(labels))
    return f"{cte} AS (SELECT customer_id, CASE {top} END AS {dominant}, 0 {ent} AS {spread}, {out} FROM (SELECT CUST_CODE AS customer_id, {shares} FROM kept WHERE {column} IS NOT NULL GROUP BY ALL))"


_TYPE = _dist("BASKET_TYPE", M.MISSION_TYPES, "p_mission_", ("dominant_mission_type", "mission_type_entropy", ""), "mtype")
_FOCUS = _dist("BASKET_DOMINANT_MISSION", M.MISSION_FOCUSES, "p_focus_", ("dominant_focus", "focus_entropy", ""), "mfocus")
_LEVEL = "CASE BASKET_PRICE_SENSITIVITY WHEN 'LA' THEN 0.0::DOUBLE WHEN 'MM' THEN 0.5::DOUBLE WHEN 'UM' THEN 1.0::DOUBLE END"
_SIZE = "CASE BASKET_SIZE WHEN 'S' THEN 0.33::DOUBLE WHEN 'M' THEN 0.67::DOUBLE WHEN 'L' THEN 1.0::DOUBLE END"
_SENS = f"""sens AS (SELECT CUST_CODE AS customer_id, avg({_LEVEL}) AS mean_price_sensitivity, coalesce(stddev_samp({_LEVEL}), 0) AS sensitivity_volatility, any_value(typical) AS typical_sensitivity
  FROM kept JOIN (SELECT CUST_CODE, arg_min(s, (-n, s)) AS typical FROM (SELECT CUST_CODE, BASKET_PRICE_SENSITIVITY AS s, count(*) AS n FROM kept GROUP BY ALL) GROUP BY ALL) USING (CUST_CODE) GROUP BY ALL)"""
_TEND = f"""tend AS (SELECT CUST_CODE AS customer_id, avg({_SIZE}) AS mean_basket_size, coalesce(var_samp({_SIZE}), 0) AS basket_size_variance, count(DISTINCT BASKET_ID) AS total_trips, avg(QUANTITY) AS avg_items_per_trip, avg(SPEND) AS avg_spend_per_trip,
  avg((BASKET_SIZE = 'S')::INT) AS p_size_s, avg((BASKET_SIZE = 'M')::INT) AS p_size_m, avg((BASKET_SIZE = 'L')::INT) AS p_size_l FROM kept GROUP BY ALL)"""
_P_TYPE = ", ".join("p_mission_" + M.safe_name(v) for v in M.MISSION_TYPES)
_P_FOCUS = ", ".join("p_focus_" + M.safe_name(v) for v in M.MISSION_FOCUSES)
MISSIONS = f"""{BASKETS}, {_TRIPS}, {_TYPE}, {_FOCUS}, {_SENS}, {_TEND}, pat AS (SELECT * FROM mtype JOIN mfocus USING (customer_id) JOIN sens USING (customer_id) JOIN tend USING (customer_id)),
missions AS (SELECT pat.*, 1 - (mission_type_entropy / (a + 1e-6) + focus_entropy / (b + 1e-6) + sensitivity_volatility / (c + 1e-6) + basket_size_variance / (d + 1e-6)) / 4 AS mission_consistency
  FROM pat, (SELECT max(mission_type_entropy) AS a, max(focus_entropy) AS b, max(sensitivity_volatility) AS c, max(basket_size_variance) AS d FROM pat))"""


def _kept(spark, sf):
    return M.min_trips(M.customer_baskets(tx(spark, sf)), 2)


@register("d13_customer_baskets", with_sql(BASKETS, "SELECT * FROM baskets", "QUANTITY, SPEND"))
def d13(spark, sf):
    return tidy(M.customer_baskets(tx(spark, sf)))


@register("c5_min_trips", with_sql(f"{BASKETS}, {_TRIPS}", "SELECT CUST_CODE, BASKET_ID FROM kept"))
def c5(spark, sf):
    return tidy(_kept(spark, sf).select("CUST_CODE", "BASKET_ID"))


@register("b6_ordinals", with_sql(BASKETS, f"SELECT CUST_CODE, BASKET_ID, {_LEVEL} AS sensitivity, {_SIZE} AS size FROM baskets"))
def b6(spark, sf):
    return M.customer_baskets(tx(spark, sf)).select("CUST_CODE", "BASKET_ID", M.ordinal("BASKET_PRICE_SENSITIVITY", M.SENSITIVITY).alias("sensitivity"), M.ordinal("BASKET_SIZE", M.SIZES).alias("size"))


@register("d14_mission_types", with_sql(f"{BASKETS}, {_TRIPS}, {_TYPE}", "SELECT * FROM mtype", f"mission_type_entropy, {_P_TYPE}"))
def d14(spark, sf):
    return tidy(M.mission_type_dist(_kept(spark, sf)).drop("mission_type_dist"))


@register("d15_mission_focuses", with_sql(f"{BASKETS}, {_TRIPS}, {_FOCUS}", "SELECT * FROM mfocus", f"focus_entropy, {_P_FOCUS}"))
def d15(spark, sf):
    return tidy(M.mission_focus_dist(_kept(spark, sf)).drop("mission_focus_dist"))


@register("d16_price_sensitivity", with_sql(f"{BASKETS}, {_TRIPS}, {_SENS}", "SELECT * FROM sens", "mean_price_sensitivity, sensitivity_volatility"))
def d16(spark, sf):
    return tidy(M.price_sensitivity(_kept(spark, sf)))


@register("d17_basket_sizes", with_sql(f"{BASKETS}, {_TRIPS}, {_TEND}", "SELECT * FROM tend", "mean_basket_size, basket_size_variance, avg_items_per_trip, avg_spend_per_trip, p_size_s, p_size_m, p_size_l"))
def d17(spark, sf):
    return tidy(M.basket_size_tendency(_kept(spark, sf)))


@register("d18_mission_consistency", with_sql(MISSIONS, "SELECT customer_id, mission_consistency FROM missions", "mission_consistency"))
def d18(spark, sf):
    return tidy(M.assemble_missions(tx(spark, sf)).select("customer_id", "mission_consistency"))


_DOUBLES = f"mission_type_entropy, {_P_TYPE}, focus_entropy, {_P_FOCUS}, mean_price_sensitivity, sensitivity_volatility, mean_basket_size, basket_size_variance, avg_items_per_trip, avg_spend_per_trip, p_size_s, p_size_m, p_size_l, mission_consistency"


@register("c1_missions", with_sql(MISSIONS, "SELECT * FROM missions", _DOUBLES), shared=True)
def c1_missions(spark, sf):
    return tidy(M.assemble_missions(tx(spark, sf)).drop("mission_type_dist", "mission_focus_dist"))


@register("h12_distribution_json", with_sql(f"{BASKETS}, {_TRIPS}, {_TYPE}", "SELECT customer_id, p_mission_full_shop AS full_shop, CAST(4 AS BIGINT) AS labels FROM mtype", "full_shop"))
def h12(spark, sf):
    """Reads the JSON document back."""
    parsed = F.from_json("mission_type_dist", "map<string,double>")
    return tidy(M.mission_type_dist(_kept(spark, sf)).select("customer_id", parsed["Full Shop"].alias("full_shop"), F.size(parsed).alias("labels")))


@register("h13_entropy", with_sql(f"{BASKETS}, {_TRIPS}, {_TYPE}, {_FOCUS}", "SELECT customer_id, mission_type_entropy, focus_entropy FROM mtype JOIN mfocus USING (customer_id)", "mission_type_entropy, focus_entropy"))
def h13(spark, sf):
    kept = _kept(spark, sf)
    return tidy(M.mission_type_dist(kept).select("customer_id", "mission_type_entropy").join(M.mission_focus_dist(kept).select("customer_id", "focus_entropy"), "customer_id"))


def _h(column: str, labels: list[str]) -> str:
    return " ".join(f"- avg(({column} = '{v}')::INT) * ln(avg(({column} = '{v}')::INT) + 1e-10)" for v in labels)


@register(
    "d33_trip_stats",
    with_sql(
        BASKETS,
        f"SELECT *, 1 / (1 + type_entropy + focus_entropy) AS consistency FROM (SELECT CUST_CODE AS customer_id, avg({_LEVEL}) AS mean_sensitivity, stddev_pop({_LEVEL}) / 2 AS sensitivity_spread, avg({_SIZE}) AS mean_size, stddev_pop({_SIZE}) / 2 AS size_spread, count(*) AS trips, "
        f"0 {_h('BASKET_TYPE', M.MISSION_TYPES)} AS type_entropy, 0 {_h('BASKET_DOMINANT_MISSION', M.MISSION_FOCUSES)} AS focus_entropy FROM baskets GROUP BY ALL)",
        "mean_sensitivity, sensitivity_spread, mean_size, size_spread, type_entropy, focus_entropy, consistency",
    ),
)
def d33(spark, sf):
    return tidy(M.trip_stats(M.customer_baskets(tx(spark, sf))))


@register("d29_trip_counts", with_sql(f"{TX}, {KNOWN}", "SELECT CUST_CODE AS customer_id, count(DISTINCT BASKET_ID) AS trips FROM known GROUP BY ALL"))
def d29(spark, sf):
    return tidy(A.known_customers(tx(spark, sf)).groupBy(F.col("CUST_CODE").alias("customer_id")).agg(F.count_distinct("BASKET_ID").alias("trips")))


@register("d32_customer_segments", with_sql(f"{TX}, {KNOWN}", "SELECT CUST_CODE AS customer_id, coalesce(min(seg_1), 'UNK') AS seg_1, coalesce(min(seg_2), 'UNK') AS seg_2 FROM known GROUP BY ALL"))
def d32(spark, sf):
    first = [F.coalesce(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("BASKET_ID", "LINE_SEQ"))), F.lit("UNK")).alias(c) for c in ("seg_1", "seg_2")]
    return tidy(A.known_customers(tx(spark, sf)).groupBy(F.col("CUST_CODE").alias("customer_id")).agg(*first))


@register("b9_fill_defaults", with_sql(f"{AFFINITY}, b AS (SELECT DISTINCT 'C' || o_custkey AS customer_id FROM orders)", "SELECT customer_id, coalesce(loyalty_score, 1.0) AS loyalty_score, coalesce(switching_rate, 0.0) AS switching_rate, coalesce(region_diversity, 1) AS region_diversity FROM b LEFT JOIN affinity USING (customer_id)", "loyalty_score, switching_rate"))
def b9(spark, sf):
    everyone = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_id")).distinct()
    df = everyone.join(A.assemble_affinity(tx(spark, sf)), "customer_id", "left").select("customer_id", "loyalty_score", "switching_rate", "region_diversity")
    return tidy(A.fill_defaults(df, {"loyalty_score": 1.0, "switching_rate": 0.0, "region_diversity": 1}))
