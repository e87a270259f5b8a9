"""Queries over price and store features. Arrays are told by their sum and by their sum weighted by place."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketforge.functions.columns import spelled, tidy
from basketforge.operators import affinity as A
from basketforge.operators import price_features as X
from basketforge.operators import pricing as P
from basketforge.operators import stores as S
from basketforge.plans.customer_queries import AFFINITY
from basketforge.plans.registry import register
from basketforge.plans.shared_sql import ALL_PRICES, TX, spelled_sql, with_sql
from basketforge.sources.transactions import transactions as tx

KEY = "product_id, store_id, week"


def told(values: str | Column, digits: int = 4) -> Column:
    """Every number of a vector, in units of 10^-digits."""
    return spelled(values, digits).alias("vector")


def told_sql(v: str, digits: int = 4) -> str:
    return f"{spelled_sql(v, digits)} AS vector"


def _pad(v: str, width: int) -> str:
    return f"list_resize({v}, {width}, 0.0::DOUBLE)"


def _list(*x: str) -> str:
    return "[" + ", ".join(f"CAST({y} AS DOUBLE)" for y in x) + "]"


_W = [(f"sin(p * {2 * pi * f!r})", f"cos(p * {2 * pi * f!r})") for f in X.FREQUENCIES]
_FLAT = [x for w in _W for x in w]
FOURIER = _list(*_FLAT, *(x for s, c in _W[:4] for x in (f"{s} * {c}", f"{s} * {s}")))
_LA, _LB = "ln(actual_price + 1e-6)", "ln(base_price + 1e-6)"
_POW = lambda a: [f"pow({a}, {i % 3 + 1}) * {(-1) ** i}" for i in range(8)]
_BANDS = lambda r: [f"({r} > 1.3)::INT", f"({r} < 0.7)::INT", f"({r} >= 0.7 AND {r} <= 1.3)::INT"]
_LOGS = f"logs AS (SELECT {KEY}, {_list('a', 'b', 'b - a', '(a - ma) / (sa + 1e-6)', '(b - mb) / (sb + 1e-6)', 'a * a', 'exp(-a)', 'tanh(a)', *_POW('a'))} AS log_features FROM (SELECT {KEY}, {_LA} AS a, {_LB} AS b FROM prices), (SELECT avg({_LA}) AS ma, stddev_pop({_LA}) AS sa, avg({_LB}) AS mb, stddev_pop({_LB}) AS sb FROM prices))"
_WEEKLY = "weekly AS (SELECT substr(product_id, 1, 7) AS category, week, avg(actual_price) AS week_mean, stddev_samp(actual_price) AS week_std, min(actual_price) AS week_min, max(actual_price) AS week_max, count(*) AS week_count FROM prices GROUP BY ALL)"
_EXP = "expanding AS (SELECT category, week, sum(week_mean * week_count) OVER w / sum(week_count) OVER w AS expanding_avg, coalesce(stddev_samp(week_mean) OVER w, avg(week_mean) OVER w * 0.1) AS expanding_std, min(week_min) OVER w AS expanding_min, max(week_max) OVER w AS expanding_max FROM weekly WINDOW w AS (PARTITION BY category ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
_REL = f"rel AS (SELECT {KEY}, {_list('ratio', 'z', 'place', *_BANDS('ratio'), 'ln(ratio + 1e-6)', 'ratio * ratio', *(f'sin(place * {pi * k!r})' for k in range(1, 9)))} AS relative_features FROM (SELECT product_id, store_id, prices.week, actual_price / (expanding_avg + 1e-6) AS ratio, (actual_price - expanding_avg) / (expanding_std + 1e-6) AS z, (actual_price - expanding_min) / (expanding_max - expanding_min + 1e-6) AS place FROM prices JOIN expanding ON category = substr(product_id, 1, 7) AND expanding.week = prices.week))"
_VEL = f"""vel0 AS (SELECT {KEY}, actual_price, coalesce(lag(actual_price) OVER (PARTITION BY product_id, store_id ORDER BY week), actual_price) AS prior FROM prices),
vel1 AS (SELECT *, greatest(-1.0, least(1.0, (actual_price - prior) / (prior + 1e-6))) AS velocity FROM vel0),
vel AS (SELECT *, greatest(-1.0, least(1.0, velocity - coalesce(lag(velocity) OVER (PARTITION BY product_id, store_id ORDER BY week), 0.0))) AS acceleration FROM vel1),
velf AS (SELECT {KEY}, {_list('velocity', 'acceleration', '(velocity < -0.05)::INT', '(velocity > 0.05)::INT', '(velocity < -0.05)::INT', '(velocity >= -0.05 AND velocity <= 0.05)::INT', 'abs(velocity)', 'velocity * velocity')} AS velocity_features FROM vel)"""
FEATURES = f"{ALL_PRICES}, {_LOGS}, {_WEEKLY}, {_EXP}, {_REL}, {_VEL}, pf AS (SELECT product_id, store_id, week, list_concat(list_concat({FOURIER.replace('(p *', '(actual_price *')}, log_features), list_concat(relative_features, velocity_features)) AS features FROM prices JOIN logs USING ({KEY}) JOIN rel USING ({KEY}) JOIN velf USING ({KEY}))"


def _prices(spark, sf):
    return P.derive_prices(tx(spark, sf))


@register("h1_fourier", with_sql(ALL_PRICES, f"SELECT {KEY}, {told_sql('v')} FROM (SELECT {KEY}, {FOURIER.replace('(p *', '(actual_price *')} AS v FROM prices)"))
def h1(spark, sf):
    return tidy(_prices(spark, sf).select(*P.CELL, told(X.fourier_features(F.col("actual_price")))), 5)


@register("h2_log_features", with_sql(f"{ALL_PRICES}, {_LOGS}", f"SELECT {KEY}, {told_sql('log_features')} FROM logs"))
def h2(spark, sf):
    return tidy(X.log_features(_prices(spark, sf)).select(*P.CELL, told("log_features")), 5)


_ITEM_LOG = _pad(_list("a", "b", "b - a", "a * a", "exp(-a)", "tanh(a)", "a * b", "abs(b - a)"), 16)


@register("h3_log_features_item", with_sql(ALL_PRICES, f"SELECT {KEY}, {told_sql('v')} FROM (SELECT {KEY}, {_ITEM_LOG} AS v FROM (SELECT *, {_LA} AS a, {_LB} AS b FROM prices))"))
def h3(spark, sf):
    return tidy(_prices(spark, sf).select(*P.CELL, told(X.log_features_item(F.col("actual_price"), F.col("base_price")))), 5)


@register("d20_weekly_category_prices", with_sql(f"{ALL_PRICES}, {_WEEKLY}", "SELECT * FROM weekly", "week_mean, week_std, week_min, week_max"))
def d20(spark, sf):
    return tidy(X.weekly_category_prices(_prices(spark, sf)))


@register("e7_expanding_prices", with_sql(f"{ALL_PRICES}, {_WEEKLY}, {_EXP}", "SELECT * FROM expanding", "expanding_avg, expanding_std, expanding_min, expanding_max"))
def e7(spark, sf):
    return tidy(X.expanding_category_prices(X.weekly_category_prices(_prices(spark, sf))))


@register("h4_relative_features", with_sql(f"{ALL_PRICES}, {_WEEKLY}, {_EXP}, {_REL}", f"SELECT {KEY}, {told_sql('relative_features')} FROM rel"))
def h4(spark, sf):
    return tidy(X.relative_features(_prices(spark, sf)).select(*P.CELL, told("relative_features")), 4)


_ITEM_REL = _list("r", "ln(r + 1e-6)", "r * r", *_BANDS("r"), f"sin(least(r, 2.0) * {pi!r})", f"cos(least(r, 2.0) * {pi!r})", *_POW("r"))


@register("h5_relative_features_item", with_sql(ALL_PRICES, f"SELECT {KEY}, {told_sql('v')} FROM (SELECT {KEY}, {_ITEM_REL} AS v FROM (SELECT *, actual_price / (base_price + 1e-6) AS r FROM prices))"))
def h5(spark, sf):
    return tidy(_prices(spark, sf).select(*P.CELL, told(X.relative_features_item(F.col("actual_price"), F.col("base_price")))), 5)


@register("e8_price_velocity", with_sql(f"{ALL_PRICES}, {_VEL}", f"SELECT {KEY}, velocity, acceleration FROM vel", "velocity, acceleration"))
def e8(spark, sf):
    return tidy(X.price_velocity(_prices(spark, sf)).select(*P.CELL, "velocity", "acceleration"))


@register("h6_velocity_features", with_sql(f"{ALL_PRICES}, {_VEL}", f"SELECT {KEY}, {told_sql('velocity_features')} FROM velf"))
def h6(spark, sf):
    return tidy(X.velocity_features(_prices(spark, sf)).select(*P.CELL, told("velocity_features")), 5)


_QV = "greatest(-1.0, least(1.0, (actual_price - base_price) / (base_price + 1e-6)))"
_ITEM_VEL = _list("v0", "abs(v0)", "v0 * v0", "(v0 > 0.05)::INT", "(v0 < -0.05)::INT", "(v0 >= -0.05 AND v0 <= 0.05)::INT", f"sin(v0 * {pi!r})", f"cos(v0 * {pi!r})")


@register("h6_velocity_features_item", with_sql(ALL_PRICES, f"SELECT {KEY}, {told_sql('v')} FROM (SELECT {KEY}, {_ITEM_VEL} AS v FROM (SELECT *, {_QV} AS v0 FROM prices))"))
def h6_item(spark, sf):
    return tidy(_prices(spark, sf).select(*P.CELL, told(X.velocity_features_item(F.col("actual_price"), F.col("base_price")))), 5)


_Q_LOG = _pad(_list("a", "b", "b - a", "a", "b", "a * a", "exp(-a)", "tanh(a)"), 16)
_Q_REL = _pad(_list("r", "0", "0.5", *_BANDS("r"), "ln(r + 1e-6)", "r * r"), 16)
_Q_VEL = _list("v0", "0", "(v0 < -0.05)::INT", "(v0 > 0.05)::INT", "(v0 < -0.05)::INT", "(v0 >= -0.05 AND v0 <= 0.05)::INT", "abs(v0)", "v0 * v0")
_Q = f"list_concat(list_concat({_pad(_list(*_FLAT), 24)}, {_Q_LOG}), list_concat({_Q_REL}, {_Q_VEL}))"


@register("h7_encode_quotes", with_sql(ALL_PRICES, f"SELECT {KEY}, {told_sql('v')} FROM (SELECT {KEY}, {_Q} AS v FROM (SELECT *, actual_price AS p, {_LA} AS a, {_LB} AS b, actual_price / (base_price + 1e-6) AS r, {_QV} AS v0 FROM prices))"))
def h7(spark, sf):
    quotes = _prices(spark, sf).select(*P.CELL, F.col("actual_price").alias("price"), "base_price", F.col("base_price").alias("category_avg"), F.col("base_price").alias("prior_price"))
    return tidy(X.encode_quotes(quotes).select(*P.CELL, told("features")), 5)


@register("j10_price_features", with_sql(FEATURES, f"SELECT {KEY}, {told_sql('features')} FROM pf"))
def j10(spark, sf):
    return tidy(X.price_features(_prices(spark, sf)).select(*P.CELL, told("features")), 4)


_STORES = """store_dim AS (SELECT STORE_CODE AS store_id, min(STORE_FORMAT) AS format, min(STORE_REGION) AS region, count(DISTINCT BASKET_ID) AS total_baskets, count(DISTINCT CUST_CODE) AS unique_customers, sum(SPEND) AS total_spend, sum(QUANTITY) AS total_quantity,
  min(SHOP_WEEK) AS first_week, max(SHOP_WEEK) AS last_week, count(DISTINCT SHOP_WEEK) AS active_weeks FROM tx GROUP BY ALL),
hours AS (SELECT STORE_CODE AS store_id, arg_min(h, (-n, h)) AS peak_hour FROM (SELECT STORE_CODE, SHOP_HOUR AS h, count(*) AS n FROM tx GROUP BY ALL) GROUP BY ALL),
ops AS (SELECT *, num_baskets / active_weeks AS baskets_per_week, num_customers / active_weeks AS customers_per_week, std_spend / greatest(avg_spend, 0.01::DOUBLE) AS spend_cv FROM (
  SELECT STORE_CODE AS store_id, count(DISTINCT BASKET_ID) AS num_baskets, count(DISTINCT CUST_CODE) AS num_customers, avg(SPEND) AS avg_spend, stddev_samp(SPEND) AS std_spend, avg(QUANTITY) AS avg_quantity,
    avg((SHOP_WEEKDAY IN (6, 7))::INT) AS weekend_share, avg((BASKET_SIZE = 'L')::INT) AS large_basket_share, avg((BASKET_DOMINANT_MISSION = 'Fresh')::INT) AS fresh_focus, greatest(count(DISTINCT SHOP_WEEK), 1) AS active_weeks FROM tx GROUP BY ALL) JOIN hours USING (store_id))"""
_LOYAL = "loyal AS (SELECT primary_store AS store_id, avg(loyalty_score) AS mean_loyalty, CAST(count(*) FILTER (WHERE loyalty_score > 0.8) AS BIGINT) AS loyal_customers FROM affinity GROUP BY ALL)"
_NORM = ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.5 END AS {c}_norm" for c in S.NORMALISED)
PROFILE = f"{AFFINITY}, {_STORES}, {_LOYAL}, profile AS (SELECT *, {_NORM} FROM (SELECT ops.*, coalesce(mean_loyalty, 0.5) AS mean_loyalty, coalesce(loyal_customers, 0) AS loyal_customers FROM ops LEFT JOIN loyal USING (store_id)))"
_N = [f"{c}_norm" for c in S.NORMALISED]
_OPS_VEC = _pad(_list(*_N, *(f"{_N[i]} * {_N[j]}" for i in range(10) for j in range(i + 1, min(i + 3, 10)))), 32)


def profile(spark, sf):
    t = tx(spark, sf)
    return S.store_profile(t, A.assemble_affinity(t))


@register("d21_store_dim", with_sql(f"{TX}, {_STORES}", "SELECT * FROM store_dim", "total_spend, total_quantity", 4))
def d21(spark, sf):
    return tidy(S.store_dim(tx(spark, sf)), 4)


@register("d22_store_operations", with_sql(f"{TX}, {_STORES}", "SELECT * FROM ops", "avg_spend, std_spend, avg_quantity, weekend_share, large_basket_share, fresh_focus, baskets_per_week, customers_per_week, spend_cv"))
def d22(spark, sf):
    return tidy(S.store_operations(tx(spark, sf)))


@register("d23_store_loyalty", with_sql(f"{AFFINITY}, {_LOYAL}", "SELECT * FROM loyal", "mean_loyalty"))
def d23(spark, sf):
    return tidy(S.store_loyalty(A.assemble_affinity(tx(spark, sf))))


@register("d24_minmax", with_sql(PROFILE, f"SELECT store_id, {', '.join(_N)} FROM profile", ", ".join(_N)))
def d24(spark, sf):
    return tidy(profile(spark, sf).select("store_id", *_N))


@register("h16_store_vector", with_sql(PROFILE, f"SELECT store_id, {told_sql('v')} FROM (SELECT store_id, {_OPS_VEC} AS v FROM profile)"))
def h16(spark, sf):
    return tidy(profile(spark, sf).select("store_id", told(S.operations_vector([F.col(c) for c in _N]))))


_FOUR = ["baskets_per_week_norm", "customers_per_week_norm", "spend_cv_norm", "mean_loyalty_norm"]
_s, _t, _c, _a = _FOUR
_CTX = _pad(_list(*_FOUR, *(f"1 - {x}" for x in _FOUR), *(f"{f}({x} * {pi * k!r})" for x in _FOUR for k in (1, 2) for f in ("sin", "cos")), f"{_s} * {_t}", f"{_c} * (1 - {_t})", f"{_a} * {_s}", f"{_t} * (1 - {_c})"), 32)


@register("h16_store_context_vector", with_sql(PROFILE, f"SELECT store_id, {told_sql('v')} FROM (SELECT store_id, {_CTX} AS v FROM profile)"))
def h16_context(spark, sf):
    return tidy(profile(spark, sf).select("store_id", told(S.context_vector(*(F.col(c) for c in _FOUR)))))


_AFF = ["loyalty_score", "switching_rate", "region_diversity / 10", "1 - loyalty_score"]


@register("h15_affinity_features", with_sql(AFFINITY, f"SELECT customer_id, {told_sql('v')} FROM (SELECT customer_id, {_list(*_AFF, *(f'({x}) * ({x})' for x in _AFF), *(f'sin(({x}) * {pi!r})' for x in _AFF), *(f'cos(({x}) * {pi!r})' for x in _AFF))} AS v FROM affinity)"))
def h15(spark, sf):
    from basketforge.operators.vectors import affinity_features

    return tidy(A.assemble_affinity(tx(spark, sf)).select("customer_id", told(affinity_features())))


@register("h14_blend_alpha", with_sql(f"{TX}, k AS (SELECT CUST_CODE AS customer_id, count(DISTINCT BASKET_ID) AS n FROM tx WHERE CUST_CODE IS NOT NULL GROUP BY ALL)", "SELECT customer_id, CASE WHEN n < 5 THEN 0.8::DOUBLE ELSE greatest(0.2::DOUBLE, 1 / ln(n + 1)) END AS alpha FROM k", "alpha"))
def h14(spark, sf):
    from basketforge.operators.vectors import blend_alpha

    trips = A.known_customers(tx(spark, sf)).groupBy(F.col("CUST_CODE").alias("customer_id")).agg(F.count_distinct("BASKET_ID").alias("n"))
    return tidy(trips.select("customer_id", blend_alpha(F.col("n")).alias("alpha")))
