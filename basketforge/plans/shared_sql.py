"""SQL of the tables that many queries share, for the other engine."""

TX = """tx AS (
  SELECT l_orderkey AS BASKET_ID,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS LINE_SEQ,
    CASE WHEN o_custkey % 20 <> 0 THEN 'C' || o_custkey END AS CUST_CODE,
    p_brand || '|' || p_type AS PROD_CODE, p_brand AS PROD_CODE_10, 'DEP' || (bn % 10) AS PROD_CODE_20, 'G' || (bn % 5) AS PROD_CODE_30,
    CASE WHEN bn % 5 < 2 THEN 'D0' ELSE 'D1' END AS PROD_CODE_40,
    'ST' || st AS STORE_CODE, 'R' || (st % 5) AS STORE_REGION, CASE st % 3 WHEN 0 THEN 'LS' WHEN 1 THEN 'MS' ELSE 'SS' END AS STORE_FORMAT,
    CAST(year(o_orderdate) * 100 + floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS BIGINT) AS SHOP_WEEK,
    CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS SHOP_DATE, isodow(o_orderdate) AS SHOP_WEEKDAY, 8 + o_orderkey % 14 AS SHOP_HOUR,
    l_quantity AS QUANTITY, l_extendedprice / 100 AS SPEND,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Emergency' WHEN '2-HIGH' THEN 'Small Shop' WHEN '4-NOT SPECIFIED' THEN 'Full Shop' ELSE 'Top Up' END AS BASKET_TYPE,
    CASE o_orderstatus WHEN 'O' THEN 'Fresh' WHEN 'F' THEN 'Grocery' WHEN 'P' THEN 'Mixed' END AS BASKET_DOMINANT_MISSION,
    CASE WHEN o_totalprice < 163000 THEN 'LA' WHEN o_totalprice < 335000 THEN 'MM' ELSE 'UM' END AS BASKET_PRICE_SENSITIVITY,
    CASE WHEN nl <= 4 THEN 'S' WHEN nl <= 6 THEN 'M' ELSE 'L' END AS BASKET_SIZE,
    substr(c_mktsegment, 1, 2) AS seg_1, 'N' || c_nationkey AS seg_2
  FROM (SELECT *, CAST(substr(p_brand, 7) AS INTEGER) AS bn, (o_custkey + o_orderkey % 3) % 25 AS st, count(*) OVER (PARTITION BY l_orderkey) AS nl
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey)
)"""

UNIT = """unit AS (SELECT *, SPEND / QUANTITY AS unit_price FROM tx WHERE QUANTITY > 0),
priced AS (SELECT * FROM unit WHERE unit_price > 0.01 AND unit_price < 100)"""

ACTUAL = """actual AS (
  SELECT PROD_CODE AS product_id, STORE_CODE AS store_id, SHOP_WEEK AS week, median(unit_price) AS actual_price, count(*) AS transaction_count,
    sum(QUANTITY) AS total_quantity, sum(SPEND) AS total_spend, coalesce(stddev_samp(unit_price), 0) AS price_std
  FROM priced GROUP BY ALL)"""

BASE = """based AS (
  SELECT *, greatest(actual_price, max(actual_price) OVER (PARTITION BY product_id, store_id ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS base_price FROM actual),
promo AS (
  SELECT *, greatest(0.0, least(0.7, 1 - actual_price / base_price)) AS discount_depth, greatest(0.0, least(0.7, 1 - actual_price / base_price)) > 0.05 AS promo_flag FROM based)"""

PRICES = """flagged AS (
  SELECT *, coalesce(stddev_samp(actual_price) OVER w / avg(actual_price) OVER w > 0.5, false) AS volatile FROM promo
  WINDOW w AS (PARTITION BY product_id, store_id)),
texted AS (
  SELECT *, concat_ws('|', CASE WHEN actual_price <= 0 THEN 'negative_price' END, CASE WHEN actual_price > 100 THEN 'price_too_high' END,
    CASE WHEN discount_depth > 0.7 THEN 'excessive_discount' END, CASE WHEN volatile THEN 'high_volatility' END) AS validation_flags FROM flagged),
prices AS (
  SELECT product_id, store_id, week, actual_price, base_price, discount_depth, promo_flag, 'observed' AS imputation_method,
    greatest(0.0, least(1.0, 1.0 - CASE WHEN transaction_count < 3 THEN 0.2 ELSE 0.0 END - 0.1 * least(0.3, price_std / actual_price)
      - CASE WHEN validation_flags <> '' THEN 0.2 ELSE 0.0 END)) AS quality_score,
    validation_flags, transaction_count, total_quantity, price_std
  FROM texted)"""

ALL_PRICES = f"{TX},\n{UNIT},\n{ACTUAL},\n{BASE},\n{PRICES}"

KNOWN = "known AS (SELECT * FROM tx WHERE CUST_CODE IS NOT NULL)"

VISITS = """visits AS (
  SELECT CUST_CODE AS customer_id, STORE_CODE AS store_id, count(DISTINCT BASKET_ID) AS visit_count, sum(SPEND) AS total_spend, sum(QUANTITY) AS total_items,
    min(SHOP_WEEK) AS first_visit_week, max(SHOP_WEEK) AS last_visit_week FROM known GROUP BY ALL)"""
ALL_VISITS = f"{TX},\n{KNOWN},\n{VISITS}"


def rounded(select: str, doubles: str, digits: int = 6) -> str:
    """``select`` with the named columns (comma-separated) rounded."""
    changed = ", ".join(f"floor(CAST({c.strip()} AS DOUBLE) * {10**digits} + 0.5001) / {10**digits} AS {c.strip()}" for c in doubles.split(","))
    return f"SELECT * REPLACE ({changed}) FROM ({select})"


def with_sql(ctes: str, select: str, doubles: str = "", digits: int = 6) -> str:
    return f"WITH {ctes}\n" + (rounded(select, doubles, digits) if doubles else select)


def spelled_sql(v: str, digits: int = 6) -> str:
    """All numbers of a vector as text, as ``functions.columns.spelled`` writes them."""
    return f"array_to_string(list_transform({v}, lambda x: CAST(floor(x * {10**digits} + 0.5001::DOUBLE) AS BIGINT)), ',')"
