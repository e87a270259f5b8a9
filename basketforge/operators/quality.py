"""Data-quality reports, and sampling of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.operators.quantiles import exact_quantiles
from basketforge.operators.sequences import draw, numbered
from basketforge.operators.states import SavedAggregate, counted
from basketforge.session import staged


def _share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _score(*losses: tuple[Column, float]) -> Column:
    out = F.lit(100.0)
    for when, points in losses:
        out = out - F.when(when, F.lit(points)).otherwise(0.0)
    return F.greatest(F.lit(0.0), out)


def price_report(prices: DataFrame) -> DataFrame:
    p = F.col("actual_price")
    df = prices.agg(
        F.count("*").alias("rows"), F.count_distinct("product_id").alias("products"), F.count_distinct("store_id").alias("stores"), F.count_distinct("week").alias("weeks"), _count(p < 0).alias("negative"), _count(p == 0).alias("zero"),
        _count(p.isNull()).alias("nulls"), F.avg(p).alias("mean_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.avg("discount_depth").alias("mean_discount"), _share(F.col("promo_flag")).alias("promo_share"),
    )
    # The median of the whole table comes by ranges; both tables have one row.
    median = exact_quantiles(prices, [], ["actual_price"], {"median": 0.5}).toDF("median_price")
    df = df.crossJoin(F.broadcast(median))
    return df.withColumn("score", _score((F.col("negative") > 0, 20.0), (F.col("nulls") > 0, 20.0), (F.col("zero") > 0, 10.0)))


def affinity_report(affinity: DataFrame) -> DataFrame:
    x = F.col("loyalty_score")
    return affinity.agg(F.count("*").alias("customers"), F.avg(x).alias("mean_loyalty"), F.stddev_samp(x).alias("std_loyalty"), _share(x > 0.8).alias("high_share"), _share(x < 0.3).alias("low_share"), _share(F.col("switching_rate") == 0).alias("never_switch_share"))


def mission_report(missions: DataFrame, columns: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return missions.agg(F.count("*").alias("customers"), *(F.avg(c).alias(f"mean_{c}") for c in columns), _share(F.abs(total - 1) <= 0.01).alias("valid_share"))


def brand_report(brands: DataFrame) -> DataFrame:
    sizes = brands.groupBy("pseudo_brand_id").agg(F.count("*").alias("size"))
    df = sizes.agg(F.count("*").alias("brands"), F.avg("size").alias("mean_size"), F.max("size").alias("max_size"), _share(F.col("size") == 1).alias("singleton_share"))
    tiers = brands.agg(*(_share(F.col("price_tier") == t).alias(f"{t}_share") for t in ("premium", "mid", "value")))
    return df.crossJoin(tiers)


def dimension_stats(df: DataFrame, column: str = "vector", times: str | None = None) -> DataFrame:
    """Mean, population variance and bad values of each place of a vector column; ``times``: how often each vector counts."""
    rows = df.select(F.posexplode(column).alias("dim", "x"), (F.col(times) if times else F.lit(1)).alias("n"))
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    if not times:
        return rows.groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), _count(bad).alias("bad"))
    n = F.when(F.col("x").isNotNull(), F.col("n"))
    means = rows.groupBy("dim").agg((F.sum(F.col("x") * F.col("n")) / F.sum(n)).alias("mean"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"))
    # The places of a vector are few, so their means go to where the numbers are.
    apart = F.col("x") - F.col("mean")
    variance = rows.join(F.broadcast(means), "dim").groupBy("dim").agg((F.sum(apart * apart * F.col("n")) / F.sum(n)).alias("variance"))
    return means.join(variance, "dim")


def vector_check(df: DataFrame, width: int, column: str = "vector", constant_share: float = 0.5, times: str | None = None) -> DataFrame:
    """Width, bad values, constant places (points are lost over ``constant_share`` of the width) and a score for a table of vectors; ``times`` as above."""
    dims = dimension_stats(df, column, times).agg(F.sum("bad").alias("bad"), _count(F.col("variance") < 1e-10).alias("constant_dims"), F.avg("mean").alias("mean"), F.avg(F.sqrt("variance")).alias("mean_std"))
    n = F.col(times) if times else F.lit(1)
    sizes = df.agg(F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.sum(F.when(F.size(column) != width, n).otherwise(0)).alias("wrong_width"))
    return sizes.crossJoin(dims).withColumn("score", _score((F.col("wrong_width") > 0, 30.0), (F.col("bad") > 0, 30.0), (F.col("constant_dims") > width * constant_share, 20.0)))


def price_feature_report(df: DataFrame, column: str = "features", width: int = 64, fourier: int = 24) -> DataFrame:
    """``vector_check`` with points lost over a tenth of constant places, and the bounds of the Fourier places."""
    places = F.slice(column, 1, fourier)
    bounds = df.agg(F.max(F.array_max(places)).alias("fourier_max"), F.min(F.array_min(places)).alias("fourier_min"))
    return vector_check(df, width, column, 0.1).crossJoin(bounds)


def store_report(stores: DataFrame, width: int = 96) -> DataFrame:
    """``stores`` (format, vector): number, nulls, mean and deviation of all numbers, formats as JSON, and a score."""
    numbers = stores.select(F.explode("vector").alias("x")).agg(_count(F.col("x").isNull()).alias("nulls"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    sizes = stores.agg(F.count("*").alias("stores"), _count(F.size("vector") != width).alias("wrong_width"))
    formats = stores.groupBy("format").agg(F.count("*").alias("n"))
    listed = formats.agg(F.array_sort(F.collect_list(F.struct("format", "n"))).alias("l")).select(F.to_json(F.map_from_entries("l")).alias("formats"))
    return sizes.crossJoin(numbers).crossJoin(listed).withColumn("score", _score((F.col("nulls") > 0, 30.0), (F.col("wrong_width") > 0, 20.0)))


def customer_embedding_report(df: DataFrame, width: int = 160) -> DataFrame:
    """``df`` (customer_id, vector, trips): norms, variances, mean trips, cold-start customers (fewer than 5 trips) and a score."""
    trips = df.agg(F.avg("trips").alias("mean_trips"), _count(F.col("trips") < 5).alias("cold_start"), _count(F.exists("vector", lambda x: x.isNull() | F.isnan(x))).alias("bad_rows"))
    report = embedding_report(df.select("customer_id", "vector")).crossJoin(trips)
    return report.withColumn("score", _score((F.col("bad_rows") > 0, 30.0), (F.col("constant_dims") > width * 0.1, 20.0)))


def embedding_report(df: DataFrame, column: str = "vector", share: float = 1.0, seed: int = 2) -> DataFrame:
    """Norms, mean variance of the places, and zero vectors; ``share`` samples rows by a seeded hash."""
    rows = df if share >= 1 else df.where(draw(F.lit(seed), F.col(df.columns[0])) < share)
    size = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))
    norms = rows.select(size.alias("norm")).agg(F.count("*").alias("rows"), F.avg("norm").alias("mean_norm"), F.stddev_samp("norm").alias("std_norm"), _count(F.col("norm") == 0).alias("zero_norm"))
    return norms.crossJoin(dimension_stats(rows, column).agg(F.avg("variance").alias("mean_variance"), _count(F.col("variance") < 1e-10).alias("constant_dims")))


def mean_pair_distance(df: DataFrame, key: str, column: str, share: float, seed: int = 4) -> DataFrame:
    """Mean distance of drawn pairs: the sampled rows in a seeded order, the first with the second, the third with the fourth and so on.

    The order is numbered by ranges, and the two rows of a number meet in a partial
    aggregate, so tasks are as even as the hash.
    """
    drawn = df.where(draw(F.lit(seed), F.col(key)) < share).select(key, F.col(column).alias("v"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("drawn"))
    pairs = numbered(drawn, ["drawn", key]).withColumn("pair", F.floor(F.col("nth") / 2)).groupBy("pair")
    both = pairs.agg(F.max(F.when(F.col("nth") % 2 == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("nth") % 2 == 1, F.col("v"))).alias("b")).where("a is not null and b is not null")
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return both.agg(F.count("*").alias("pairs"), F.avg(gap).alias("mean_distance"))


def affinity_score(affinity: DataFrame) -> DataFrame:
    """No points without customers; 20 are lost if any lacks a loyalty score."""
    nulls = _count(F.col("loyalty_score").isNull())
    return affinity.agg(F.when(F.count("*") == 0, 0.0).otherwise(_score((nulls > 0, 20.0))).alias("score"))


def mission_score(missions: DataFrame, columns: list[str]) -> DataFrame:
    """No points without customers; 30 are lost unless 95 % have shares that add up to 1."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    valid = _share(F.abs(total - 1) <= 0.01)
    return missions.agg(F.when(F.count("*") == 0, 0.0).otherwise(_score((valid < 0.95, 30.0))).alias("score"))


def brand_score(brands: DataFrame) -> DataFrame:
    """20 points are lost if most brands have one product, and 20 if there are fewer than ten."""
    return brand_report(brands).select(_score((F.col("singleton_share") > 0.5, 20.0), (F.col("brands") < 10, 20.0)).alias("score"))


def embedding_score(df: DataFrame, width: int) -> DataFrame:
    """30 points are lost for bad numbers, 20 for zero vectors, 20 if over a tenth of the places are constant."""
    bad = df.agg(F.coalesce(_count(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), F.lit(0)).alias("bad_rows"))
    return embedding_report(df.select("vector")).crossJoin(bad).select(_score((F.col("bad_rows") > 0, 30.0), (F.col("zero_norm") > 0, 20.0), (F.col("constant_dims") > width * 0.1, 20.0)).alias("score"))


def quality_summary(parts: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """part, section, score: of every report (one row with a score), the mean of each part, and the mean of the parts.

    Reports have one row each, so they are evaluated once, into a small staged table.
    """
    out = None
    for part, reports in parts.items():
        for name, report in reports.items():
            rows = report.select(F.lit(part).alias("part"), F.lit(name).alias("section"), "score")
            out = rows if out is None else out.union(rows)
    scores = staged(out, "scores")
    means = scores.groupBy("part").agg(F.lit("mean").alias("section"), F.avg("score").alias("score"))
    return scores.union(means).union(means.agg(F.lit("overall").alias("part"), F.lit("mean").alias("section"), F.avg("score").alias("score")))


def customer_activity(tx: DataFrame) -> DataFrame:
    return tx.where("CUST_CODE is not null").groupBy(F.col("CUST_CODE").alias("customer_id")).agg(F.count("*").alias("rows"))


def saved_activity(spark: SparkSession, path: str) -> SavedAggregate:
    """``customer_activity`` as a saved aggregate of chunks of known customers' lines."""
    return SavedAggregate(spark, path, {"customer_id": "CUST_CODE"}, [counted("rows")])


def top_customers(tx: DataFrame, n: int) -> DataFrame:
    """The ``n`` customers with most lines; ties go to the smaller code."""
    return customer_activity(tx).orderBy(F.desc("rows"), "customer_id").limit(n)


def extract_customers(tx: DataFrame, chosen: DataFrame) -> DataFrame:
    """All lines of the chosen customers."""
    return tx.join(chosen.select(F.col("customer_id").alias("CUST_CODE")), "CUST_CODE", "left_semi")


def sample_neighbors(adjacent: DataFrame, k: int = 10, seed: int = 6) -> DataFrame:
    """At most ``k`` neighbours of each node and edge type, in a seeded order."""
    from pyspark.sql import Window

    order = Window.partitionBy("node", "edge_type").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "node", "neighbour")), "neighbour")
    rows = adjacent.select("node", "edge_type", F.explode("neighbours").alias("x")).select("node", "edge_type", "x.neighbour", "x.weight")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def sample_trip_context(missions: DataFrame, types: dict[str, str], focuses: dict[str, str], seed: int = 8) -> DataFrame:
    """A trip context per customer: type and focus drawn by weight, sensitivity and size by mean."""

    def drawn(columns: dict[str, str], salt: int) -> Column:
        u = draw(F.lit(seed + salt), F.col("customer_id"))
        out, left = F.lit(list(columns)[-1]), sum((F.col(c) for c in list(columns.values())[1:]), F.col(list(columns.values())[0]))
        bound = F.lit(0.0)
        tests = []
        for label, c in columns.items():
            bound = bound + F.col(c)
            tests.append((label, bound))
        for label, b in reversed(tests[:-1]):
            out = F.when(u * left < b, label).otherwise(out)
        return out

    sensitivity = F.when(F.col("mean_price_sensitivity") < 0.33, "LA").when(F.col("mean_price_sensitivity") < 0.67, "MM").otherwise("UM")
    size = F.when(F.col("mean_basket_size") < 0.4, "S").when(F.col("mean_basket_size") < 0.75, "M").otherwise("L")
    return missions.select("customer_id", drawn(types, 0).alias("mission_type"), drawn(focuses, 1).alias("mission_focus"), sensitivity.alias("price_sensitivity"), size.alias("basket_size"))
