"""Price encodings: Fourier, log, relative and velocity features as array columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketforge.functions.columns import fix_width, flag

#: Frequencies, small constant, widths and bounds of the encoding.
FREQUENCIES = (1 / 7, 1 / 14, 1 / 30, 1 / 90, 1 / 2, 1 / 3, 1 / 4, 1 / 5)
EPS = 1e-6
PREMIUM, VALUE, MOVE = 1.3, 0.7, 0.05


def _series():
    return Window.partitionBy("product_id", "store_id").orderBy("week")


def fourier_features(price: Column, terms: bool = True) -> Column:
    """24 numbers: sin and cos of each frequency, then sin*cos and sin^2 of the first four."""
    waves = [(F.sin(price * (2 * pi * f)), F.cos(price * (2 * pi * f))) for f in FREQUENCIES]
    out = [x for pair in waves for x in pair]
    extra = [x for s, c in waves[:4] for x in (s * c, s * s)]
    return F.array(*out, *extra) if terms else fix_width(F.array(*out), 24)


def log_features(prices: DataFrame) -> DataFrame:
    """Adds ``log_features`` (16): logs, their global z-scores (a one-row broadcast), and powers."""
    a, b = F.log(F.col("actual_price") + EPS), F.log(F.col("base_price") + EPS)
    stats = prices.agg(F.avg(a).alias("ma"), F.stddev_pop(a).alias("sa"), F.avg(b).alias("mb"), F.stddev_pop(b).alias("sb"))
    powers = [F.pow(a, F.lit(float(i % 3 + 1))) * (-1.0) ** i for i in range(8)]
    values = F.array(a, b, b - a, (a - F.col("ma")) / (F.col("sa") + EPS), (b - F.col("mb")) / (F.col("sb") + EPS), a * a, F.exp(-a), F.tanh(a), *powers)
    return prices.crossJoin(F.broadcast(stats)).withColumn("log_features", values).drop("ma", "sa", "mb", "sb")


def log_features_item(price: Column, base: Column) -> Column:
    """The per-item form (16, zero-padded)."""
    a, b = F.log(price + EPS), F.log(base + EPS)
    return fix_width(F.array(a, b, b - a, a * a, F.exp(-a), F.tanh(a), a * b, F.abs(b - a)), 16)


def weekly_category_prices(prices: DataFrame) -> DataFrame:
    """Mean, spread, bounds and count of prices of each category (first seven characters) and week."""
    return prices.groupBy(F.substring("product_id", 1, 7).alias("category"), "week").agg(
        F.avg("actual_price").alias("week_mean"), F.stddev_samp("actual_price").alias("week_std"), F.min("actual_price").alias("week_min"), F.max("actual_price").alias("week_max"), F.count("*").alias("week_count")
    )


def expanding_category_prices(weekly: DataFrame) -> DataFrame:
    """Statistics of all weeks up to and with each week, per category."""
    past = Window.partitionBy("category").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum(F.col("week_mean") * F.col("week_count")).over(past) / F.sum("week_count").over(past)
    std = F.coalesce(F.stddev_samp("week_mean").over(past), F.avg("week_mean").over(past) * 0.1)
    return weekly.select("category", "week", mean.alias("expanding_avg"), std.alias("expanding_std"), F.min("week_min").over(past).alias("expanding_min"), F.max("week_max").over(past).alias("expanding_max"))


def relative_features(prices: DataFrame) -> DataFrame:
    """Adds ``relative_features`` (16) against the category's past and present weeks."""
    known = expanding_category_prices(weekly_category_prices(prices))
    df = prices.withColumn("category", F.substring("product_id", 1, 7)).join(known, ["category", "week"])
    p = F.col("actual_price")
    ratio = p / (F.col("expanding_avg") + EPS)
    z = (p - F.col("expanding_avg")) / (F.col("expanding_std") + EPS)
    place = (p - F.col("expanding_min")) / (F.col("expanding_max") - F.col("expanding_min") + EPS)
    waves = [F.sin(place * (pi * k)) for k in range(1, 9)]
    values = F.array(ratio, z, place, *_bands(ratio), F.log(ratio + EPS), ratio * ratio, *waves)
    return df.withColumn("relative_features", values).drop("category", "expanding_avg", "expanding_std", "expanding_min", "expanding_max")


def _bands(ratio: Column) -> list[Column]:
    return [flag(ratio > PREMIUM), flag(ratio < VALUE), flag((ratio >= VALUE) & (ratio <= PREMIUM))]


def relative_features_item(price: Column, average: Column) -> Column:
    """The per-item form (16)."""
    ratio = price / (average + EPS)
    powers = [F.pow(ratio, F.lit(float(i % 3 + 1))) * (-1.0) ** i for i in range(8)]
    turn = F.least(ratio, F.lit(2.0)) * pi
    return F.array(ratio, F.log(ratio + EPS), ratio * ratio, *_bands(ratio), F.sin(turn), F.cos(turn), *powers)


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def price_velocity(prices: DataFrame) -> DataFrame:
    """Adds velocity and acceleration of the price within its series, both within -1..1."""
    prior = F.coalesce(F.lag("actual_price").over(_series()), F.col("actual_price"))
    df = prices.withColumn("velocity", _clip((F.col("actual_price") - prior) / (prior + EPS)))
    return df.withColumn("acceleration", _clip(F.col("velocity") - F.coalesce(F.lag("velocity").over(_series()), F.lit(0.0))))


def _moves(v: Column) -> tuple[Column, Column, Column]:
    return flag(v > MOVE), flag(v < -MOVE), flag((v >= -MOVE) & (v <= MOVE))


def velocity_features(prices: DataFrame) -> DataFrame:
    """Adds ``velocity_features`` (8)."""
    v, (up, down, flat) = F.col("velocity"), _moves(F.col("velocity"))
    return price_velocity(prices).withColumn("velocity_features", F.array(v, F.col("acceleration"), down, up, down, flat, F.abs(v), v * v)).drop("velocity", "acceleration")


def velocity_features_item(price: Column, prior: Column) -> Column:
    """The per-item form (8)."""
    v = _clip((price - prior) / (prior + EPS))
    up, down, flat = _moves(v)
    return F.array(v, F.abs(v), v * v, up, down, flat, F.sin(v * pi), F.cos(v * pi))


def price_features(prices: DataFrame) -> DataFrame:
    """The 64-wide encoding of each product, store and week."""
    df = velocity_features(relative_features(log_features(prices)))
    parts = F.concat(fourier_features(F.col("actual_price")), "log_features", "relative_features", "velocity_features")
    return df.select("product_id", "store_id", "week", parts.alias("features"))


def encode_quotes(quotes: DataFrame) -> DataFrame:
    """``quotes`` (price, base_price, category_avg, prior_price) with a 64-wide ``features`` column."""
    p, b = F.col("price"), F.col("base_price")
    a, base = F.log(p + EPS), F.log(b + EPS)
    logs = fix_width(F.array(a, base, base - a, a, base, a * a, F.exp(-a), F.tanh(a)), 16)
    ratio = p / (F.col("category_avg") + EPS)
    relative = fix_width(F.array(ratio, F.lit(0.0), F.lit(0.5), *_bands(ratio), F.log(ratio + EPS), ratio * ratio), 16)
    v = _clip((p - F.col("prior_price")) / (F.col("prior_price") + EPS))
    up, down, flat = _moves(v)
    speed = F.array(v, F.lit(0.0), down, up, down, flat, F.abs(v), v * v)
    return quotes.withColumn("features", F.concat(fourier_features(p, terms=False), logs, relative, speed))
