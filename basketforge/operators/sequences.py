"""Vocabularies, token sequences, masks and sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketforge.operators.temporal import last_known
from basketforge.session import staged

PAD = 0
_INTS = "array<int>"


def numbered(df: DataFrame, order: list[str], by: list[str] = ()) -> DataFrame:
    """``df`` with ``nth``: each row's number from 0 in the given order, within ``by``.

    Rows are dealt by ranges, each range numbers its own, and the rows of the ranges
    before are added: no task holds a whole group.
    """
    ranged = staged(df.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and group.
    counts = ranged.groupBy(*by, "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)) - 1
    counts = counts.withColumnsRenamed({c: f"_{c}" for c in (*by, "part")})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "part")))
    return ranged.withColumn("own", own).join(counts, same).select(*df.columns, (F.col("own") + F.col("base")).alias("nth"))


def build_vocab(df: DataFrame, column: str, offset: int = 1, large: bool = False) -> DataFrame:
    """value, idx: sorted distinct values numbered from ``offset``; one task numbers them unless the domain is ``large``."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    if large:
        return numbered(values, ["value"]).select("value", (F.col("nth") + offset).cast("int").alias("idx"))
    return values.withColumn("idx", (F.row_number().over(Window.orderBy("value")) - 1 + offset).cast("int"))


def vocab_bundle(tx: DataFrame) -> DataFrame:
    """Vocabularies of products, stores and customers in one table: entity, value, idx."""
    out = None
    for name, c in (("product", "PROD_CODE"), ("store", "STORE_CODE"), ("customer", "CUST_CODE")):
        rows = build_vocab(tx, c, large=name == "customer").select(F.lit(name).alias("entity"), "value", "idx")
        out = rows if out is None else out.union(rows)
    return out


def encode_ids(df: DataFrame, vocab: DataFrame, column: str, target: str, default: int = PAD) -> DataFrame:
    """Index of a value; unknown values take the default."""
    v = vocab.select(F.col("value").alias("_value"), F.col("idx").alias(target))
    return df.join(v, df[column] == F.col("_value"), "left").drop("_value").withColumn(target, F.coalesce(target, F.lit(default)))


def tokenize(baskets: DataFrame, vocab: DataFrame, length: int = 50) -> DataFrame:
    """``baskets`` (basket_id, products) -> tokens: known products in order, then the end token, cut to ``length``.

    Products are 1..N, the end token N+1 and the mask token N+2.
    """
    items = baskets.select("basket_id", F.posexplode("products").alias("pos", "value")).join(vocab, "value")
    found = items.groupBy("basket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("ids"))
    end = vocab.agg((F.max("idx") + 1).alias("end_token"))
    df = baskets.select("basket_id").join(found, "basket_id", "left").crossJoin(F.broadcast(end))
    ids = F.slice(F.coalesce("ids", F.array().cast(_INTS)), 1, length - 1)
    return df.select("basket_id", F.concat(ids, F.array("end_token")).alias("tokens"), "end_token")


def pad_sequences(tokens: DataFrame, length: int) -> DataFrame:
    """Adds padded tokens, attention mask and length."""
    padded = F.slice(F.concat("tokens", F.array_repeat(F.lit(PAD), length)), 1, length)
    return tokens.select("basket_id", padded.alias("padded"), F.transform(padded, lambda x: F.when(x != PAD, 1).otherwise(0)).alias("mask"), F.least(F.size("tokens"), F.lit(length)).alias("length"))


def positional_encoding(position: Column, width: int) -> Column:
    """sin and cos of a position at ``width`` / 2 wavelengths."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(k % 2 == 0, F.sin(position * F.pow(F.lit(10000.0), -(k / width)))).otherwise(F.cos(position * F.pow(F.lit(10000.0), -((k - 1) / width)))))


def sequence_embeddings(tokens: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """Per position the token's vector (zeros if it has none) plus its positional encoding."""
    rows = tokens.select("basket_id", F.posexplode("tokens").alias("pos", "idx")).join(embeddings, "idx", "left")
    own = F.coalesce("vector", F.array_repeat(F.lit(0.0), width))
    return rows.select("basket_id", "pos", F.zip_with(own, positional_encoding(F.col("pos"), width), lambda a, b: a + b).alias("vector"))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mask_items(tokens: DataFrame, share: float = 0.15, seed: int = 7) -> DataFrame:
    """max(1, 15 %) of the positions before the end token: 80 % masked, 10 % another token, 10 % kept.

    Rows: basket_id, masked tokens, positions and their targets.
    """
    place = F.sequence(F.lit(0), F.size("tokens") - 2)
    ranked = F.transform(F.array_sort(F.transform(place, lambda k: F.struct(draw(F.lit(seed), F.col("basket_id"), k).alias("u"), k.alias("k")))), lambda x: x["k"])
    count = F.greatest(F.lit(1), F.floor((F.size("tokens") - 1) * share).cast("int"))
    df = tokens.where(F.size("tokens") > 1).withColumn("positions", F.array_sort(F.slice(ranked, 1, count)))

    def changed(token: Column, k: Column) -> Column:
        u = draw(F.lit(seed + 1), F.col("basket_id"), k)
        other = F.floor(draw(F.lit(seed + 2), F.col("basket_id"), k) * (F.col("end_token") - 1)).cast("int") + 1
        return F.when(~F.array_contains("positions", k), token).when(u < 0.8, F.col("end_token") + 1).when(u < 0.9, other).otherwise(token)

    targets = F.transform("positions", lambda k: F.get("tokens", k))
    return df.select("basket_id", F.transform("tokens", changed).alias("masked"), "positions", targets.alias("targets"))


def mask_history(history: DataFrame, mask_token: int, share: float = 0.15, seed: int = 9) -> DataFrame:
    """``history`` (basket_id, grid or rows that are not padded yet) with a share of the items masked; labels are -100 elsewhere."""
    name = next(c for c in history.columns if c != "basket_id")

    def chosen(i: Column, j: Column, x: Column) -> Column:
        return (x != PAD) & (draw(F.lit(seed), F.col("basket_id"), i, j) < share)

    # Drawn once for each item: the item and whether it is masked.
    drawn = F.transform(name, lambda row, i: F.transform(row, lambda x, j: F.struct(x.alias("x"), chosen(i, j, x).alias("m"))))
    each = lambda f: F.transform("_drawn", lambda row: F.transform(row, f))
    masked, labels = each(lambda s: F.when(s["m"], F.lit(mask_token)).otherwise(s["x"])), each(lambda s: F.when(s["m"], s["x"]).otherwise(F.lit(-100)))
    # A one-element array names the draws, so that they are not made again for the labels.
    return history.withColumn("_drawn", F.explode(F.array(drawn))).select("basket_id", masked.alias("masked"), labels.alias("labels"))


def detokenize(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Values up to the end token; padding is dropped, the mask is ``[MASK]``, other tokens ``UNK_n``."""
    at = F.array_position("tokens", F.col("end_token"))
    kept = F.when(at > 0, F.slice("tokens", F.lit(1), (at - 1).cast("int"))).otherwise(F.col("tokens"))
    rows = tokens.select("basket_id", "end_token", F.posexplode(F.filter(kept, lambda x: x != PAD)).alias("pos", "idx")).join(vocab, "idx", "left")
    text = F.when(F.col("idx") == F.col("end_token") + 1, "[MASK]").otherwise(F.coalesce("value", F.concat(F.lit("UNK_"), F.col("idx").cast("string"))))
    return rows.groupBy("basket_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda x: x["text"]).alias("values"))


def encode_products(rows: DataFrame, vocab: DataFrame, key: str, products: str) -> DataFrame:
    """Known product indices of an array column, in order: key, ids."""
    items = rows.select(key, F.posexplode(products).alias("pos", "value")).join(vocab, "value")
    return items.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("ids"))


def padded_grid(rows: Column, baskets: int = 50, products: int = 30, fill: int = PAD) -> Column:
    """Rows of at most ``products`` numbers as a fixed grid, filled up on the right and below."""
    missing = F.array_repeat(F.lit(fill), products)
    wide = F.transform(rows, lambda row: F.slice(F.concat(row, missing), 1, products))
    return F.slice(F.concat(wide, F.array_repeat(missing, baskets)), 1, baskets)


def grid_text(rows: Column, baskets: int = 50, products: int = 30, fill: int = PAD) -> Column:
    """All numbers of ``padded_grid`` with commas between: what is filled up is text of a known length, and costs nothing for each number."""
    each = lambda row: F.array_join(F.transform(row, lambda x: x.cast("string")), ",")
    line = lambda row: F.concat(each(row), F.repeat(F.lit(f",{fill}"), products - F.size(row)))
    empty = F.repeat(F.lit(f",{fill}"), (baskets - F.size(rows)) * products)
    # A row without a number, like a grid without a row, would begin with a comma.
    return F.ltrim(F.concat(F.array_join(F.transform(rows, lambda row: F.ltrim(line(row), F.lit(","))), ","), empty), F.lit(","))


def latest_rows(histories: DataFrame, baskets: int = 50, products: int = 30) -> DataFrame:
    """``histories`` of numbered products (basket_id, history) -> rows: those of the most recent baskets, newest last; baskets without an item are left out."""
    ids = F.filter(F.transform("history", lambda past: F.slice(past["products"], 1, products)), lambda row: F.size(row) > 0)
    latest = F.slice("_ids", F.greatest(F.size("_ids") - baskets, F.lit(0)) + 1, F.lit(baskets))
    return histories.select("basket_id", ids.alias("_ids")).where(F.size("_ids") > 0).select("basket_id", latest.alias("rows"))


def encode_history(histories: DataFrame, vocab: DataFrame, baskets: int = 50, products: int = 30) -> DataFrame:
    """A fixed grid (baskets x products) of indices: the most recent baskets, newest last, then zeros.

    Products of histories are numbered here, once for each basket that they are in the
    history of; where histories are made of numbered products, ``latest_rows`` does.
    """
    items = histories.select("basket_id", F.posexplode("history").alias("nth", "past")).select("basket_id", "nth", F.posexplode("past.products").alias("pos", "value"))
    found = items.join(vocab, "value").groupBy("basket_id", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias("products"))
    history = found.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("nth", "products"))).alias("history"))
    return latest_rows(history, baskets, products).select("basket_id", padded_grid(F.col("rows"), baskets, products).alias("grid"))


def multihot(rows: DataFrame, vocab: DataFrame, key: str, products: str) -> DataFrame:
    """Sorted distinct indices of the known products."""
    return encode_products(rows, vocab, key, products).select(key, F.array_sort(F.array_distinct(F.filter("ids", lambda x: x > PAD))).alias("target"))


def lookup_price_features(items: DataFrame, features: DataFrame, width: int = 64) -> DataFrame:
    """``items`` (product_id, store_id, week, ...) with the price vector of the cell, else zeros."""
    df = items.join(features, ["product_id", "store_id", "week"], "left")
    return df.withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0.0), width)))


def index_prices(features: DataFrame, products: DataFrame, stores: DataFrame, weeks: DataFrame) -> DataFrame:
    """Price vectors by product, store and week index."""
    df = encode_ids(features, products, "product_id", "product_idx")
    df = encode_ids(df, stores, "store_id", "store_idx")
    return df.join(weeks.select(F.col("week_original").alias("week"), F.col("week").alias("week_idx")), "week").select("product_idx", "store_idx", "week_idx", "features")


def ended(ids: Column, end: Column, length: int) -> Column:
    """A sequence of at most ``length`` tokens: items, then the end token."""
    return F.concat(F.slice(ids, 1, length - 1), F.array(end))


def input_prices(pairs: DataFrame, features: DataFrame, length: int = 50, width: int = 64) -> DataFrame:
    """Price vectors of the items of each input basket: input_basket_id, price_weeks, input_price_features.

    An item's price is that of the last week, at or before the input's, in which its
    product has one in the input's store: ``price_weeks`` has that week, or 0 and a
    vector of zeros where there is none. ``features``: product_id, store_id, week, features.
    """
    items = pairs.select("input_basket_id", F.col("input_store_id").alias("store_id"), F.col("input_week_original").alias("week"), F.posexplode(F.slice("input_products", 1, length - 1)).alias("pos", "product_id"))
    by = ["product_id", "store_id"]
    weeks = last_known(items, features.select(*by, "week", F.col("week").alias("price")), by, "week", ["price"])
    # Vectors are joined once for each wanted cell, then meet the items.
    cells = weeks.join(features.select(*by, F.col("week").alias("known_price"), "features"), [*by, "known_price"], "left")
    found = items.join(cells, [*by, "week"], "left")
    zeros = F.array_repeat(F.lit(0.0), width)
    one = F.struct("pos", F.coalesce("known_price", F.lit(0)).alias("week"), F.coalesce("features", zeros).alias("features"))
    kept = found.groupBy("input_basket_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    return kept.select("input_basket_id", F.col("items.week").alias("price_weeks"), F.col("items.features").alias("input_price_features"))


def next_basket_samples(pairs: DataFrame, vocab: DataFrame, features: DataFrame, length: int = 50) -> DataFrame:
    """Input sequence with prices, target set and sequence of each pair, and the context of both baskets.

    Both sequences end with the end token N+1 and have at most ``length`` tokens with it.
    """
    end = vocab.agg((F.max("idx") + 1).alias("end_token"))
    inputs = encode_products(pairs, vocab, "input_basket_id", "input_products").withColumnRenamed("ids", "input_items")
    known = encode_products(pairs, vocab, "target_basket_id", "target_products")
    target = F.array_sort(F.array_distinct(F.filter("ids", lambda x: x > PAD)))
    targets = known.select("target_basket_id", target.alias("target"), F.col("ids").alias("target_items"))
    df = pairs.join(inputs, "input_basket_id").join(targets, "target_basket_id").join(input_prices(pairs, features, length), "input_basket_id").crossJoin(F.broadcast(end))
    df = df.withColumn("input_ids", ended(F.col("input_items"), F.col("end_token"), length)).withColumn("target_ids", ended(F.col("target_items"), F.col("end_token"), length))
    return df.select(
        "customer_id", "input_basket_id", "target_basket_id", "input_ids", F.size("input_ids").alias("input_length"), "input_store_id", F.col("input_week_original").alias("input_week"), "price_weeks", "input_price_features",
        "target", "target_ids", F.size("target_ids").alias("target_length"), "target_store_id", "target_week_original", "target_weekday", "target_hour", "week_gap", "num_history_baskets", "split", "bucket",
    )


def store_visit_samples(pairs: DataFrame, stores: DataFrame) -> DataFrame:
    """Previous and target store index of each pair with the context of the target basket."""
    df = encode_ids(encode_ids(pairs, stores, "input_store_id", "previous_store"), stores, "target_store_id", "target_store")
    return df.select("customer_id", "input_basket_id", "target_basket_id", "previous_store", "target_store", "target_week_original", "target_weekday", "target_hour", "split", "bucket")


def plan_batches(samples: DataFrame, key: str, group: str, size: int, seed: int = 3) -> DataFrame:
    """Batch number within each group in a seeded order, and a seeded order of the batches."""
    drawn = samples.select(key, group, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("drawn"))
    df = numbered(drawn, ["drawn", key], [group]).select(key, group, F.floor(F.col("nth") / size).cast("int").alias("batch"))
    return df.withColumn("batch_order", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col("batch").cast("string"))))


def evaluation_groups(samples: DataFrame, key: str, by: str, size: int) -> DataFrame:
    """Batches inside each date, hour or week, in key order."""
    return numbered(samples.select(key, by), [key], [by]).select(key, by, F.floor(F.col("nth") / size).cast("int").alias("batch"))
