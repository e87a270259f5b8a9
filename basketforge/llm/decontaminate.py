"""Benchmark decontamination: test n-grams found in training texts, DataFrame functions only.

Windows of ``WINDOW`` consecutive words of each item (an item of fewer words is one
window) are normalised, hashed and held as a broadcast set. A document's words are
hashed once; places whose word pair begins no window are passed over by a bit
table, the rest are hashed at each window length and joined with the set, and hits
are verified word by word.

Defined cases: null and empty texts, and texts without words, have no words and
are clean; null items, and items without words, have no windows; an empty
benchmark hits nothing; repeated rows are judged once each; a null doc_id is
carried along; extra columns are ignored by ``find_hits`` and kept by
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.llm.bit_table import bit_table, in_table
from basketforge.sources.tables import table

WINDOW = 10
#: Rows of the window set that may be broadcast; a larger set is joined by shuffle.
BROADCAST_WINDOWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters beyond ASCII that lower() might change; only A-Z may be.
OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]"


def normal_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    lowered = F.when(text.rlike(OTHER_CASE), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, words, length and the items that have them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    rows = items.select("item", F.explode(F.transform(starts, lambda k: F.slice("words", k, width))).alias("window"))
    windows = rows.groupBy("window").agg(F.collect_set("item").alias("items"))
    hashed = windows.withColumn("h", _hashes(F.col("window")))
    return hashed.select("window", "items", F.size("window").alias("len"), F.xxhash64("h").alias("code"), F.get("h", F.lit(0)).alias("first"), F.xxhash64(F.get("h", F.lit(0)), F.get("h", F.lit(1))).alias("pair"))


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, key, n_words, hits (places of hit words from 0), items."""
    windows = benchmark_windows(benchmark, width).cache()
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row"), normal_words(F.col("text")).alias("words"))
    if not lengths:
        return rows.select("doc_id", "key", F.size("words").alias("n_words"), F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    starts, whole = bit_table(windows, "pair"), bit_table(windows, "code")
    hashed = rows.withColumn("h", _hashes(F.col("words")))
    paired = hashed.withColumn("pairs", F.transform("h", lambda h, k: F.xxhash64(h, F.get("h", k + 1))))
    begins = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda k: in_table(starts, F.get("pairs", k)))
    if lengths[0] == 1:
        single = bit_table(windows.where("len = 1"), "first")
        begins = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda k: in_table(starts, F.get("pairs", k)) | in_table(single, F.get("h", k)))
    places = paired.withColumn("begins", F.when(F.size("h") > 0, begins).otherwise(F.array().cast("array<int>")))
    sizes = F.array(*(F.lit(n) for n in lengths))
    at_each = F.flatten(F.transform("begins", lambda k: F.transform(sizes, lambda n: F.struct(k.alias("at"), n.alias("len"), F.xxhash64(F.slice("h", k + 1, n)).alias("code")))))
    likely = F.filter(at_each, lambda x: (x["at"] + x["len"] <= F.size("h")) & in_table(whole, x["code"]))
    with_words = F.transform(likely, lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len"), x["code"].alias("code"), F.slice("words", x["at"] + 1, x["len"]).alias("found")))
    found = places.select("doc_id", "key", "row", F.size("words").alias("n_words"), F.explode_outer(with_words).alias("x"))
    found = found.select("doc_id", "key", "row", "n_words", "x.at", "x.len", "x.code", "x.found")
    held = windows.select("code", "window", "items")
    held = F.broadcast(held) if windows.count() <= BROADCAST_WINDOWS else held
    matched = found.join(held, (found["code"] == held["code"]) & (found["found"] == held["window"]), "left")
    span = F.when(F.col("window").isNotNull(), F.struct("at", "len"))
    perdoc = matched.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.collect_set(span).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    hits = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1))))
    return perdoc.select("doc_id", "key", "n_words", hits.alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, spans_only: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a window, or without the hit words alone.

    With ``spans_only`` a hit document keeps its other words, joined by spaces.
    """
    found = find_hits(docs, benchmark, width).where(F.size("hits") > 0).select(F.col("key").alias("hit_key"), "hits").dropDuplicates(["hit_key"])
    # The row travels as one column, so that its names cannot clash.
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("key"))
    if not spans_only:
        return rows.join(found, rows["key"] == found["hit_key"], "left_anti").select("doc.*")
    there = rows.join(found, rows["key"] == found["hit_key"], "left")
    text = F.col("doc.text")
    kept = F.array_join(F.filter(normal_words(text.cast("string")), lambda w, k: ~F.array_contains("hits", k)), " ")
    text = F.when(F.col("hits").isNull(), text).otherwise(kept)
    return there.select(*(text.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, w[k:k + {WINDOW - 1}] AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS k FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
pos AS (SELECT r, w, unnest(generate_series(1, len(w))) AS k FROM d),
dw AS (SELECT r, k, n, w[k:k + n - 1] AS win FROM pos, lens WHERE k + n - 1 <= len(w)),
hit AS (SELECT r, k, n, item FROM dw JOIN win USING (win)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
