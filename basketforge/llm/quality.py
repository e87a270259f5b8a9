"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Features of a text: its words and word pairs, and the shapes of its words and
their pairs (letters run together by case, digits as 0, other characters kept; a
word that repeats the one before it has a shape of its own), all hashed to
``BUCKETS`` places, each occurrence worth 1 / number of words. Training runs
follow-the-regularised-leader updates on ``SHARDS`` shards of a bounded sample of
labelled rows and averages the shards' weights; scoring is a sparse dot product
over the whole text.

Defined cases: null and empty texts have no features, so their score is that of
the bias; labels that are null or belong to no document are not learnt from;
without any label every score is 0.5; repeated rows are scored once each; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.llm.batches import slices
from basketforge.llm.folds import held_out
from basketforge.sources.tables import table

BUCKETS = 2**18
#: Bound of the sample of labelled rows that is learnt from, and the rounds over it.
TRAIN_ROWS = 8_192
SHARDS = 4
ROUNDS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-6, 1e-6
ACCEPT = 0.7
CACHE_WORDS = 100_000

_runs = re.compile(r"[^\W\d_]+|\d+|(.)\1+", re.DOTALL)


def _shape_part(m: re.Match) -> str:
    run = m.group()
    if run[0].isdigit():
        return "0"
    if m.group(1):
        return run[:3]
    if len(run) > 1 and run.isupper():
        return "AA"
    return ("A" if run[0].isupper() else "") + ("a" if len(run) > 1 or run.islower() else "")


def word_shape(word: str) -> str:
    return _runs.sub(_shape_part, word)[:24]


class _Codes(dict):
    """word -> hash of the word in the high half, hash of its shape in the low half."""

    def __missing__(self, word: str) -> int:
        code = (zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) >> 1) << 32 | zlib.crc32(word_shape(word).encode("utf-8", "surrogatepass"))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = code
        return code


_codes = _Codes()


def features(text: str | None) -> np.ndarray:
    """Places of all features of a text, repeated as they occur."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
    word, shape = codes >> 32, codes & 0xFFFFFFFF
    same = np.r_[False, codes[1:] == codes[:-1]]
    shape = np.where(same, 7, shape)
    pair = word[:-1] * 0x2545F491 + word[1:]
    shapes = shape[:-1] * 0x9E3779B1 + shape[1:]
    places = np.concatenate([word * 4, (pair ^ (pair >> 29)) * 4 + 1, shape * 4 + 2, (shapes ^ (shapes >> 29)) * 4 + 3])
    return (places * 0x9E3779B97F4A7C1 >> 20) & (BUCKETS - 1)


def train_ftrl(rows: list[tuple[str | None, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (text, label) rows in the order given: weights and bias."""
    z, n, w = (np.zeros(BUCKETS + 1) for _ in range(3))
    seen = []
    for text, label in rows:
        places = features(text)
        at, count = np.unique(places, return_counts=True)
        words = max(1.0, len(places) / 4)
        seen.append((np.append(at, BUCKETS), np.append(count / words, 1.0), label))
    for _ in range(rounds):
        for at, x, label in seen:
            za, na = z[at], n[at]
            own = np.where(np.abs(za) <= L1, 0.0, -(za - np.sign(za) * L1) / ((BETA + np.sqrt(na)) / ALPHA + L2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(own @ x)))))
            g = (p - label) * x
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / ALPHA
            z[at], n[at] = za + g - sigma * own, na + g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (the bias last) from at most ``rows`` labelled rows, chosen by a hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    sample = known.select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h", "quality").limit(rows)
    #: The sample is bounded by ``rows``, so it may be broadcast.
    texts = docs.where(~held_out()).select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def shard(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["h", "quality"], kind="stable").head(rows)
        weights, bias = train_ftrl(list(zip(pdf["text"], pdf["quality"])))
        at = np.flatnonzero(weights)
        return pd.DataFrame({"place": np.append(at, BUCKETS).astype(np.int64), "weight": np.append(weights[at], bias)})

    grouped = texts.groupBy(F.pmod("h", F.lit(SHARDS)).alias("shard"))
    learnt = grouped.applyInPandas(shard, "place long, weight double").groupBy("place").agg(F.sum("weight").alias("w"), F.count("*").alias("k"))
    #: At most BUCKETS + 1 rows, whatever the size of the corpus.
    got = learnt.collect()
    shards = max([r["k"] for r in got if r["place"] == BUCKETS], default=1)
    weights = np.zeros(BUCKETS + 1)
    for r in got:
        weights[r["place"]] = r["w"] / shards
    return weights


def score_text(text: str | None, w: np.ndarray) -> float:
    """Sparse dot product of a text's features with the weights, as a probability."""
    places = features(text)
    dot = float(w[places].sum()) * 4 / len(places) if len(places) else 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, dot + w[-1]))))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score; every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = held.value
        for batch in slices(batches):
            out = [score_text(text, w) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, accept: float = ACCEPT) -> DataFrame:
    """``docs`` whose score is at least ``accept``; same columns."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([texts], ["text"])])
        return pa.array([score_text(x, held.value) for part in parts for x in part.column(0).to_pylist()], pa.float64())

    return docs.where(scored(F.col("text").cast("string")) >= accept)


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
