"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A text is written as its words, each word as eight hashed bytes, and cut into
windows of ``WINDOW`` words. Each window is compressed with the ordinary dictionary
alone, and with the toxic one before it: what the second saves is the window's
distance towards toxic text, and words that both know cancel out. A text's savings
(in all, per window, and of its best window) go through a logistic calibration, so
that the threshold of ``ACCEPT`` is one of probability.

A dictionary is trained on one kind of text by its own counts alone: a word counts
as often as the number of different words it follows, so that a passage counts once
however many copies it has. The most frequent words stand last, where matches are
cheapest. (The trainer that comes with zstandard takes its segments by position,
and cuts as many of its best ones as the header is long: held-out AUC 0.50 to 0.70,
for windows of plain text as well as of word codes, against 0.93.)
The calibration is fitted on savings by dictionaries that left out the text's own
fold. Learning takes at most ``TRAIN_ROWS`` labelled rows; pairs of words are
counted by Spark, and at most ``ORDINARY_WORDS + TOXIC_WORDS`` words and one row for
each labelled one come to the driver.

Defined cases: null and empty texts, and texts without a letter or digit, have no
window, and the score of no savings; labels that are null or belong to no document
are not learnt from; without labels of both kinds every score is 0.5; repeated rows
are scored once each; a null doc_id is not held out and never learnt from; extra
columns are ignored. One text's word codes are held in memory at a time, eight
bytes a word.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.llm.batches import slices
from basketforge.sources.tables import table

#: Bound of the sample of labelled rows that is learnt from.
TRAIN_ROWS = 16_384
FOLDS = 3
WINDOW = 16
#: Most words of a dictionary, and the fewest different words that a word of it follows.
ORDINARY_WORDS, ORDINARY_LEAST = 32_768, 2
TOXIC_WORDS, TOXIC_LEAST = 2_048, 5
ACCEPT = 0.7
CACHE_WORDS = 200_000
#: Windows that are compressed in one call.
AT_ONCE = 4_096

_words = re.compile(r"[^\W_]+")
#: The last bytes of a dictionary are not looked up, so these stand there.
_END = blake2b(b"end", digest_size=32).digest()


class _Codes(dict):
    """word -> its eight bytes."""

    def __missing__(self, word: str) -> bytes:
        code = blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = code
        return code


_codes = _Codes()


def word_codes(text: str | None) -> bytes:
    return b"".join(map(_codes.__getitem__, _words.findall(text.lower()))) if text else b""


def held_out_third(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Search over chains and a hash table with two places for every byte of the dictionary; frames without any header."""
    wide = max(10, math.ceil(math.log2(len(content) + 8 * WINDOW)))
    how = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=wide + 1, chain_log=wide + 1, search_log=6, min_match=6, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


class Savings:
    """What the toxic dictionary saves in each window of a text, in bytes."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = _compressor(ordinary + _END), _compressor(toxic + ordinary + _END)

    def __call__(self, text: str | None) -> np.ndarray:
        codes, step = word_codes(text), 8 * WINDOW
        starts = np.arange(0, len(codes), step, dtype=np.uint64)
        out = []
        for k in range(0, len(starts), AT_ONCE):
            at = starts[k : k + AT_ONCE]
            part = codes[int(at[0]) : int(at[-1]) + step]
            at = at - at[0]
            ends = np.append(at[1:], np.uint64(len(part)))
            cut = zstandard.BufferWithSegments(part, np.column_stack([at, ends - at]).tobytes())
            one, two = (c.multi_compress_to_buffer(cut, threads=1) for c in (self.plain, self.both))
            out.append(np.fromiter((len(one[i]) - len(two[i]) for i in range(len(at))), np.float64, len(at)))
        return np.concatenate(out) if out else np.empty(0)


def measures(savings: np.ndarray) -> np.ndarray:
    """All savings (on a logarithmic scale), those per window, and those of the best window."""
    gain = np.maximum(savings, 0.0)
    return np.array([math.log1p(gain.sum()), min(8.0, gain.mean()), min(24.0, gain.max()) / 8]) if len(gain) else np.zeros(3)


@dataclass
class Model:
    """Dictionaries and calibration weights (the bias last); no weights where there was nothing to learn."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None

    def scorer(self):
        if self.weights is None:
            return lambda text: 0.5
        savings = Savings(self.ordinary, self.toxic)
        return lambda text: probability(measures(savings(text)), self.weights)


def probability(x: np.ndarray, weights: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, float(x @ weights[:-1] + weights[-1])))))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the bias last) of a logistic regression by Newton's method, with a small penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _pairs(batches):
    """text, toxic, fold -> word, the word before it; each pair of a text once."""
    for batch in slices(batches):
        word, before, toxic, fold = [], [], [], []
        for text, y, f in zip(*(c.to_pylist() for c in batch.columns)):
            codes = np.frombuffer(word_codes(text), np.int64)
            pairs = np.unique(np.column_stack([codes[1:], codes[:-1]]), axis=0) if len(codes) > 1 else np.empty((0, 2), np.int64)
            word.append(pairs[:, 0]), before.append(pairs[:, 1])
            toxic.append(np.full(len(pairs), y)), fold.append(np.full(len(pairs), f))
        columns = [pa.array(np.concatenate(c).astype(t)) for c, t in ((word, np.int64), (before, np.int64), (toxic, np.int32), (fold, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "before", "toxic", "fold"])


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic, fold of at most ``rows`` labelled rows that may be learnt from, chosen by a hash of doc_id."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out_third())
    sample = known.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h")).orderBy("h", "toxic").limit(rows)
    #: The sample is bounded by ``rows``, so it may be broadcast.
    texts = docs.where(~held_out_third()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    return texts.select("text", "toxic", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))


def _content(counts: list, k: int, least: int) -> bytes:
    """The words with at least ``least`` different words before them, most frequent last; ``k``: which count."""
    kept = sorted((r[2 + k], r["word"]) for r in counts if r[2 + k] >= least)
    return np.array([w for _, w in kept], np.int64).tobytes()


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    sample = labelled(docs, labels, rows)
    pairs = sample.mapInArrow(_pairs, "word long, before long, toxic int, fold int")
    masks = pairs.groupBy("toxic", "word", "before").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("fold"))).alias("mask"))
    without = [F.count_if(F.col("mask") != 1 << f).alias(f"n{f}") for f in range(FOLDS)]
    counts = masks.groupBy("toxic", "word").agg(F.count("*").alias("n"), *without)
    #: Both lists are bounded.
    most = [
        counts.where((F.col("toxic") == y) & (F.col("n") >= least)).orderBy(F.desc("n"), "word").limit(words).collect()
        for y, least, words in ((0, ORDINARY_LEAST, ORDINARY_WORDS), (1, TOXIC_LEAST, TOXIC_WORDS))
    ]
    sets = [(_content(most[0], k, ORDINARY_LEAST), _content(most[1], k, TOXIC_LEAST)) for k in range(FOLDS + 1)]
    held = docs.sparkSession.sparkContext.broadcast(sets[1:])

    def measured(batches):
        savings = [Savings(*own) for own in held.value]
        for batch in slices(batches):
            x = [measures(savings[f](text)) for text, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in np.array(x).reshape(-1, 3).T)], names=["toxic", "a", "b", "c"])

    #: One small row for each row of the bounded sample.
    got = np.array([tuple(r) for r in sample.mapInArrow(measured, "toxic int, a double, b double, c double").collect()], np.float64).reshape(-1, 4)
    both = 0 < got[:, 0].sum() < len(got)
    return Model(*sets[0], calibrated(got[:, 1:], got[:, 0]) if both else None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, score; every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value.scorer()
        for batch in slices(batches):
            out = [own(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out_third().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
