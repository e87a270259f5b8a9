"""Language identification by rank-order profiles.

A profile is the list of the ``PROFILE`` most frequent letter n-grams (1 to 3,
with word boundaries) in order of frequency. A document's distance to a language
is the sum, over the document's own most frequent n-grams, of how far each is out
of place in the language's profile; an n-gram that the profile lacks counts
``PROFILE``. The nearest language is predicted.

Defined cases: null texts and texts without a letter give ``und`` and score 0; so
does every text when nothing was learnt; ties go to the language that sorts
first; repeated rows are judged once each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketforge.llm.batches import slices
from basketforge.llm.folds import held_out
from basketforge.sources.tables import table

PROFILE = 300
#: Bound of the sample learnt from, for each language: CELLS cells of a hash of doc_id, PER_CELL rows of each.
CELLS, PER_CELL = 32, 16
#: Languages up to which the sample's ids are broadcast: CELLS * PER_CELL rows of each.
BROADCAST_LANGUAGES = 500
UNKNOWN = "und"

_letter = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _letter[97]:
        _letter[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _letter


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all letter 1-, 2- and 3-grams of the whole text."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], np.minimum(points, 2**20 - 1), 0)
    points = np.concatenate([[0], points, [0]])
    points = points[np.r_[True, (points[1:] != 0) | (points[:-1] != 0)]]
    if len(points) < 3:
        return none
    two = points[:-1] << 20 | points[1:]
    three = two[:-1] << 20 | points[2:]
    one = points[points > 0]
    # A lone boundary is no n-gram; the top bits hold the length.
    return np.unique(np.concatenate([one, two | 1 << 60, three | 2 << 60]), return_counts=True)


def top_ngrams(text: str | None, k: int = PROFILE) -> np.ndarray:
    """The k most frequent n-grams, most frequent first, ties by key."""
    keys, counts = ngram_counts(text)
    return keys[np.argsort(-counts, kind="stable")[:k]]


def learn_profiles(docs: DataFrame) -> dict[str, list[int]]:
    """Profile of each language from a bounded sample of its documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    first = Window.partitionBy("lang", "cell").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    #: Spark keeps only the first rows of each window before the shuffle.
    chosen = known.select("doc_id", "lang", cell.alias("cell")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= PER_CELL)
    ids = chosen.select("doc_id", "lang", "cell").distinct()
    if known.select("lang").distinct().count() <= BROADCAST_LANGUAGES:
        # The sample is bounded by the languages: texts outside it are not shuffled.
        ids = F.broadcast(ids)
    texts = known.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id")

    def count(batches):
        for batch in batches:
            total: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(lang, []).append(ngram_counts(text))
            for lang, found in total.items():
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

    grams = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in sorted(ranked.select("lang", "rank", "gram").collect()):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def rank_table(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, all n-grams in order, and the rank of each in each (PROFILE: absent)."""
    langs = sorted(profiles)
    grams = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), PROFILE, np.int64)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(grams, profiles[lang]), k] = np.arange(len(profiles[lang]))
    return langs, grams, ranks


def nearest(text: str | None, langs: list[str], grams: np.ndarray, ranks: np.ndarray) -> tuple[str, float]:
    """Language with the least out-of-place distance, and its share of all closeness."""
    own = top_ngrams(text)
    if not len(own) or not langs:
        return UNKNOWN, 0.0
    at = np.searchsorted(grams, own)
    at[at == len(grams)] = 0
    at = np.where(grams[at] == own, at, len(grams))
    there = ranks[at]
    out = np.where(there == PROFILE, PROFILE, np.abs(there - np.arange(len(own))[:, None])).sum(0)
    close = 1 - out / (PROFILE * len(own))
    best = int(np.argmin(out))
    return langs[best], float(close[best] / close.sum()) if close.sum() > 0 else 1 / len(langs)


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score."""
    known = rank_table(profiles)

    def run(batches):
        for batch in slices(batches):
            found = [nearest(text, *known) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify(docs, learn_profiles(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
