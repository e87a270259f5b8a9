"""Hard-negative mining: rotated one-bit codes pass over most pairs, the rest get integer scores.

A vector's components become whole numbers, ``floor(SCALE * x)``; a pair's score is
their inner product. An anchor's positives are its best rows of the same label; for
each positive, its negatives are the best rows of other labels whose score lies
between ``LOW`` hundredths of the positive's and the positive's.

Each vector is rotated by a fixed random rotation and coded as the signs of its
coordinates, with the alignment of code and vector; what the code leaves over is
coded again, ``ROW_CODES`` times for a row and ``ANCHOR_CODES`` times for an anchor,
and the length of the last remainder is kept. The inner product of the coded parts is
a sum of popcounts times alignments. What it can differ from the true one is bounded
by Cauchy and Schwarz, from the lengths of both remainders: a deterministic interval,
so a row outside every range that is still open is passed over without loss. All
others are scored in whole numbers, and nothing else is returned.

Anchors are a stated set of queries against all rows: blocks of at most
``ANCHORS_AT_ONCE`` are sent to every task (a bounded broadcast), tasks read the rows
once for positives and once for negatives, and each returns at most the asked number
for each anchor and positive; the best of those are picked by windows. Rows are
never shuffled, so neither a common label nor copies of one vector gather anywhere.

Defined cases: rows with a null vec_id, label or vector, an empty vector, a null or
non-finite component, a component of ``LARGEST`` or more after scaling, or more than
``WIDEST`` components take no part; vectors of different widths do not meet; of equal
scores the smaller vec_id comes first; rows that share the anchor's vec_id are not
its positives or negatives, other repeated rows count each, and a repeated anchor is
answered each time; negative scores have no range and so no negatives, a positive
with score 0 takes scores of 0; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketforge.llm.batches import slices
from basketforge.llm.vector_dedup import rotation
from basketforge.session import dropped, staged, staging_path
from basketforge.sources.tables import table

SCALE = 256
LARGEST, WIDEST = 2**24, 2**15
POSITIVES, NEGATIVES = 5, 5
#: Hundredths of the positive's score that a negative's must reach.
LOW = 80
ROW_CODES, ANCHOR_CODES = 4, 6
ANCHORS_AT_ONCE = 32_768
#: Most pairs of an anchor and a row, and most rows, that are estimated at a time.
PAIRS, ROWS = 2**19, 1024
#: Fewest waiting scores that are merged at a time (as many as may be held, if those are more).
WAITING = 2**12
#: Share of both lengths by which intervals are widened for rounding.
SLACK = 1e-9
NEVER = np.iinfo(np.int64).min


class Coded:
    """Whole vectors of one width with codes, alignments and the lengths of what they leave over."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, codes: int):
        self.ids, self.labels, self.whole = ids, labels, whole
        self.width = whole.shape[1]
        rest = whole.astype(np.float64) @ rotation(self.width, 0)
        self.length = np.sqrt((rest * rest).sum(1))
        self.codes, self.aligned = [], []
        for _ in range(codes):
            sign = np.where(rest >= 0, 1.0, -1.0) / math.sqrt(self.width)
            own = (rest * sign).sum(1)
            bits = np.packbits(sign > 0, axis=1)
            padded = np.zeros((len(ids), -(-bits.shape[1] // 8) * 8), np.uint8)
            padded[:, : bits.shape[1]] = bits
            self.codes.append(padded.view(np.uint64))
            self.aligned.append(own)
            rest = rest - own[:, None] * sign
        self.left = np.sqrt((rest * rest).sum(1))

    def part(self, at) -> Coded:
        out = object.__new__(Coded)
        out.ids, out.labels, out.whole, out.width = self.ids[at], self.labels[at], self.whole[at], self.width
        out.length, out.left = self.length[at], self.left[at]
        out.codes, out.aligned = [c[at] for c in self.codes], [a[at] for a in self.aligned]
        return out


def intervals(anchors: Coded, rows: Coded) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, rows) matrices between whose values the inner products surely lie."""
    middle = np.zeros((len(anchors.ids), len(rows.ids)))
    for code, own in zip(anchors.codes, anchors.aligned):
        for other, theirs in zip(rows.codes, rows.aligned):
            differ = np.bitwise_count(code[:, None, 0] ^ other[None, :, 0]).astype(np.int64)
            for k in range(1, code.shape[1]):
                differ += np.bitwise_count(code[:, None, k] ^ other[None, :, k])
            middle += own[:, None] * (theirs * (1 - differ * (2 / rows.width)))
    # The anchor with the row's remainder, and the anchor's remainder with the coded row.
    off = anchors.length[:, None] * (rows.left + SLACK * rows.length) + anchors.left[:, None] * (rows.length + rows.left)
    return middle - off, middle + off


def scores(anchors: Coded, rows: Coded, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs."""
    out, step = np.empty(len(a), np.int64), max(1, 2**22 // rows.width)
    for k in range(0, len(a), step):
        at = slice(k, k + step)
        out[at] = np.einsum("ij,ij->i", anchors.whole[a[at]], rows.whole[r[at]])
    return out


class Best:
    """The best ``most`` (score, id) of each group, of which new ones keep coming."""

    def __init__(self, groups: int, most: int):
        self.most, self.least = most, np.full(groups, NEVER)
        none = np.empty(0, np.int64)
        self.held, self.waiting, self.n = (none, none, none), [], 0

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fine = score >= self.least[group]
        self.waiting.append((group[fine], score[fine], ids[fine]))
        self.n += int(fine.sum())
        if self.n >= max(WAITING, len(self.least) * self.most):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.waiting:
            group, score, ids = (np.concatenate(c) for c in zip(self.held, *self.waiting))
            by = np.lexsort((ids, -score, group))
            group, score, ids = group[by], score[by], ids[by]
            first = np.searchsorted(group, group)
            nth = np.arange(len(group)) - first
            kept = nth < self.most
            last = nth == self.most - 1
            self.least[group[last]] = score[last]
            self.held, self.waiting, self.n = (group[kept], score[kept], ids[kept]), [], 0
        return self.held


def _prepared(scale: int):
    """vec_id, label, embedding -> vec_id, label, whole (int32 bytes) of the rows that take part."""

    def run(batches):
        for batch in slices(batches, 4096):
            keep, whole = [], []
            for k, x in enumerate(batch.column(2).to_pylist()):
                if x and len(x) <= WIDEST and None not in x:
                    v = np.floor(scale * np.array(x, np.float64))
                    if np.isfinite(v).all() and np.abs(v).max() < LARGEST:
                        keep.append(k)
                        whole.append(v.astype("<i4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(whole, pa.binary())], names=["vec_id", "label", "whole"])

    return run


def _by_width(ids, labels, raw: list[bytes], codes: int) -> Iterator[tuple[np.ndarray, Coded]]:
    """(places, vectors) for each width."""
    ids, labels, widths = np.asarray(ids, np.int64), np.asarray(labels, np.int64), np.array([len(x) for x in raw], np.int64)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        whole = np.frombuffer(b"".join(raw[k] for k in at), "<i4").reshape(len(at), -1).astype(np.int64)
        yield at, Coded(ids[at], labels[at], whole, codes)


def _parts(batches, anchors: int) -> Iterator[Coded]:
    """Coded rows of one width, so few that all pairs with the anchors fit."""
    for batch in slices(batches, min(ROWS, max(16, PAIRS // max(1, anchors)))):
        for _, rows in _by_width(batch.column(0), batch.column(1), batch.column(2).to_pylist(), ROW_CODES):
            yield rows


def _result(found, no: np.ndarray, names: list[str], *more):
    group, score, ids = found
    columns = [pa.array(no), *(pa.array(x) for x in more), pa.array(ids), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _best_same(anchors: list, most: int):
    """Rows -> the best of the same label for each anchor, as far as this task sees."""

    def run(batches):
        held, best = anchors.value, Best(anchors.value["n"], most)
        for rows in _parts(batches, held["n"]):
            for at, own in held["sets"]:
                if own.width != rows.width:
                    continue
                for label in np.intersect1d(own.labels, rows.labels):
                    a_at, r_at = np.flatnonzero(own.labels == label), np.flatnonzero(rows.labels == label)
                    some, few = own.part(a_at), rows.part(r_at)
                    _, high = intervals(some, few)
                    a, r = np.nonzero((high >= best.least[at[a_at]][:, None]) & (some.ids[:, None] != few.ids))
                    best.add(at[a_at[a]], scores(some, few, a, r), few.ids[r])
        found = best.merge()
        yield _result(found, found[0], ["no", "vec_id", "score"])

    return run


def _best_other(anchors: list, most: int, low: int):
    """Rows -> the best of other labels in the range of each anchor's positives, as far as this task sees."""

    def run(batches):
        held = anchors.value
        ranks, top = held["positives"].shape[1], held["positives"]
        there = held["there"] & (top >= 0)
        # Whole scores at least low hundredths of the positive's.
        floor = np.where(there, -((-low * top) // 100), 0)
        best = Best(held["n"] * ranks, most)
        for rows in _parts(batches, held["n"]):
            for at, own in held["sets"]:
                if own.width != rows.width:
                    continue
                some = there[at].any(1)
                at, own = at[some], own.part(some)
                open_low = np.where(there[at], np.maximum(floor[at], best.least.reshape(-1, ranks)[at]), np.iinfo(np.int64).max).min(1)
                open_high = np.where(there[at], top[at], NEVER).max(1)
                low_end, high_end = intervals(own, rows)
                near = (high_end >= open_low[:, None]) & (low_end <= open_high[:, None])
                a, r = np.nonzero(near & (own.labels[:, None] != rows.labels) & (own.ids[:, None] != rows.ids))
                score = scores(own, rows, a, r)
                for k in range(ranks):
                    fits = there[at[a], k] & (score >= floor[at[a], k]) & (score <= top[at[a], k])
                    best.add(at[a[fits]] * ranks + k, score[fits], rows.ids[r[fits]])
        found = best.merge()
        yield _result(found, found[0] // ranks, ["no", "nth", "vec_id", "score"], found[0] % ranks)

    return run


def _blocks(anchors: DataFrame, most: int) -> Iterator[list]:
    """Lists of at most ``most`` anchors, of which one partition at a time comes to the driver."""
    block = []
    for row in anchors.toLocalIterator():
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, at_once: int = ANCHORS_AT_ONCE) -> DataFrame:
    """``vectors`` (vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: a condition on vec_id and label that says which rows are anchors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and label is not null and embedding is not null")
    made = staged(rows.mapInArrow(_prepared(scale), "vec_id long, label long, whole binary"), "whole-vectors")
    path = staging_path(spark, "negatives")
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], names).write.parquet(path)
    for block in _blocks(made.where(anchor), at_once):
        sets = list(_by_width([b["vec_id"] for b in block], [b["label"] for b in block], [bytes(b["whole"]) for b in block], ANCHOR_CODES))
        held = spark.sparkContext.broadcast({"n": len(block), "sets": sets})
        found = made.mapInArrow(_best_same(held, positives), "no long, vec_id long, score long")
        order = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
        #: At most ``at_once * positives`` rows.
        best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).collect()
        top, there, ids = np.zeros((len(block), positives), np.int64), np.zeros((len(block), positives), bool), np.zeros((len(block), positives), np.int64)
        for r in best:
            top[r["no"], r["nth"] - 1], there[r["no"], r["nth"] - 1], ids[r["no"], r["nth"] - 1] = r["score"], True, r["vec_id"]
        both = spark.sparkContext.broadcast({"n": len(block), "sets": sets, "positives": top, "there": there})
        found = made.mapInArrow(_best_other(both, negatives, low), "no long, nth long, vec_id long, score long")
        order = Window.partitionBy("no", "nth").orderBy(F.desc("score"), "vec_id")
        kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        anchors = np.array([b["vec_id"] for b in block], np.int64)

        def named(batches, anchors=anchors, ids=ids, top=top):
            for batch in batches:
                no, nth, rank, neg, score = (np.asarray(c) for c in batch.columns)
                columns = [anchors[no], ids[no, nth], rank.astype(np.int32), neg, top[no, nth], score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        kept.select("no", "nth", "rank", "vec_id", "score").mapInArrow(named, names).write.mode("append").parquet(path)
        held.destroy()
        both.destroy()
    dropped(made)
    return spark.read.schema(names).parquet(path)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS whole
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id AS id, CAST(list_inner_product(a.whole, r.whole) AS BIGINT) AS score
  FROM vectors a JOIN vectors r ON r.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
