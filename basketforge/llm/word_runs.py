"""Periodic runs of words, found by internal pattern matching, and texts with their repeats cut out.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and a length of at least ``max(LEAST, 2 * q)`` that no neighbouring word
extends. Such a run holds a dyadic block (a stretch whose length is a power of two
and whose start is a multiple of it, or of half of it for the shortest) that occurs
again q words later. So for every dyadic block its occurrences in the neighbouring
window are asked for:

* The suffix array comes from doubling: after each step, places whose stretches of
  2^k words are equal share a rank, which is also where their range in the array
  begins. The ranks are kept, and give the length of a common extension in either
  direction by halving.
* A wavelet tree over the array answers, for a block's range, which occurrence comes
  next after a place (range successor).
* Occurrences that lie closer than half a block form a progression whose difference
  is the block's period. Of a progression only those members are candidates that align
  the ends of the two stretches with that period, or all where the stretches touch.

Every candidate period is then extended both ways, so that what is returned are runs
and nothing else; of equal stretches the smallest period stays.

Documents are worked on in slices of about ``SLICE_WORDS`` words, each word numbered
by its document, so nothing crosses documents; a longer document is a slice by itself
and takes some 8 bytes a word for each doubling that its repeats need (its words
number less than 2^31).

Defined cases: null, empty and blank texts have no words and no run; a null doc_id is
kept, and its text is not made periodic by the query's rule; repeated rows are
answered each; of runs of equal length the one with the smallest start, then period,
is the longest; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.llm.batches import slices
from basketforge.sources.tables import table

#: Least length of a run, in words. The shortest blocks assume at least 11.
LEAST = 12
#: The shortest block has 2^2 words; it finds periods up to SHORT_SHIFT.
SHORT_LEVEL, SHORT_SHIFT = 2, 14
SLICE_WORDS = 100_000


class Ranks:
    """Ranks of all stretches of 2^k items, and the suffix array: by doubling, until all differ."""

    def __init__(self, items: np.ndarray):
        n = self.n = len(items)
        order = np.argsort(items, kind="stable")
        rank, size = np.empty(n, np.int32), np.empty(n, np.int32)
        self._place(rank, size, order, items[order], np.zeros(n, np.int64), np.arange(n))
        self.levels, self.sizes = [rank], [size]
        self.order = order.copy()
        while (size > 1).any() and 1 << len(self.levels) - 1 < n:
            step = 1 << len(self.levels) - 1
            rank, size = rank.copy(), size.copy()
            own = np.flatnonzero(size > 1)
            after = np.full(len(own), -1, np.int64)
            inside = own + step < n
            after[inside] = self.levels[-1][own[inside] + step]
            key = rank[own].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            own, key = own[by], key[by]
            base = rank[own]
            first = np.flatnonzero(np.r_[True, base[1:] != base[:-1]]) if len(own) else np.empty(0, np.int64)
            offset = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            self._place(rank, size, own, key, base, offset)
            self.order[base + offset] = own
            self.levels.append(rank)
            self.sizes.append(size)

    @staticmethod
    def _place(rank, size, own, key, base, offset) -> None:
        """Ranks (and group sizes) of ``own``, in the order of ``key``: the place where its group begins."""
        if not len(own):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        many = np.diff(np.r_[first, len(own)])
        rank[own] = np.repeat((base + offset)[first], many)
        size[own] = np.repeat(many, many)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items from i and j on are equal."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, fits = self.levels[k], np.maximum(i, j) < self.n
            same = fits & (level[np.where(fits, i, 0)] == level[np.where(fits, j, 0)])
            # Equal ranks of a stretch that the array's end cuts off are those of the place itself.
            i, j = i + (same << k), j + (same << k)
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many items just before i and j are equal."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, fits = self.levels[k], np.minimum(i, j) >= 1 << k
            same = fits & (level[np.where(fits, i - (1 << k), 0)] == level[np.where(fits, j - (1 << k), 0)])
            i, j = i - (same << k), j - (same << k)
        return start - i


class WaveletTree:
    """Over values below 2^bits: for ranges of places, the smallest value not below a bound."""

    def __init__(self, values: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.zeros = []
        now = values
        for k in range(self.bits - 1, -1, -1):
            one = (now >> k) & 1
            self.zeros.append(np.r_[0, np.cumsum(1 - one)])
            now = np.concatenate([now[one == 0], now[one == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of places low..high are less than ``bound``."""
        all_of, count = high - low, np.zeros(len(low), np.int64)
        for k, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = ((bound >> k) & 1).astype(bool)
            count += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return np.where(bound >> self.bits > 0, all_of, count)

    def nth(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest value (from 0) of places low..high; -1 where there are not so many."""
        there, value = nth < high - low, np.zeros(len(low), np.int64)
        for k, zeros in zip(range(self.bits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = nth >= b - a
            value |= one.astype(np.int64) << k
            nth = np.where(one, nth - (b - a), nth)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return np.where(there, value, -1)

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value of places low..high that is at least ``bound``; -1 where there is none."""
        return self.nth(low, high, self.below(low, high, bound))


def _candidates(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): every run has one of its places here with its period."""
    none = np.empty(0, np.int64)
    if len(ranks.levels) <= SHORT_LEVEL:
        return none, none
    repeated = ranks.sizes[SHORT_LEVEL][ranks.order] > 1
    if not repeated.any():
        return none, none
    # Only suffixes whose shortest stretch occurs again matter: the tree is built over those.
    place = np.r_[0, np.cumsum(repeated)]
    tree = WaveletTree(ranks.order[repeated], ranks.n)
    at, periods = [], []
    for k in range(SHORT_LEVEL, len(ranks.levels)):
        long, rank, size = 1 << k, ranks.levels[k], ranks.sizes[k]
        stride = long // 2 if k == SHORT_LEVEL else long
        block = np.arange(0, ranks.n, stride)
        block = block[size[block] > 1]
        if not len(block):
            break
        low, high = place[rank[block]], place[rank[block] + size[block]]
        if k == SHORT_LEVEL:
            now, own = block, np.arange(len(block))
            while len(own):
                now = tree.successor(low[own], high[own], now + 1)
                near = (now >= 0) & (now - block[own] <= SHORT_SHIFT)
                now, own = now[near], own[near]
                at.append(block[own]), periods.append(now - block[own])
            continue
        for first in range(2 * long - 1, 4 * long - 1, long // 2):
            start, end = block + first, block + min(first + long // 2, 4 * long - 1)
            one = tree.successor(low, high, start)
            own = np.flatnonzero((one >= 0) & (one < end))
            if not len(own):
                continue
            one = one[own]
            two = tree.successor(low[own], high[own], one + 1)
            lone = (two < 0) | (two >= end[own])
            at.append(block[own][lone]), periods.append(one[lone] - block[own][lone])
            if lone.all():
                continue
            own, one, gap = own[~lone], one[~lone], (two - one)[~lone]
            b = block[own]
            # The stretches with the progression's period around the block and around its occurrences.
            s1, e1 = b - ranks.behind(b, b + gap), b + gap + ranks.ahead(b, b + gap)
            s2, e2 = one - ranks.behind(one, one + gap), one + gap + ranks.ahead(one, one + gap)
            for q in (e2 - e1, s2 - s1):
                at.append(b[q > 0]), periods.append(q[q > 0])
            meet = (e1 >= s2) & (s1 != s2)
            last = np.minimum(end[own] - 1, e2 - long)
            many = np.where(meet, (last - one) // gap + 1, 0)
            again = np.repeat(np.arange(len(own)), many)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            at.append(b[again]), periods.append(one[again] + nth * gap[again] - b[again])
    return (np.concatenate(at), np.concatenate(periods)) if at else (none, none)


def runs_of(items: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    if len(items) < least:
        return np.empty((0, 3), np.int64)
    ranks = Ranks(items)
    at, period = _candidates(ranks)
    inside = at + period < ranks.n
    at, period = at[inside], period[inside]
    start, end = at - ranks.behind(at, at + period), at + period + ranks.ahead(at, at + period)
    fine = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[fine], end[fine], period[fine]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    smallest = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.empty(0, bool)
    found = np.column_stack([start, end - start, period])[smallest]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query looks at: one document in ten repeats a part of itself from some word on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _grouped(rows: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows in groups of about ``most`` words."""
    group, words = [], 0
    for row in rows:
        group.append(row)
        words += len(row[1])
        if words >= most:
            yield group
            group, words = [], 0
    if group:
        yield group


def word_runs(docs: DataFrame, least: int = LEAST, planted: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_words, runs (array of start, length, period), collapsed (the text without repeats).

    ``planted``: first apply the query's rule that makes some documents periodic.
    """

    def read(batches):
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()
                yield doc_id, made_periodic(doc_id, words) if planted else words

    def run(batches):
        for group in _grouped(read(batches), SLICE_WORDS):
            ends = np.cumsum([len(words) for _, words in group])
            # A word's number is the place where its document has it first.
            numbers = [np.fromiter(map({}.setdefault, words, range(end - len(words), end)), np.int64, len(words)) for (_, words), end in zip(group, ends.tolist())]
            found = runs_of(np.concatenate(numbers), least)
            cuts = np.searchsorted(found[:, 0], ends)
            out = []
            for (doc_id, words), low, high, start in zip(group, np.r_[0, cuts[:-1]], cuts, np.r_[0, ends[:-1]]):
                own = found[low:high] - np.array([start, 0, 0])
                kept = words if not len(own) else [words[k] for k in np.flatnonzero(kept_words(len(words), own))]
                out.append((doc_id, len(words), own, b" ".join(kept)))
            sizes = np.cumsum([0, *(len(own) for _, _, own, _ in out)])
            flat = np.concatenate([own for _, _, own, _ in out])
            each = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            columns = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each), pa.array([x[3] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    # Words are bytes between ASCII white space, so texts are read as they are stored.
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    made = rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def op12_word_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = word_runs(table(spark, folder, "documents"), planted=True)
    key = F.transform("runs", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    first = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.array_min(key).alias("most"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length = -F.col("most.length")
    return first.select("doc_id", "n_runs", F.col("most.start").alias("start"), length.alias("length"), F.col("most.period").alias("period"), F.expr("(-most.length * 1000) div most.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
