"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so documents of one length are
interchangeable. The plan is therefore made over the histogram of lengths
(``capacity`` numbers at most, whatever the size of the corpus): for each length
in decreasing order the tree gives the tightest open remaining capacity, and a
run of equal bins is filled at once. Documents then find their place by their
number among those of the same length, which Spark counts per partition. The
result is that of best-fit decreasing over all documents together.

Defined cases: null text is an empty document of the end token alone; empty
tables give no rows; repeated rows are packed once each; a null doc_id is
carried along; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketforge.llm import tokens
from basketforge.session import staged
from basketforge.sources.tables import table

CAPACITY = 2048
END_ID = 0


class CapacityTree:
    """Segment tree: how many open bins have each remaining capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        at = self.size + remaining
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: count}.

    Returns runs (length, first, count, sequence, per, offset): of the documents
    of that length, numbers first .. first+count-1 go ``per`` to a sequence from
    ``sequence`` on, the first of each at ``offset``.
    """
    tree, open_bins, runs, made = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                start, bins, room = made, -(-left // (capacity // length)), capacity
                made += bins
            else:
                start, bins = open_bins[room].pop()
                tree.add(room, -bins)
            per = room // length
            used = min(bins, -(-left // per))
            if used < bins:
                open_bins.setdefault(room, []).append((start + used, bins - used))
                tree.add(room, bins - used)
            placed = min(left, used * per)
            runs.append((length, first, placed, start, per, capacity - room))
            full = used if placed == used * per else used - 1
            for at, n, items in ((start, full, per), (start + full, used - full, placed - full * per)):
                rest = room - items * length
                if n and rest:
                    open_bins.setdefault(rest, []).append((at, n))
                    tree.add(rest, n)
            left, first = left - placed, first + placed
    return runs


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    def cut(batches):
        enc, part, seen = tokens.encoder(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, high, ids, ends in enc.column(batch.column(1), end_id):
                out: list[tuple] = []
                first = 0
                for doc_id, end in zip(doc_ids[low:high], ends.tolist()):
                    for k, start in enumerate(range(first, end, capacity)):
                        piece = ids[start : min(start + capacity, end)]
                        nth = seen[len(piece)] = seen.get(len(piece), -1) + 1
                        out.append((doc_id, k, start - first, len(piece), tokens.crc(piece), part, nth) + ((piece.tolist(),) if keep_ids else ()))
                        if keep_ids and len(out) >= 512:
                            yield _batch(out, keep_ids)
                            out = []
                    first = end
                yield _batch(out, keep_ids)

    return cut


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    kinds += [("ids", pa.list_(pa.int32()))] * keep_ids
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and the ids themselves with ``keep_ids``. Documents longer than the
    capacity are cut into full pieces and a last shorter one.
    """
    spark, schema = docs.sparkSession, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
    cut = _pieces(tokenizer or tokens.default_tokenizer(), end_id, capacity, keep_ids)
    pieces = staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema + ", ids array<int>" * keep_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    #: At most ``capacity`` rows come to the driver, for any number of documents.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(pack_lengths(histogram, capacity))
    bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    bases = bases.select("part", "length", F.coalesce("base", F.lit(0)).alias("base"))
    plan = spark.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 6))
    place = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(place)
    def placed(length, number):
        import pandas as pd

        runs = plan.value
        # Runs are sorted by (length, first): one key finds the run of each document.
        wide = int(runs[:, 1].max(initial=0)) + 1 if len(runs) else 1
        lengths, numbers = length.to_numpy(np.int64), number.to_numpy(np.int64)
        low = np.searchsorted(runs[:, 0], lengths, "left")
        high = np.searchsorted(runs[:, 0], lengths, "right")
        at = low.copy()
        if wide < 2**50:
            at = np.searchsorted(runs[:, 0] * wide + runs[:, 1], lengths * wide + np.minimum(numbers, wide - 1), "right") - 1
        else:
            for k in range(len(at)):
                at[k] = low[k] + np.searchsorted(runs[low[k] : high[k], 1], numbers[k], "right") - 1
        run = runs[at]
        inside = numbers - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 3] + inside // run[:, 4], "offset": run[:, 5] + (inside % run[:, 4]) * lengths})

    out = pieces.join(bases, ["part", "length"]).withColumn("at", placed("length", F.col("base") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), keep_ids=False)
