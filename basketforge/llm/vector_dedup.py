"""Embedding near-dedup by randomised-rotation binary codes.

A vector is rotated by a fixed random rotation and kept as the signs of its
coordinates, with a correction factor: the inner product of the vector with its
own code. The inner product of another rotated vector with the code, divided by
that factor, is an unbiased estimate of the vectors' inner product, with an error
whose confidence bound follows from the factor. Pairs whose bound lies below the
threshold are passed over; all others are computed again in double precision, and
only those at or over the threshold are linked.

Pairs are looked for among vectors that share a bucket: ``tables`` groups of
``bits`` signs under several rotations, with bits growing as the logarithm of the
number of vectors and tables chosen so that a pair at the threshold is met with
probability ``recall``. A pair met in several tables counts in the first alone.
Exact copies are one vector until the end. Buckets of over ``BLOCK`` rows are cut
into blocks, and every two blocks are compared. Buckets hold the sign codes alone;
vectors follow only for rows whose code differs from another's there in few enough
signs for the angle at the threshold (``SIGN_DEVIATIONS``), so that what is
shuffled with every table is a few bytes a row.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different widths never link; a null
vec_id has no component and is not kept; repeated rows are linked copies; extra
columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketforge.llm.components import connected_components
from basketforge.session import staged
from basketforge.sources.tables import table

COSINE = 0.95
RECALL = 0.999
#: Width of the confidence bound, in deviations of the estimate.
DEVIATIONS = 4.0
#: Deviations of the number of differing signs, at the threshold's angle, beyond which a pair is passed over.
SIGN_DEVIATIONS = 5.0
SEED = 20_240_607
BLOCK = 1_500
GROUP_ROWS = 5_000


@lru_cache(maxsize=64)
def rotation(width: int, nth: int) -> np.ndarray:
    """The nth random rotation of the given width; the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, width, nth]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def plan(vectors: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(4, min(30, round(math.log2(max(vectors, 2))) - 3))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def table_keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables): the sign bits of each table."""
    width = unit.shape[1]
    bits = min(bits, width)
    each = width // bits
    out = np.empty((len(unit), tables), np.int64)
    for nth in range(-(-tables // each)):
        signs = (unit @ rotation(width, nth + 1)) >= 0
        for k in range(min(each, tables - nth * each)):
            out[:, nth * each + k] = signs[:, k * bits : (k + 1) * bits] @ (1 << np.arange(bits))
    return out


class Codes:
    """Sign codes of unit vectors, their correction factors and error bounds."""

    def __init__(self, unit: np.ndarray):
        width = unit.shape[1]
        self.turned = unit @ rotation(width, 0)
        self.signs = np.where(self.turned >= 0, 1.0, -1.0) / math.sqrt(width)
        self.factor = np.maximum((self.turned * self.signs).sum(1), 1e-9)
        self.error = np.sqrt(np.maximum(0.0, 1 - self.factor**2)) / self.factor / math.sqrt(max(1, width - 1))

    def upper(self, i: np.ndarray, j: np.ndarray, deviations: float) -> np.ndarray:
        """Upper confidence bounds of the inner products of pairs (i, j)."""
        one = (self.signs[i] * self.turned[j]).sum(1) / self.factor[i]
        two = (self.signs[j] * self.turned[i]).sum(1) / self.factor[j]
        return (one + two) / 2 + deviations * (self.error[i] + self.error[j]) / 2


def _prepared(batches):
    """vec_id, vector -> vec_id, hash of the vector (null where it can link with nothing), float64 bytes."""
    for batch in batches:
        one, two, raw = [], [], []
        for x in batch.column(1).to_pylist():
            v = np.array(x, np.float64) if x and None not in x else np.empty(0)
            fine = len(v) > 0 and np.isfinite(v).all() and v.any()
            data = (v + 0.0).tobytes() if fine else None
            h = xxhash.xxh3_128_intdigest(data) if fine else None
            one.append(None if h is None else (h >> 64) - 2**63)
            two.append(None if h is None else (h & (2**64 - 1)) - 2**63)
            raw.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "h1", "h2", "raw"])


def _unit(raw) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _bucketed(bits: int, tables: int):
    """id, vector -> one row for each table: id, nth, bucket, sign code."""

    def run(batches):
        for batch in batches:
            ids, raw = np.array(batch.column(0)), batch.column(1).to_pylist()
            widths = np.array([len(x) for x in raw], np.int64)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                # Few rows at a time: each is written once for each table.
                for part in np.array_split(at, -(-len(at) // 1024)):
                    unit = _unit([raw[k] for k in part])
                    keys = table_keys(unit, bits, tables)
                    mixed = (keys * tables + np.arange(tables)) * 4096 + width % 4096
                    signs = np.packbits(unit @ rotation(unit.shape[1], 0) >= 0, axis=1)
                    codes = pa.array([x.tobytes() for x in signs], pa.binary())
                    rows = np.repeat(np.arange(len(part)), tables)
                    columns = [pa.array(ids[part][rows]), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(mixed.ravel()), codes.take(pa.array(rows))]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "nth", "bucket", "code"])

    return run


def most_signs(width: int, cosine: float) -> float:
    """The most signs of ``width`` in which a pair at the threshold is expected to differ."""
    apart = math.acos(cosine) / math.pi
    return width * apart + SIGN_DEVIATIONS * math.sqrt(width * apart * (1 - apart))


def with_near_codes(group: np.ndarray, side: np.ndarray, codes: np.ndarray, most: float) -> np.ndarray:
    """Of rows in order of ``group``, those whose code is near another's of the group (of another side, where sides are given)."""
    _, sizes = np.unique(group, return_counts=True)
    found = np.zeros(len(group), bool)
    for k in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            break
        i = i[(side[i] < 0) | (side[i] != side[i + k])]
        near = i[np.bitwise_count(codes[i] ^ codes[i + k]).sum(1) <= most]
        found[near] = found[near + k] = True
    return found


def link_group(ids: np.ndarray, nth: np.ndarray, group: np.ndarray, side: np.ndarray, unit: np.ndarray, bits: int, tables: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows that share ``group`` (and, where sides are given, differ in side), first tables only."""
    order = np.argsort(group, kind="stable")
    ids, nth, group, side, unit = ids[order], nth[order], group[order], side[order], unit[order]
    codes, keys = Codes(unit), table_keys(unit, bits, tables)
    _, sizes = np.unique(group, return_counts=True)
    left, right = [], []
    for k in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(group[:-k] == group[k:])
        if not len(i):
            break
        j = i + k
        meet = (side[i] < 0) | (side[i] != side[j])
        i, j = i[meet], j[meet]
        near = codes.upper(i, j, DEVIATIONS) >= cosine
        i, j = i[near], j[near]
        exact = (unit[i] * unit[j]).sum(1) >= cosine
        i, j = i[exact], j[exact]
        if len(i):
            before = np.arange(tables)[None, :] < nth[i][:, None]
            first = ~((keys[i] == keys[j]) & before).any(1)
            left.append(order[i[first]])
            right.append(order[j[first]])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Node -> smallest node linked with it, over the pairs of one task."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vectors`` (vec_id, embedding) -> vec_id, n_links, component_id, kept; one row per vector."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    made = staged(rows.mapInArrow(_prepared, "vec_id long, h1 long, h2 long, raw binary"), "vectors")
    whole = ["h1", "h2"]
    classes = made.where("vec_id is not null and h1 is not null").groupBy(*whole).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = staged(classes, "vector-classes")
    bits, tables = plan(classes.count(), cosine, recall)
    placed = classes.select("id", "raw").mapInArrow(_bucketed(bits, tables), "id long, nth int, bucket long, code binary")
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    large = staged(sizes.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large-buckets")
    many = placed.join(large, "bucket", "left")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    many = many.withColumn("own", own).withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(others)))
    side = F.when(F.col("pair.i") == F.col("pair.j"), F.lit(-1)).otherwise(F.col("own"))
    many = many.select("id", "nth", "code", side.alias("side"), F.xxhash64("bucket", "pair.i", "pair.j").alias("group"))
    groups = max(1, made.count() * tables // GROUP_ROWS)

    def near(pdf):
        pdf, out = pdf.sort_values("group", kind="stable"), []
        for size, own in pdf.groupby(pdf["code"].map(len), sort=False):
            codes = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
            out.append(own[with_near_codes(own["group"].to_numpy(), own["side"].to_numpy(), codes, most_signs(8 * size, cosine))])
        import pandas as pd

        return (pd.concat(out) if out else pdf)[["id", "nth", "side", "group"]]

    def linked(pdf):
        import pandas as pd

        out = []
        for _, own in pdf.groupby(pdf["raw"].map(len), sort=False):
            ids, copies = own["id"].to_numpy(np.int64), own["copies"].to_numpy(np.int64)
            i, j = link_group(ids, own["nth"].to_numpy(), own["group"].to_numpy(np.int64), own["side"].to_numpy(), _unit(list(own["raw"])), bits, tables, cosine)
            if len(i):
                who, back = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
                n = np.bincount(back, np.concatenate([copies[j], copies[i]]), len(who)).astype(np.int64)
                out.append(pd.DataFrame({"a": who, "b": who, "n": n}))
                roots = {x: r for x, r in _roots(ids[i], ids[j]).items() if x != r}
                out.append(pd.DataFrame({"a": list(roots), "b": list(roots.values()), "n": 0}, dtype="int64"))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")

    met = many.groupBy(F.pmod("group", F.lit(groups)).alias("g")).applyInPandas(near, "id long, nth int, side int, group long")
    met = staged(met, "near-codes").join(classes.select("id", "raw", "copies"), "id")
    found = met.groupBy(F.pmod("group", F.lit(groups)).alias("g")).applyInPandas(linked, "a long, b long, n long")
    found = staged(found, "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    joined = connected_components(found.where("a <> b").select("a", "b"))
    known = classes.select(*whole, "id", "copies").join(counts, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    known = known.select(*whole, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    out = made.select("vec_id", *whole).join(known, whole, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op7_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings"))
