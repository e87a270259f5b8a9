"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from basketforge.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, no long, nth int, score string"


def brute(rows, positives=5, negatives=5, low=80, every=10):
    """(anchor, positive, rank, negative, scores) by comparing everything with everything."""
    whole = []
    for vec_id, label, v in rows:
        if vec_id is not None and label is not None and v and None not in v and all(math.isfinite(x) for x in v) and all(abs(math.floor(256 * x)) < H.LARGEST for x in v):
            whole.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, own, v in whole:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u)), b, other) for b, other, u in whole if b != a and len(u) == len(v))
        for minus, p, _ in [s for s in scored if s[2] == own][:positives]:
            fits = [s for s in scored if s[2] != own and low * -minus <= 100 * -s[0] <= 100 * -minus][:negatives]
            out += [(a, p, k + 1, n, -minus, -s) for k, (s, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, **more).collect())


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, width))
    return [(k, int(rng.integers(3)), (centres[rng.integers(8)] + 0.4 * rng.standard_normal(width)).round(3).tolist()) for k in range(n)]


def test_matches_brute_force(spark):
    rows = clustered(300, 20, 1)
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    # Blocks of anchors of any size give the same rows, and so do other bounds.
    assert mined(spark, rows, at_once=7) == want
    assert mined(spark, rows, positives=2, negatives=9, low=95) == brute(rows, 2, 9, 95)


def test_awkward_rows(spark):
    odd = [
        (1000, None, [1.0, 2.0]), (1010, 1, None), (None, 1, [1.0, 2.0]), (1020, 1, []), (1030, 1, [1.0, None]), (1040, 1, [float("nan"), 1.0]),
        (1050, 1, [float("inf"), 1.0]), (1060, 1, [3e30, 1.0]), (1070, 1, [0.0, 0.0]), (1071, 1, [0.0, 0.0]), (1072, 2, [0.0, 0.0]),
        (1080, 1, [1.0, -1.0]), (1081, 1, [-1.0, 1.0]), (1082, 2, [-0.9, 1.0]), (1090, 0, [1.0, 2.0, 3.0]), (1091, 0, [1.0, 2.0, 3.0]), (1092, 1, [1.0, 2.0, 2.9]),
    ]
    # Ties: one vector many times, under both labels, and a repeated row.
    odd += [(2000 + k, k % 2, [0.5, 0.25]) for k in range(40)] + [(2003, 1, [0.5, 0.25])]
    got = mined(spark, odd)
    assert got == brute(odd)
    assert {1070, 1090, 2000, 2010}.issubset({r[0] for r in got}) and not {1000, 1010, 1020, 1030, 1040, 1050, 1060}.intersection({r[0] for r in got})
    assert mined(spark, odd[:1]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_the_true_score():
    rng = np.random.default_rng(4)
    for width in (1, 3, 64, 65, 130):
        whole = rng.integers(-300, 300, (80, width))
        whole[:20] = whole[20:40] + rng.integers(-3, 4, (20, width))
        whole[79] = 0
        none = np.zeros(80, np.int64)
        low, high = H.intervals(H.Coded(none, none, whole, H.ANCHOR_CODES), H.Coded(none, none, whole, H.ROW_CODES))
        true = whole @ whole.T
        assert (low <= true).all() and (true <= high).all()
        lengths = np.sqrt((whole * whole).sum(1))
        # Without codes, Cauchy and Schwarz allow twice the product of both lengths.
        assert width < 64 or np.median((high - low)[:79, :79] / np.outer(lengths, lengths)[:79, :79]) < 0.9


def test_few_pairs_are_scored(monkeypatch):
    rows = clustered(6_000, 64, 3)
    seen = []
    monkeypatch.setattr(H, "scores", lambda a, r, i, j, whole=H.scores: seen.append(len(i)) or whole(a, r, i, j))

    class Held:
        def __init__(self, value):
            self.value = value

    import pyarrow as pa

    whole = [np.floor(256 * np.array(v)).astype("<i4").tobytes() for _, _, v in rows]
    sets = list(H._by_width([r[0] for r in rows[::300]], [r[1] for r in rows[::300]], whole[::300], H.ANCHOR_CODES))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array(whole)], names=["vec_id", "label", "whole"])
    list(H._best_same(Held({"n": 20, "sets": sets}), 5)(iter([batch])))
    pairs = sum(r[1] == a[1] for r in rows for a in rows[::300])
    # The first slice sets the bounds, so every row of it is scored.
    assert sum(seen) < 0.5 * pairs, (sum(seen), pairs)
