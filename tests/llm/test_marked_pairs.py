"""Candidate pairs of lines come from one join by word and mark, without a filter of words beside it."""

from basketforge.llm import line_dedup as L


def test_no_pair_has_a_removed_later_line(spark, monkeypatch):
    def unused(*args):
        raise AssertionError("words are filtered before they are joined")

    monkeypatch.setattr(L, "maybe_in", unused)
    rows = [(k, 1, 0, 0, 10, [11, 12, 13], k) for k in range(4)]
    classes = spark.createDataFrame(rows, "cid long, copies long, sketch long, upper long, n int, prefix array<int>, order long")
    removed = spark.createDataFrame([(1,), (2,)], "cid long")
    pairs = {(r.a, r.b) for r in L.LineDedup()._prefix_pairs(classes, removed).collect()}
    assert pairs == {(0, 3), (1, 3), (2, 3)}
    none = L.LineDedup()._prefix_pairs(classes, removed.where("cid < 0")).collect()
    assert {(r.a, r.b) for r in none} == {(a, b) for b in range(4) for a in range(b)}
