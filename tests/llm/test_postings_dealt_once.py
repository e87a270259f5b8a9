"""The prefix join of lines deals its postings by word once, for both of its sides."""

from basketforge.llm import line_dedup as L
from basketforge.session import ALL_JOIN_KEYS


def _plan_of_pairs(spark, monkeypatch, n: int):
    """The pairs of four classes that share their prefix, and the plan they were made by."""
    made = []
    monkeypatch.setattr(L, "staged", lambda df, name, *switches: made.append((df, switches)) or df)
    rows = [(k, 1, 0, 0, n, [11, 12, 13], k) for k in range(4)]
    classes = spark.createDataFrame(rows, "cid long, copies long, sketch long, upper long, n int, prefix array<int>, order long")
    removed = spark.createDataFrame([(1,), (2,)], "cid long")
    L.LineDedup()._prefix_pairs(classes, removed)
    ((df, switches),) = made
    for k, v in (switches[0] if switches else {}).items():
        spark.conf.set(k, v)
    try:
        pairs = sorted((r.a, r.b) for r in df.collect())
    finally:
        spark.conf.unset(ALL_JOIN_KEYS)
    return pairs, df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]


def test_postings_are_dealt_once(spark, monkeypatch):
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs, plan = _plan_of_pairs(spark, monkeypatch, 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert pairs == [(0, 3), (1, 3), (2, 3)]
    assert "ReusedExchange" in plan
    assert "hashpartitioning(word" in plan and "mark" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
