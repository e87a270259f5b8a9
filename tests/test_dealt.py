"""Tasks follow the rows of a table, and pairs come from lists: no table is joined with itself."""

import re

from test_rules import lines

from basketforge import session
from basketforge.operators import graph as G
from basketforge.sources.transactions import transactions


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_their_number(spark, small, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rows = spark.read.parquet(f"{small}/lineitem.parquet").count()
    dealt = transactions(spark, small)
    assert {int(n) for n in re.findall(r"hashpartitioning\([lo]_orderkey#\d+L?, (\d+)\)", _plan(dealt))} == {-(-rows // 100)}
    monkeypatch.undo()
    assert "REPARTITION" not in _plan(transactions(spark, small))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, transactions(spark, small).collect()))


def test_pairs_without_a_self_join(spark):
    tx = lines(spark, [dict(BASKET_ID=b, LINE_SEQ=k, PROD_CODE=p, CUST_CODE="C1") for b, ps in ((1, "BAAC"), (2, "AB"), (3, "C")) for k, p in enumerate(ps)])
    pairs = G.basket_pairs(tx)
    assert "Join" not in _plan(pairs)
    assert {(r.product_a, r.product_b): r.pair_count for r in pairs.collect()} == {("A", "B"): 2, ("A", "C"): 1, ("B", "C"): 1}
    assert {(r.product_a, r.product_b): r.pair_count for r in G.basket_pairs(tx, 2).collect()} == {("A", "B"): 2}
