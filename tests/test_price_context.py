"""Vectors of prices meet baskets where they are."""

import re

from basketforge import session
from basketforge.plans import all_queries, sample_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_price_vectors_are_not_dealt_by_basket(spark, small, monkeypatch):
    want = sorted(map(tuple, all_queries()["j14_price_context"](spark, small).collect()))
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    plans = []

    def seen(df, name, switches=None):
        before = {k: spark.conf.get(k) for k in switches or {}}
        for k, v in (switches or {}).items():
            spark.conf.set(k, v)
        plans.append(_plan(df.select("*")))
        for k, v in before.items():
            spark.conf.set(k, v)
        return session.staged(df, name, switches)

    monkeypatch.setattr(sample_queries, "staged", seen)
    got = sorted(map(tuple, all_queries()["j14_price_context"](spark, small).collect()))
    assert got == want
    (plan,) = plans
    assert not re.search(r"Exchange hashpartitioning\([^)]*(?i:basket_id)", plan)
    assert len(re.findall(r"Exchange hashpartitioning\(store_id#\d+, week#\d+, 12\)", plan)) == 2
    assert spark.conf.get(session.ALL_JOIN_KEYS) == "true"
