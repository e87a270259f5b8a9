"""Staged tables, tables computed once, and numbering by ranges."""

import os

from pyspark.sql import functions as F

from basketforge import session
from basketforge.operators.sequences import numbered


def test_staged_tables_can_be_dropped(spark):
    made = session.staged(spark.range(10), "numbers")
    path = session._places[made].removeprefix("file://")
    assert made.count() == 10 and os.path.isdir(path)
    session.dropped(made, None)
    assert not os.path.exists(path)
    session.dropped(made)


def test_shared_tables_are_made_once_in_a_call(spark):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    def query(*_):
        a, b = (session.once("numbers", make, "folder") for _ in range(2))
        return a.join(b, "id")

    assert query().count() == 3 and len(calls) == 2
    assert session.computed_once(query)(spark, "folder").count() == 3 and len(calls) == 3


def test_numbering_by_ranges_is_that_of_a_window(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("k")).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    for by in ([], ["g"]):
        want = {}
        for r in sorted(rows.collect(), key=lambda r: r.k):
            own = want.setdefault(r.g if by else 0, [])
            own.append(r.k)
        got = {(r.g if by else 0, r.nth): r.k for r in numbered(rows, ["k"], by).collect()}
        assert got == {(g, n): k for g, own in want.items() for n, k in enumerate(own)}
