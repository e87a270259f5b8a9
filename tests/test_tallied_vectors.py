"""Vectors made of labels are checked once for all baskets of the same labels."""

import pytest
from pyspark.sql import functions as F

from basketforge.operators import quality as Q
from basketforge.operators import vectors as V


def test_tallied_check_is_that_of_all_rows(spark):
    labels = [("Top Up", "Fresh", "LA", "S")] * 5 + [("Emergency", "Mixed", "UM", None)] * 2 + [(None, "Fresh", "MM", "L")]
    baskets = spark.createDataFrame([(k, *x) for k, x in enumerate(labels)], ["BASKET_ID", *V.TRIP_LABELS])
    tallied = V.tallied_vectors(baskets, V.TRIP_LABELS, F.concat(*V.mission_embeddings()))
    assert tallied.count() == 3
    want = Q.vector_check(V.trip_context(baskets), 48).first().asDict()
    assert Q.vector_check(tallied, 48, times="times").first().asDict() == pytest.approx(want)


def test_bad_numbers_count_as_often_as_their_vector(spark):
    df = spark.createDataFrame([([1.0, float("nan")], 3), ([1.0, None], 2), ([1.0], 4)], "vector array<double>, times long")
    got = Q.vector_check(df, 2, times="times").first()
    assert (got.rows, got.wrong_width, got.bad) == (9, 4, 5)
