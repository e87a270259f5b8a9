"""Histories of numbered products give the grids of those whose products are numbered late."""

from basketforge.operators import sequences as S
from basketforge.operators import temporal as T


def test_numbered_histories_give_the_same_grid(spark):
    meta = spark.createDataFrame([("a", k, k) for k in range(1, 7)] + [("b", 9, 1), (None, 10, 1)], "customer_id string, basket_id long, week int")
    products = spark.createDataFrame([(k, list("zyxw")[: k % 4]) for k in range(1, 7)] + [(9, ["z"])], "basket_id long, products array<string>")
    vocab = S.build_vocab(spark.createDataFrame([(v,) for v in "wyz"], "v string"), "v")
    want = {r.basket_id: r.grid for r in S.encode_history(T.customer_histories(meta, products), vocab, 3, 2).collect()}
    numbered = S.encode_products(products, vocab, "basket_id", "products").withColumnRenamed("ids", "products")
    rows = S.latest_rows(T.customer_histories(meta, numbered), 3, 2)
    got = {r.basket_id: r for r in rows.select("basket_id", S.padded_grid(rows["rows"], 3, 2).alias("grid"), S.grid_text(rows["rows"], 3, 2).alias("text")).collect()}
    assert want == {2: [[3, 0], [0, 0], [0, 0]], 3: [[3, 0], [3, 2], [0, 0]], 4: [[3, 0], [3, 2], [3, 2]], 5: [[3, 0], [3, 2], [3, 2]], 6: [[3, 2], [3, 2], [3, 0]]}
    assert {k: r.grid for k, r in got.items()} == want
    assert {k: r.text for k, r in got.items()} == {k: ",".join(str(x) for row in g for x in row) for k, g in want.items()}
    ragged = {r.basket_id: r for r in S.mask_history(rows, 99, 0.5).collect()}
    whole = {r.basket_id: r for r in S.mask_history(rows.select("basket_id", S.padded_grid(rows["rows"], 3, 2).alias("grid")), 99, 0.5).collect()}
    for k, r in whole.items():
        assert all(row[: len(cut)] == cut for a, b in ((r.masked, ragged[k].masked), (r.labels, ragged[k].labels)) for row, cut in zip(a, b))
