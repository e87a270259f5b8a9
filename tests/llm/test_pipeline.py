"""The pipeline's stages against brute force on the given small tables, and on awkward rows."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_llm_operators import AWKWARD, MORE, best_fit_decreasing, expected_groups, near_copies, removed_lines, table

import corpus_pipeline as C
from basketforge.llm import quality, tokens

FUNCTIONS = dict(C.STAGES)


@pytest.fixture(scope="module")
def made(spark, small):
    """Given documents, near copies among them, and passages of the benchmark."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()[:120]
    passage = duckdb.sql(f"SELECT text FROM '{small}/benchmark.parquet' ORDER BY item_id LIMIT 1").fetchall()[0][0]
    more = near_copies(25, 60, 2, 4) + [f"{rows[3][1]} {passage} {rows[4][1]}"] + ["same words here and there again\nsame words here and there again"] * 2
    rows += [(50_000 + k, t, "en", "made", len(t)) for k, t in enumerate(more)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def texts_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages_match_brute_force(spark, small, made):
    docs = made
    weights = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    kept = FUNCTIONS["quality classifier"](spark, docs, small)
    assert texts_of(kept) == [(d, t) for d, t in texts_of(docs) if quality.score_text(t, weights) >= quality.ACCEPT]
    assert kept.columns == docs.columns

    gone = removed_lines(texts_of(docs))
    cleaned = FUNCTIONS["line dedup"](spark, docs, small)
    want = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ()))) for d, t in texts_of(docs)]
    assert texts_of(cleaned) == want and cleaned.columns == docs.columns

    groups = expected_groups(texts_of(docs), 5, 4, 5)
    single = FUNCTIONS["n-gram Jaccard join"](spark, docs, small)
    assert texts_of(single) == [(d, t) for d, t in texts_of(docs) if groups[d][1] == d] and single.count() < docs.count()

    items = [words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    clean = FUNCTIONS["benchmark decontamination"](spark, docs, small)

    def leaks(text):
        own = words(text)
        return any(tuple(own[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(own) - n + 1))

    assert texts_of(clean) == [(d, t) for d, t in texts_of(docs) if not leaks(t)] and clean.count() < docs.count()

    enc = tokens.encoder(tokens.default_tokenizer()).tokenizer
    lengths = [len(enc.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts_of(docs)]
    pieces = [min(2048, n - k) for n in lengths for k in range(0, n, 2048)]
    packed = FUNCTIONS["best-fit packing"](spark, docs, small).collect()
    assert sorted(r.length for r in packed) == sorted(pieces) and len({r.sequence_id for r in packed}) == best_fit_decreasing(pieces, 2048)


def test_run_is_its_stages_one_after_the_other(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    digest = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert digest(C.run(spark, small)) == digest(docs) != Counter()


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_awkward_rows_in_every_stage(spark, small, name):
    rows = table(spark, [*AWKWARD, (7, "one two"), (None, None)])
    out = FUNCTIONS[name](spark, rows, small)
    if name != "best-fit packing":
        assert out.columns == rows.columns
    got = Counter(r.doc_id for r in out.collect())
    assert set(got) <= {None, *range(1, 8)}
    if name == "n-gram Jaccard join":
        # The repeated row and its copy are one document; rows without doc_id stay.
        assert got == Counter([None, None, 1, 2, 3, 4, 5, 6])
    elif name in ("line dedup", "benchmark decontamination"):
        assert got == Counter([*(k for k, _ in AWKWARD), 7, None])
    elif name == "best-fit packing":
        assert sum(np.array([r.piece for r in out.collect()]) == 0) == len(AWKWARD) + 2
    assert FUNCTIONS[name](spark, spark.createDataFrame([], MORE), small).count() == 0
