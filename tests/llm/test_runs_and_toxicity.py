"""Word runs against brute force, and toxicity on held-out labels."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from basketforge.llm import registry, toxicity, word_runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, word long, toxic int, score double"


def table(spark, texts):
    """Documents with columns that have the operators' own names."""
    return spark.createDataFrame([(k, t, None, "s", None, "x", 1, None, 0.5) for k, t in texts], SCHEMA)


AWKWARD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "one two " * 20), (5, "w " * 30_000), (6, "a." * 50_000), (7, "ünï " * 40)]


def brute_runs(words, least=12):
    """Every run, period by period; the smallest period of equal stretches."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def made_sequences(count, seed):
    pick = random.Random(seed)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for _ in range(count):
        k, n, kind = pick.choice([1, 2, 2, 3, 5]), pick.choice([0, 5, 12, 20, 40, 80, 200]), pick.randrange(5)
        if kind == 0:
            yield [pick.randrange(k) for _ in range(n)]
        elif kind == 1:
            unit = [pick.randrange(k) for _ in range(pick.randrange(1, 40))]
            out = (unit * 300)[:n]
            for _ in range(pick.randrange(4)):
                if out:
                    out[pick.randrange(len(out))] = k
            yield out
        elif kind == 2:
            out = []
            while len(out) < n:
                out += [pick.randrange(k) for _ in range(pick.randrange(1, 12))] * pick.randrange(1, 6)
            yield (out + out)[:n]
        elif kind == 3:
            yield pick.choice(fibonacci)[:n]
        else:
            yield ([0, 1] * pick.randrange(30) + [0] + [0, 1] * pick.randrange(30)) * pick.randrange(1, 4)


def test_runs_match_brute_force():
    for words in made_sequences(1_500, 5):
        assert [tuple(r) for r in word_runs.runs_of(np.array(words, np.int64)).tolist()] == brute_runs(words), words


def test_range_successor():
    values = np.random.default_rng(1).permutation(200)
    tree = word_runs.WaveletTree(values, 199)
    pick = random.Random(2)
    for _ in range(300):
        low, high, bound = pick.randrange(200), pick.randrange(201), pick.randrange(600)
        low, high = min(low, high), max(low, high)
        want = min((x for x in values[low:high].tolist() if x >= bound), default=-1)
        assert tree.successor(np.array([low]), np.array([high]), np.array([bound])).tolist() == [want]


def plain_row(doc_id, text):
    """What the query returns for a document, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    first = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *first, None if first[0] is None else 1000 * first[1] // first[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_word_runs_query_matches_brute_force(spark, small):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    rows = registry.QUERIES["op12_word_runs"](spark, small).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows) and any(not r.n_runs for r in rows)
    for r in rows:
        # Brute force takes the square of a text's words.
        if len(texts[r.doc_id] or "") < 12_000:
            assert tuple(r)[1:] == plain_row(r.doc_id, texts[r.doc_id]), r.doc_id


def test_word_runs_awkward(spark):
    rows = word_runs.word_runs(table(spark, AWKWARD)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(AWKWARD) and sum(r.doc_id == 4 for r in rows) == 2
    assert all(got[k].n_words == 0 and got[k].runs == [] and got[k].collapsed == "" for k in (1, 2, 3))
    assert got[None].collapsed == "one two" and [tuple(r) for r in got[None].runs] == [(0, 40, 2)]
    assert [tuple(r) for r in got[5].runs] == [(0, 30_000, 1)] and got[5].collapsed == "w" and got[7].collapsed == "ünï"
    assert got[6].n_words == 1
    assert word_runs.word_runs(table(spark, AWKWARD).limit(0)).count() == 0


def test_words_do_not_meet_across_documents(spark):
    rows = word_runs.word_runs(table(spark, [(k, "a b c d") for k in range(50)])).collect()
    assert all(r.runs == [] and r.collapsed == "a b c d" for r in rows)


# toxicity


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    rows = registry.QUERIES["op13_toxicity"](spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in seen]) > 0.94
    assert sum(a and b for a, b in seen) > 0.7 * sum(b for _, b in seen) and sum(a and not b for a, b in seen) <= 2


def test_savings_tell_toxic_words():
    words = [f"plain{k}" for k in range(400)]
    ordinary, toxic = (b"".join(toxicity.word_codes(w) for w in part) for part in (words, words[:50] + ["vile", "nasty"]))
    savings = toxicity.Savings(ordinary, toxic)
    text = " ".join(words[k * 7 % 400] for k in range(64))
    assert np.abs(savings(text)).max() <= 1
    assert savings(text.replace(words[7], "Vile,").replace(words[14], "NASTY")).max() >= 6
    assert len(savings(None)) == len(savings("")) == len(savings("... --")) == 0
    # Windows are the text's own, however many are compressed at once.
    long = text + " vile " + text
    assert len(savings(long)) == -(-129 // toxicity.WINDOW)


def test_a_passage_counts_once_however_often_it_is_copied(spark):
    docs = spark.createDataFrame([(k, "same old vile passage here") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).toxic == b""


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None), (99, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, AWKWARD)
    for known in (labels, labels.limit(0), labels.where("toxic = 0")):
        rows = toxicity.score(docs, toxicity.train(docs, known)).collect()
        assert len(rows) == len(AWKWARD) and all(r.score == 0.5 for r in rows)
    both = labels.unionByName(spark.createDataFrame([(6, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, both)).collect()}
    assert all(0 <= x <= 1 for x in scores.values()) and scores[1] == scores[2] == scores[3]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), both)).count() == 0


def test_calibration_separates():
    x = np.array([[0.0, 0, 0]] * 30 + [[3.0, 1, 2]] * 10)
    w = toxicity.calibrated(x, np.array([0.0] * 30 + [1.0] * 10))
    assert toxicity.probability(x[0], w) < 0.2 < 0.8 < toxicity.probability(x[-1], w)
    assert toxicity.probability(np.zeros(3), w) == pytest.approx(toxicity.probability(toxicity.measures(np.empty(0)), w))
