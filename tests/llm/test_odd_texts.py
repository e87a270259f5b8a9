"""Long texts of one repeated part, which patterns with repeated groups would match by recursion; in a new session."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]

ODD = """
from pyspark.sql import functions as F
from basketforge.session import local_session
import __spark_entry__
import corpus_pipeline
from basketforge.llm import line_dedup, quality, secret_scan, shingle_join, toxicity, url_trust, word_runs

spark = local_session(2, 4)
spark.sparkContext.setLogLevel("ERROR")
TEXTS = ["ab/" * 2_000 + "cd", "a." * 5_000 + "b", "ab/" * 330_000 + "cd", "a." * 500_000, "x" * 1_000_000, "1" * 200_000, "same line\\n" * 100_000, "a-_" * 300_000, "=/" * 300_000, "w " * 300_000]
docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()
labels = spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(10)], "doc_id long, quality int, toxic int")
bench = spark.createDataFrame([("i", "one two three four five six seven eight nine ten")], "item_id string, text string")
"""


def run(*lines):
    """Runs the lines after ODD in a Python of its own, whose JVM has compiled nothing yet."""
    done = subprocess.run([sys.executable, "-c", ODD + "\n".join(lines)], cwd=ROOT, env={**__import__("os").environ, "PYTHONPATH": f"{ROOT}"}, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


@pytest.mark.parametrize(
    "lines",
    [
        ("rows = secret_scan.scan(docs).collect()", "assert len(rows) == len(TEXTS)"),
        ("pages = docs.select(F.col('doc_id').alias('page_id'), F.concat(F.lit('http://h'), 'doc_id', F.lit('.org/')).alias('url'), F.concat(F.col('text'), F.lit(' h1.org')).alias('html'))", "assert url_trust.judge(pages).count() == len(TEXTS)", "assert {(r.src, r.dst) for r in url_trust.host_edges(pages.withColumn('host', F.split('url', '/')[2])).collect()} == {(f'h{k}.org', 'h1.org') for k in range(10) if k != 1}"),
        ("got = {r.doc_id: r.text for r in line_dedup.LineDedup().clean(docs).collect()}", "assert got.pop(6) == 'same line\\n' and all(got[k] == TEXTS[k] for k in got)"),
        ("model = toxicity.train(docs, labels)", "assert toxicity.score(docs, model).count() == len(TEXTS)", "assert word_runs.word_runs(docs).count() == len(TEXTS)", "assert quality.score(docs, quality.train(docs, labels)).count() == len(TEXTS)"),
        ("assert shingle_join.keep_one_of_each(docs, words=5, p=4, q=5).count() <= len(TEXTS)", "from basketforge.llm.decontaminate import decontaminate", "assert decontaminate(docs, bench).count() == len(TEXTS)", "assert decontaminate(docs, bench, spans_only=True).count() == len(TEXTS)"),
    ],
)
def test_operators_survive(lines):
    run(*lines)
