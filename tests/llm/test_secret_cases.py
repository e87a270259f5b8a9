"""Keywords and values of assignments with letters that have an ASCII letter as their other case."""

import re

from basketforge.llm import secret_scan


def test_letters_in_either_case(spark):
    texts = ["to\u212aen=abcdefgh1 x", "pa\u017f\u017fword: abcdefgh", "secret=abcdefg\u212a9 x", "TO\u212aEN=abc", "\u00e9\U0001f600 \u017fecret='abcdefgh\u0131z'", "token=short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = re.compile(secret_scan.ASSIGN)
    want = {k: ",".join(f"assign:{m.start()}:{m.end()}" for m in rule.finditer(t) if len(m[2]) >= 8) for k, t in enumerate(texts)}
    assert {r.doc_id: r.base for r in secret_scan.scan(df).select("doc_id", secret_scan._text("base").alias("base")).collect()} == want
    assert sum(bool(x) for x in want.values()) == 4
