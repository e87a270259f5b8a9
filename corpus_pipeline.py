"""The corpus pipeline: quality, line dedup, near-duplicate documents, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; the last returns the pieces of packed sequences.

Defined cases, in every stage: empty tables give empty tables; extra columns are
kept, whatever their names (packing leaves them out). Null and empty texts have the
score of the classifier's bias, no lines, no near copies, no benchmark words, and
are packed as an end token alone. A null doc_id has no near copies, and is carried
along. Repeated rows are judged alike by all stages but the Jaccard join, which
keeps one of them. Of equal scores and sizes the smaller doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from basketforge.llm import quality
from basketforge.llm.decontaminate import decontaminate
from basketforge.llm.line_dedup import LineDedup
from basketforge.llm.packing import pack_documents
from basketforge.llm.shingle_join import keep_one_of_each
from basketforge.session import dropped, staged
from basketforge.sources.tables import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier line."""
    return LineDedup().clean(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    return keep_one_of_each(docs, words=5, p=4, q=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, with their token ids, in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", clean_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: The classifier, the tokenizer and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder, until the next one is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # The next stage reads this one's table alone.
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
