"""From raw documents to packed sequences: each stage is one operator of tidemark.llm at work on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
further ones there are. An empty table passes through all of them.
``run`` writes each result to the shared folder and reads it again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, near_copies, packing, quality
from tidemark.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 7 doesn't reject; it learns from the labelled rows of docs.

    Null and empty texts are scored like any other; repeated rows get one score; a very long text is one row of features.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that operator 4 drops; n_chars, where it exists, counts what is left.

    A null text is an empty line and stays a row; rows that share an id lose their own lines only; none is dropped.
    """
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: 5-word shingles, similarity 0.8 or more.

    Candidates are the links of operator 2's SimHash fingerprints and BK-trees, then MinHash lists for what these leave apart;
    all are verified on whole sets of shingles.

    Texts without words are copies of each other; of repeated rows one stays; rows that share an id are judged by their texts,
    and the smallest id stays, one without an id only where no other has one.
    """
    return near_copies.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which operator 8 finds no item of benchmark.

    Null and empty texts hold none and stay; each row is judged by its own text, also without an id or with a shared one.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of operator 1; a null text is one with its end mark alone, repeated rows are packed each, a long text is cut."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("lines", drop_shared_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: The first stage is a trained model and the last a greedy search: tests compare run() with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
