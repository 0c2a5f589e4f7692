"""A corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of
``documents``, and returns a DataFrame; all but the last keep those columns. A
stage's result is written as Parquet and read again as the next one's docs.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and further columns, whatever their names; what they mean to a
stage is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm import mixing, ngram_join, packing, quality, secrets
from variantloom.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality model scores below its threshold.

    A null or blank text is a bag of one passage without words and scored like any other; rows with one id, or none, are
    scored one by one; without labels everything stays. Whole texts are scored, however long.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="__score").where(F.col("__score") >= quality.KEEP).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five-word shingles, Jaccard of 0.8 or more): that of the least id.

    Documents without words, and rows without an id, are in no group and stay; rows with one id are one document, of which
    the least row stays.
    """
    return ngram_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by [SECRET]; null texts stay null, and n_chars follows the new text."""
    return secrets.remove_secrets(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents as the mix of their sources says.

    A null source is a source of its own; documents without words have nothing to take and are left out; rows with one id
    are taken equally often, rows without an id one by one.
    """
    return mixing.take(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into bins; one row a piece of a document, and no piece is dropped.

    Equal words are one cluster, of which a bin holds one; a null source is a source of its own.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]
#: The classifier and the randomness tests have no SQL; tests compare run()'s rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
