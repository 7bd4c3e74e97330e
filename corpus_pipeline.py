"""Raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote, works on all of it and returns the columns of ``documents``; the last
returns the packed pieces. An empty table gives no pieces, and further columns stay up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.llm import jaccard, line_dedup, mixing, quality, slack
from rackpulse.llm.tables import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text is rejected; rows without an id and repeated rows are judged by themselves."""
    return quality.kept(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, or nearly; ``n_chars`` follows the text.

    Rows equal in id and text are one; rows without an id come after all others; a document that loses every line with a word goes.
    """
    left = line_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id; rows without an id come last, repeated rows are copies."""
    return jaccard.unique(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics; a missing source or language counts as "other"."""
    return mixing.sample(docs, mixing.production_targets())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequence and place; a null or empty text is the closing id alone."""
    return slack.packed(docs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("ngram_jaccard_join", near_copies), ("source_mixing", source_mix),
    ("best_fit_packing", packing),
]

#: Raking and packing have no SQL form; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
