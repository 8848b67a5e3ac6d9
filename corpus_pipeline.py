"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before it kept. Every stage
but the last returns the columns of documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import common, decontaminate, neardup, packing, quality, queries, substrings


def _plain(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but doc_id and text under plain names, which clash with none that a stage adds, and the way back."""
    names = [c if c in ("doc_id", "text") else f"kept_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it is fitted on the labelled rows among them.

    A score of the threshold itself is good. Null and empty texts are scored like others, as one empty passage; null keys
    are never learnt from; repeated rows get one score and stay or go alike; without labelled texts every score is 0.5 and
    all stay; an empty table gives no rows; columns of any name stay as they are.
    """
    plain, back = _plain(docs)
    model = quality.fit(plain, common.table(spark, sf_dir, "labels"))
    return quality.classify(plain, model, keep_text=True).where("predicted = 1").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least key.

    Null and empty texts, texts without words and rows without key are in no group and stay. Of rows that repeat with
    their key one stays, that of the least text. An empty table gives no rows; columns of any name stay as they are.
    """
    plain, back = _plain(docs)
    return neardup.first_of_each(plain).select(*back)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that stand in an earlier one; n_chars follows the text.

    Texts that lose nothing stay as they are, white space included; others are their words, one space between. Rows
    without key and null or empty texts lose nothing; rows of one key do not take words from each other. No row goes,
    even if no word is left. An empty table gives no rows; columns of any name stay as they are.
    """
    plain, back = _plain(docs)
    kept = substrings.removed(plain, keep_text=True)
    if "n_chars" in docs.columns:
        own = f"kept_{docs.columns.index('n_chars')}"
        kept = kept.withColumn(own, F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own)))
    return kept.select(*back)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark: 10 words in a row of an item, or all of a shorter one.

    Null and empty texts and rows without key stay; where a key repeats, one contaminated row takes all its rows along. An
    empty benchmark leaves all, an empty table gives no rows; columns of any name stay as they are.
    """
    plain, back = _plain(docs)
    return decontaminate.clean(plain, common.table(spark, sf_dir, "benchmark")).select(*back)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences.

    Null and empty texts are pieces of the end id alone; rows without key and repeated rows are packed like others; an
    empty table gives no rows; further columns are left out.
    """
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
