"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import decontam, jaccard, langid, linededup, packing
from tidewell.llm.common import read, scratch, ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the network knows; those without text or letters, or that it is unsure of, go.

    Where no row has a label there is nothing to learn from, and all stay.
    """
    ship(spark)
    net = langid.fit(langid.labelled_documents(docs))
    if net is None:
        return docs
    known = langid.predict(docs, net)
    return known.filter((known.lang_pred != "und") & (known.score >= langid.LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later of repeated runs of lines; those of which nothing is left go."""
    ship(spark)
    return linededup.dedup_lines(docs, gone=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    ship(spark)
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    ship(spark)
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the documents' ids lies in sequences of 1024."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", sequences),
]

#: The network, the links' closure and the packing aren't SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written to the shared folder and read again."""
    folder = scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
