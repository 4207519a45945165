"""A corpus from raw documents to packed training sequences, in five stages.

Every stage reads what its predecessor wrote and works on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import line_dedup, mixing, near_copies, packing, quality_classifier
from quillsift.llm.queries import BYTE_BPE, HELD_OUT
from quillsift.llm.shared import read, shared_folder


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    scored = quality_classifier.score(docs, read(spark, sf_dir, "labels"), f"NOT {HELD_OUT}")
    return scored.filter("score >= 0.5").select(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated passages (three lines, or over 50 words); ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs, passage=50)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8."""
    return near_copies.keep_one(docs, words=5, similarity=0.8).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    return packing.pack(docs, BYTE_BPE, capacity=2048)


STAGES = [
    ("quality classifier", judge_quality),
    ("line dedup", remove_lines),
    ("SimHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Tokens, fingerprints and the classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    A result is deleted once its successor is written, the last when the
    session ends.  An empty table goes through all stages and gives no row.
    """
    folder = shared_folder(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
