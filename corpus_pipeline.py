"""From raw documents to packed training sequences: the stages, in order.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import exact_dedup, near_dedup, packing, quality
from tarn.llm.common import written
from tarn.llm.queries import BYTE_BPE

#: SQL has no equal of the classifier, the tokenizer and the packing; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose posterior of good quality is one half or more.

    Null or blank texts are judged by the site and by features of zero; rows that repeat are
    judged alike; an empty table stays empty. All columns stay, whatever their names.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, A-Z lower-cased, the row with the largest doc_id.

    Null counts as empty. Rows that repeat an id and a text all stay; rows without an id stay
    only where no row with one has their text. An empty table stays empty.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of five-word shingles and a similarity of 0.8 join, the one with the smallest doc_id.

    Texts without words, and groups without any id, stay. An empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs, shingle_words=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in sequences of at most 2048 ids.

    A null text is empty: its one id is the end's. Null ids stay null. No documents give no
    sequences.
    """
    pieces = packing.cut(docs, BYTE_BPE, capacity=2048, end_id=1)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_dedup_stage), ("minhash near-dedup", near_dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
