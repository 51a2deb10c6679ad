"""A corpus pipeline of five stages: each works on all documents that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, kn_quality, lang_id, near_dup, pieces
from tidemark.llm.common import read_table, shared_folder

#: SQL can't express the first stages; tests hold each stage, and run, against plain versions or the library.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity is out of bounds, null and empty texts among them.

    A null language takes the bounds of all; repeated rows and a null doc_id are judged like others.
    """
    return kn_quality.only_good(docs, read_table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown (null texts and those without letters) or uncertain; repeated rows stay."""
    return lang_id.only_known(docs, lang_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8 or more.

    It is that of the smallest doc_id, a null one last; ties go by the hash of the text.  Rows that repeat doc_id
    and text become one, texts without words stay.
    """
    return near_dup.one_of_each(docs, percent=80, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs; texts without words and repeated rows stay."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: doc_id, ids and no other column; a null or empty text has no ids, repeated rows stay."""
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again.

    An empty table passes through; very long texts are read whole; further columns are carried to the last stage.
    """
    folder, docs = shared_folder(spark), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
