"""From raw documents to packed training sequences: STAGES, in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, langid, packing, simhash
from quadrille.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from the labels of these documents.

    Null and empty texts, and texts without a letter, go; null ids and labels stay but teach nothing; very long texts are
    read whole; of equally likely languages the first by name is told; repeated rows stay or go together; an empty table
    stays empty; further columns pass through under any name.
    """
    return langid.keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Null and empty texts are one group; null is the largest id; of one id's texts the one of the least hash stays, and of
    repeated rows one; very long texts are hashed whole; an empty table stays empty; further columns pass through under any
    name.
    """
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of a twentieth of their words or more.

    Null and empty texts stay, as they have no words; null ids are ids; very long texts are compared whole; repeated rows
    stay or go together, and exactly a twentieth goes; an empty table stays empty, and an empty benchmark drops nothing;
    further columns pass through under any name.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    Null and empty texts have one row without a bin; null ids are packed; very long texts are cut into pieces of the longest
    sequence; ties go by id; repeated rows are packed each; an empty table gives no rows; further columns aren't read.
    """
    return packing.pack(docs, packing.word_tokens(F.col("text")))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("best_fit_packing", best_fit_packing)]

#: The first, second and last stage are not expressible in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
