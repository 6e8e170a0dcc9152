"""From documents to packed training sequences: five stages, each a function of (spark, docs, sf_dir).

All stages read whole texts, however long, and take any columns beside doc_id and
text, whatever their names; those pass unchanged up to packing. An empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import _shared as S
from quillmark.llm import decontaminate, language, lines, minhash, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some known language; those without letters (null and empty texts too) or without any known n-gram go.

    Profiles are learned from the rows themselves, by their non-null lang. Rows
    with a null doc_id and repeated rows are judged like any other.
    """
    S.small_batches(spark)
    return language.keep_determined(docs, language.fit(language.training_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line equals or nearly equals; documents of which none is left go.

    Null texts and rows with a null doc_id pass unchanged; ties go by the smallest
    doc_id, then by the line's hash; rows that share a doc_id lose the same lines.
    """
    S.small_batches(spark)
    return lines.without_repeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of smallest doc_id.

    Of rows that share a doc_id one stays; rows with a null doc_id all stay; null
    text counts as empty, and texts without words are alike only if equal.
    """
    S.small_batches(spark)
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; null and empty texts, and all rows under an empty benchmark, stay."""
    return decontaminate.drop_leaking(docs, S.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; null text is the closing id alone, repeated rows are packed each for itself."""
    S.small_batches(spark)
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread before the next."""
    docs = S.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = S.materialize(stage(spark, docs, sf_dir), name)
    return docs


#: No SQL says column generation, components or n-gram profiles; tests hold the stages to brute force.
ORACLE_SQL = None
