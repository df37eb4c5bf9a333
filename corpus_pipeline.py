"""A training corpus from raw documents, stage by stage; every stage reads what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, jaccard, langid, packing, substrings
from sparkloom.llm.common import Written, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in a language go: null, empty and those without a letter. A null
    lang becomes the predicted one. Repeated rows are treated alike, an empty table stays empty."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays, and one row of
    those that share an id; rows with a null id and texts without words stay."""
    return jaccard.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut from the texts; all documents stay, null
    texts and rows with a null id as they are."""
    return substrings.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go; null texts and rows with a null id stay."""
    found = decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as sequences of at most 2048 ids; a null text is the end id alone, an empty table no row."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_substrings", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Suffix arrays, minimum hashes and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scratch():  # a stage's own tables go with it
            now = Written(stage(spark, docs, sf_dir))
        if last is not None:
            last.drop()
        docs, last = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
