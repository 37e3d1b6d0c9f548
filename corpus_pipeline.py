"""The corpus pipeline: five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Whoever runs the pipeline at scale
writes each stage's result as Parquet and gives the next stage what it reads
back; `run` does so in the folder that the executors share.

Defined results: null and empty texts have no words and are rejected by the
quality rules; of repeated rows near_duplicates keeps one; a null doc_id is a
value like any other and comes last; an empty table gives an empty result at
every stage; other columns are carried, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterbook.llm import cascade, mixing, ngram_join, packing, pii
from meterbook.llm.workspace import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return cascade.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of at least 0.8."""
    return ngram_join.one_of_each(docs, ngram_join.Similarity(5, 80, 100))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return _counted(pii.redacted(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row for each pass over a document, with the words taken."""
    return _counted(mixing.mixed_documents(docs, mixing.mix_sources(docs, mixing.repeating_weights(docs))))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(packing.document_pieces(docs, TOKENIZER))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("packing", packed)]

#: SQL can't express the mix's draws or the search of the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
