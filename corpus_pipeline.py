"""A training corpus from the table of documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and
read again as the next one's docs, and deleted when that one's result is written. All but the last
return the columns of documents, whatever further ones there are and however they are named.

Defined results: null, empty and word-less texts fall to the quality rules (too few words); very long texts
are taken whole by every stage; rows with null ids, languages or sources go through like others; equal
rows and near copies leave one row, the one with the least doc_id (null last; of ties the one with the
least text digest); an empty table gives an empty result, an empty benchmark leaves all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixgate.llm import decontaminate, mixing, quality, simhash, sstable
from helixgate.llm.shared import discard, materialize, read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to bring the sources to their target weights."""
    return mixing.mix_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents' token ids as shards and returns what the files hold of each."""
    import public_tokenizers

    return sstable.tokenize_to_shards(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("token shards", token_shards),
]

#: SQL cannot express the distances, fingerprints and random rounding of these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(docs)
        docs = kept
    return docs
