"""From raw documents to token ids: toxic documents go, then exact and near copies, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``tessera.llm``. A stage's result is written as Parquet to the
shared folder and read back as the next one's docs. All but the last return the columns of documents.

Defined results: a null or empty text has the toxicity 0, so it stays; of null and empty texts, which are equal, the row of the largest id goes on; a null source is a source; rows that
repeat an id and text are one document to both stages on copies; labels that are missing, null or all of one kind reject by the share of toxic ones; an empty table gives an empty result; further
columns of documents are carried through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tessera.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels beside the documents."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by shingles of five words and a similarity of 0.8, the document of the smallest id stays."""
    return simhash.deduplicate(docs, n=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture visits it: once at least, and about twice at most."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return bpe.encode(docs, keep=("ids",))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: A trained classifier can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
