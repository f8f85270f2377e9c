"""The corpus pipeline: from raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from amalgam.llm import cminhash, flow_mix, packing, suffix_tree, toxicity
from amalgam.session import checkpoint_dir, delete, spread


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labelled ones, doesn't find toxic.

    Rows without words, and rows without a doc_id whose text is clean, stay; without labels of both kinds all rows do. Repeated rows are judged one by one.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of the least doc_id.

    Rows without words are groups of their own; rows without a doc_id stay; of repeated rows of a doc_id the one with the least text form stays.
    """
    return cminhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier place has already; those of which nothing is left go.

    Rows without a text or a doc_id stay as they are; short texts have no passages.
    """
    return suffix_tree.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the flow to the source quotas takes, as often as it takes them.

    Texts without a word hold no tokens, so they go; rows without a doc_id are told apart by their text, rows without a source are one more source.
    """
    return flow_mix.take_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of documents in sequences; the rows of a document that is there several times are its epochs, which go to different groups."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("mix", mix_sources), ("pack", pack)]

#: A trained network and a flow are among the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one returns is written to the shared checkpoint folder and read again.

    What a stage wrote is deleted as soon as the next one has written its own; the last one's files stay, as the result is read from them.
    """
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), None
    for number, (name, stage) in enumerate(STAGES):
        folder = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete(spark, before)
        before = folder
    return docs
