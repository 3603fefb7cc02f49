"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

Defined results: a null text is an empty one; it has the score of the classifier's bias, is near
no other, has no words to mix, and so is in no sequence. Rows that share a doc_id are documents of
their own. Rows without a doc_id pass the near duplicates as they are. Without labelled rows of
both classes no document is rejected. Ties of near duplicates go to the least doc_id, then to the
least hash of the text. Other columns stay as they are, up to the mixture. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bottomk_dedup, curriculum_mix, gga_packing, shared, subword_quality, token_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return subword_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return bottomk_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by training position."""
    return curriculum_mix.training_order(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return gga_packing.pack_documents(docs, token_ids.vocabulary_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]

#: Tokens, trained weights and packings are beyond SQL; tests/llm/test_pipeline.py compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table. A stage's table is removed when the next one is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        before = path
        docs, path = shared.at_path(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            shared.remove(spark, before)
    return docs
