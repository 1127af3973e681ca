"""The corpus pipeline: toxicity, exact copies, near copies, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.

Defined cases, at every stage: columns beyond doc_id, text and source travel as they are,
whatever their names; an empty table gives an empty one; no stage takes less than the whole text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import cut
from siltstone.llm.exact_dedup import drop_exact_copies
from siltstone.llm.mixing import mixed_documents
from siltstone.llm.near import drop_near_copies
from siltstone.llm.packing import pack
from siltstone.llm.toxicity import drop_toxic
from siltstone.session import ship
from siltstone.storage import free

#: Tokens of a packed sequence.
SEQUENCE = 4096


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the classifier learns from the labels of sf_dir.

    Null and empty texts are scored as empty ones. A row with a null id is scored like any other but never
    learned from. Repeated rows are judged alike.
    """
    ship(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z and a-z, the row with the largest id stays.

    Null counts as empty. Among rows with that id one stays.
    """
    ship(spark)
    return drop_exact_copies(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the smallest id stays.

    Texts without words and rows with a null id stay. Rows that repeat an id with different texts share its component.
    """
    ship(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix of sources takes a document, none to three, in the order of its slots.

    Null sources are a source of their own, the last. Texts without words have no size, so the mix takes none of
    them. Rows of one id are mixed as documents of their own.
    """
    ship(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids.

    An empty text gives its end id alone. Uses of one document are packed as documents of their own.
    """
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Toxicity is a trained model and packing runs a public tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            made = cut(made)
            free(docs)  # the stage's result no longer reads what it was made from
        docs = made
    return docs
