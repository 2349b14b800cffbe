"""From raw documents to token ids: quality, near-duplicates, repeated passages, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumensift.llm import bpe, common, mixing, neardup, quality, substring


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network doesn't reject.

    Null and empty texts are judged as the text without bytes, long ones are read whole. Equal texts are judged alike, so repeated
    rows stay or go together. Null labels teach nothing; without labels the network is unfitted. An empty table gives an empty one.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id. Equal rows of that id leave one.

    Texts that are null or have no word are in no group and stay. A group whose ids are all null stays; a null id beside others
    goes. An empty table gives an empty one. Columns of any name stay.
    """
    return neardup.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; earlier is the smaller doc_id.

    Rows whose doc_id or text is null stay as they are. Equal rows are one document, and no repeat of each other. Long texts are read
    whole. A document that is cut to nothing stays, with an empty text. An empty table gives an empty one.
    """
    return substring.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source of its own. Null and empty texts have no words and follow their source's rate. Of equal rows it makes no
    difference which is repeated. An empty table gives an empty one.
    """
    return mixing.sampled(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document, a row for each row; a null or empty text has no ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).drop("text", "n_chars")


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("substring", substring_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The network and the merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, name)
    return docs
