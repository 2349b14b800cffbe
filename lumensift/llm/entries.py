"""The queries of this folder, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumensift.storage import texts

from . import align, ann, bpe, decontam, langid, lexical, lm, mixing, neardup, quality, substring, topk, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return texts(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of rows that aren't held out."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from rows that aren't held out."""
    return langid.digest(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, hashed, and the hash of what they decode to."""
    import public_tokenizers

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under a model of rows that aren't held out."""
    return lm.score(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours found of every 50th vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier one has too."""
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near copies of every document, at a similarity of 0.85."""
    return neardup.groups(table(spark, sf_dir, "documents"), percent=85)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best of every 50th vector by integer inner product, exactly."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty best documents for each benchmark item."""
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by two tokenizers, tied to each other over the same bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return align.align(table(spark, sf_dir, "documents"), a.read(), b.read(), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_langid": op2_langid,
    "op3_bpe": op3_bpe,
    "op4_lm": op4_lm,
    "op5_ann": op5_ann,
    "op6_mixing": op6_mixing,
    "op7_substring": op7_substring,
    "op8_neardup": op8_neardup,
    "op9_urls": op9_urls,
    "op10_topk": op10_topk,
    "op11_lexical": op11_lexical,
    "op12_decontam": op12_decontam,
    "op13_align": op13_align,
}

SQL: dict[str, str] = {
    "op6_mixing": mixing.SQL,
    "op8_neardup": neardup.SQL,
    "op10_topk": topk.SQL,
    "op11_lexical": lexical.SQL,
    "op12_decontam": decontam.SQL,
}
