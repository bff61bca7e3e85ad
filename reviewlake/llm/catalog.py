"""The registered queries of this package and, where SQL can express them, their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.shared import table
from reviewlake.llm.sql import SQL  # noqa: F401


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.sharding import shard_documents

    return shard_documents(table(spark, folder, "documents"))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.mixing import measured, mix_sources

    size, spread = measured()
    narrow = table(spark, folder, "documents").select("doc_id", "source", size.alias("size"), spread.alias("spread"))
    mixed = mix_sources(narrow)
    return mixed.select("doc_id", "source", "size", F.round("weight", 12).alias("weight"), "block", "release", "deadline",
                        "slot", "place", "in_mix")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.toxicity import toxicity_of_documents

    return toxicity_of_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.jaccard import linked_documents

    return linked_documents(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.language import language_of_documents

    return language_of_documents(table(spark, folder, "documents"))


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.urls import judge_pages

    return judge_pages(table(spark, folder, "pages"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.pieces import token_digests

    return token_digests(table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.topk import nearest_vectors

    return nearest_vectors(table(spark, folder, "embeddings"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.fingerprints import fingerprints_and_edits

    return fingerprints_and_edits(table(spark, folder, "documents"))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.lexical import rank_documents

    return rank_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.variants import spelling_variants

    return spelling_variants(table(spark, folder, "documents"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    from reviewlake.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


QUERIES = {name: fn for name, fn in list(globals().items()) if name.startswith("op")}
