"""The documents table made into training input: language, toxicity, near duplicates, mixing, tokens.

Every stage takes what the one before it has written, and drops only what it rejects. The mixing stage rejects nothing: it adds
``mix_slot`` and ``mix_place``, the order in which the documents are to be read, and the last stage passes them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm import jaccard, language, mixing, pieces, toxicity
from reviewlake.llm.catalog import tokenizer
from reviewlake.llm.shared import table
from reviewlake.sources.stage import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LEAST_COSINE = 0.05
"""A text below that resembles no language that is known here; unrelated profiles have cosines around 0 (deviation 0.03)."""


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the table names; texts without a letter, or like none of them, go.

    Empty input stays empty, nulls in other columns stay, repeated rows are judged alike.
    """
    found = language.identify(docs.select(*COLUMNS), language.fit(docs.filter(~language.held_out())), SCHEMA)
    return found.filter((F.col("lang_pred") != language.NO_LANGUAGE) & (F.col("score") >= LEAST_COSINE)).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine does not take for toxic; without labels of both classes all stay.

    A null text is not toxic; nulls in other columns and repeated rows stay, empty input stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs.filter(~toxicity.held_out()), labels.filter(~toxicity.held_out()))
    return toxicity.score_texts(docs.select(*COLUMNS), machine, SCHEMA).filter("predicted = 0").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the smallest doc_id, once, also if its row repeats.

    Documents without words are linked with nothing and stay. A row without a doc_id stays if it is linked with no row that
    has one.
    """
    found = jaccard.linked_documents(docs)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    once = Window.partitionBy("doc_id", "copy").orderBy("copy")
    return (docs.select(*COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("kept_id"))).withColumn("copy", F.xxhash64("text"))
            .withColumn("nth", F.row_number().over(once)).filter("nth = 1").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources: sort by (mix_slot, mix_place) to read it.

    A null source is one by itself; nulls and repeated rows stay, empty input stays empty.
    """
    placed = mixing.mix_sources(docs.select(*COLUMNS))
    return placed.select(*COLUMNS, F.col("slot").alias("mix_slot"), F.col("place").alias("mix_place"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, their number, and digests of the ids and of their decoding.

    The place in the mixture goes along; documents that have not been mixed have none. A null text is an empty one, repeated rows
    give equal rows, empty input stays empty.
    """
    for place in ("mix_slot", "mix_place"):
        if place not in docs.columns:
            docs = docs.withColumn(place, F.lit(None).cast("long"))
    return pieces.token_digests(docs, tokenizer("piece_bpe_32k.model"),
                                "doc_id long, source string, mix_slot long, mix_place long", with_ids=True)


STAGES = [("language_id", known_language), ("toxicity", not_toxic), ("jaccard_join", one_of_each_group),
          ("mixing", mixed), ("sentencepiece", tokens)]

# Trained models, vector arithmetic and tokenizers have no SQL; the tests hold the rows against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between them the rows are written as Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
