"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import language, mixing, neardup, packing, quality
from tablewright.llm.common import count_words, stored, tokenizer_file
from tablewright.plans.registry import table

#: Two documents are near duplicates from this similarity on, in percent.
NEAR_PERCENT = 80
END_ID = 1

#: The stages hold language models learned here and token ids, which SQL cannot express.
ORACLE_SQL = None


def whole_rows(docs: DataFrame) -> DataFrame:
    """``row`` with all columns of ``docs``, so that none of them meets a work column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; null and empty texts are too short and go."""
    judged = quality.judge(whole_rows(docs).withColumn("text", F.col("row.text")))
    return judged.where("verdict.kept").select("row.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without letters go.

    A text in two languages or between close ones stays with the better of them.  With a
    score of 0 no language is ahead, as for a text whose script none of them has, and it goes.
    """
    samples = language.learn(docs.select("doc_id", "text", "lang"))
    found = language.identify(whole_rows(docs).withColumn("text", F.col("row.text")), samples)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") > 0)).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order; a document taken twice stands twice.

    Of a document that a pass takes in part, the whole is kept if at least half is taken.
    """
    digest = F.md5(F.concat_ws("|", F.col("row.doc_id").cast("string"), F.col("row.text")).cast("binary"))
    rows = whole_rows(docs).select(
        "row", F.col("row.source").alias("source"), count_words(F.col("row.text")).alias("size"), digest.alias("order")
    )
    return mixing.training_order(mixing.place(rows)).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; copies of a document are packed each by itself."""
    return packing.pack(docs.select("doc_id", "text"), "doc_id", "text", tokenizer_file("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_languages),
    ("near duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage{number}")
    return docs
