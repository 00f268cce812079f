"""From raw documents to packed sequences: toxicity, quality, near copies, personal data, packing."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopaudit.llm import near_copies, packing, pseudonyms, quality, toxicity
from shopaudit.llm.common import held_out, new_path, small_batches, stored

TOXIC_FROM = 0.7
GOOD_FROM = 0.3


def _verdicts(spark: SparkSession, folder: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("page_id"), F.col(label).alias("label"))


def _pages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("page_id"), "text")


def remove_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored below TOXIC_FROM. The classifier is fitted as the query op9 does."""
    key = F.col("page_id")
    _, model = toxicity.toxicity_of_pages(_pages(docs), _verdicts(spark, folder, "toxic"), held_out(key, 3, 1),
                                          held_out(key, 3, 0), stored)
    return docs.filter(toxicity.text_score("text", model) < TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored GOOD_FROM or more by the discriminant, fitted on the labelled ones among ``docs``."""
    labels = _verdicts(spark, folder, "quality").filter(~held_out(F.col("page_id"), 5, 0))
    statistics = stored(quality.measured(_pages(docs)), "statistics")
    model = quality.fit(statistics.join(labels, "page_id").select("statistics", "label"))
    small_batches(spark)
    return docs.filter(quality.text_score("text", model) >= GOOD_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8): the one with the smallest doc_id.

    A row goes only for its own text, also where its doc_id is on other rows. Rows with equal doc_id and text are one
    document, of which one row stays, the first by its other columns. Rows without doc_id, and rows without words, stay.
    """
    columns = docs.columns
    surplus = near_copies.surplus_copies(_pages(docs)).select(F.col("page_id").alias("_id"), F.col("text_key").alias("_key"))
    packed = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").alias("_id"), near_copies.text_key().alias("_key"))
    others = F.to_json(F.struct(F.lit(0), *[F.col("_row").getField(c).alias(f"c{i}") for i, c in enumerate(columns) if c not in ("doc_id", "text")]))
    numbered = packed.filter("_id is not null").groupBy("_id", "_key").agg(F.min_by("_row", others).alias("_row"))
    kept = numbered.join(surplus, ["_id", "_key"], "left_anti").select("_row.*")
    return kept.unionByName(docs.filter("doc_id is null"))


def hide_people(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced by pseudonyms of the same form; n_chars follows the text.

    The key comes from the session setting ``pseudonyms.KEY_SETTING``; only where that is unset, as in tests, a fixed one serves.
    """
    # The other columns travel in one struct, so that none of their names meets one of the operator's.
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("kept"), "text")
    key = spark.conf.get(pseudonyms.KEY_SETTING, "a key for tests")
    rows = pseudonyms.pseudonymised(packed, key).select("kept.*", "text")
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))
                           .otherwise(F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    pieces = packing.pack_pages(_pages(docs), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.withColumnsRenamed({"page_id": "doc_id", "page_tokens": "doc_tokens"})


STAGES = [("toxicity", remove_toxic), ("quality", keep_good), ("near copies", drop_copies), ("personal data", hide_people),
          ("packing", pack)]

#: Classifiers and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, folder)
