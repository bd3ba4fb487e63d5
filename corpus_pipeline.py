"""A training corpus from raw documents: five operators in a row, each stage written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, language_id, packing, secrets, shingle_sets
from spindrift.llm.session import boxed, read, shared_folder, unboxed


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised.

    Texts without letters, null and empty ones among them, go, and so do those
    less like their likeliest language than any text that was set aside when the
    model was fitted.  Repeated rows stay, as do rows without doc_id or lang; of
    no use to learn from, they are judged all the same.  Without any language to
    learn every document goes.
    """
    model = language_id.train_on(docs)
    found = language_id.predict(boxed(docs), model)
    return unboxed(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= model.sure)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies.

    Links are SimHash fingerprints of 5-word shingles within 2 bits, and sets of
    such shingles with a similarity of 0.8 or more.  Null, empty and blank texts
    are copies of one another; a text of fewer words is one shingle; repeats of
    a kept row go; rows without doc_id stay.
    """
    return shingle_sets.deduplicate(docs)


def remove_contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes windows of benchmark items out of the texts; documents of which they cover more than half go.

    Other texts, null and empty ones among them, stay as they are, as do repeated
    rows.  n_chars, if there is one, follows the text.  No items: nothing goes.
    """
    return decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays; secrets in its text give way to a mark, and n_chars, if there is one, follows.  Null and empty texts have none."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with their ids; a null or empty text has the closing id alone."""
    return packing.pack(docs, packing.vocabulary(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", remove_contamination),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: No SQL expresses the fitted language model; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each on all rows that the one before kept; an empty table gives no rows.

    All stages but the last return the columns of `documents`, whatever their
    names; very long texts count whole in each.
    """
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
    return docs
