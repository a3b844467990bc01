"""From raw documents to packed training sequences: five stages, each a call of one operator on all that the stage
before it kept. Between stages the documents are written as Parquet and read again.

All stages but the last return the columns of documents and no others: a table may have more columns, of any names, and
they end here. Rows with a null doc_id pass like others. An empty table gives an empty table. Very long texts are values
of a row as any text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posemill.llm import jaccard, language, line_dedup, packing, pii
from posemill.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text this far from every learned language (1: equal to a profile) is in none of them.
LEAST_SCORE = 0.2
CAPACITY = 4096


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumns({"text": F.col(text), "n_chars": F.char_length(text).cast("long")}).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those far from all languages; the predicted language
    replaces a null one. Repeated rows are kept or dropped alike; of equally near languages the first by name counts.
    Without labelled rows to learn from, nothing is near a language and all is dropped."""
    known = docs.select("doc_id", "text", "lang").filter(~language.held_out(F.col("doc_id")))
    said = language.identify(docs.select(*COLUMNS), language.fit_profiles(known))
    kept = said.filter((F.col("lang_pred") != language.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from every document the lines that a smaller doc_id holds. A null text becomes an empty one. Rows that repeat a
    doc_id are one document and keep their lines; a null doc_id comes after all others."""
    return _with_text(line_dedup.dedup_lines(docs.select(*COLUMNS)), "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of near duplicates, with all its rows. Documents without words, and rows
    without a doc_id, are near nothing and stay."""
    linked = jaccard.link_components(docs)
    gone = written(linked.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-duplicates")
    small = gone.count() <= jaccard.BROADCAST_ROWS
    return docs.select(*COLUMNS).join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets where personal data or a secret stood. Null and empty texts stay as they are."""
    return _with_text(pii.find_spans(docs.select(*COLUMNS)), "redacted_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: the rows of op8, one for each piece. A null or empty text is its
    separator; repeated rows give repeated pieces."""
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY)
    return packing.pack(pieces, capacity=CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("pii", redact),
    ("packing", pack),
]

#: SQL can't express language profiles, tokenization or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
