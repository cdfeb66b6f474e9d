"""From raw documents to packed training sequences: language ID, near-copy removal, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet in the shared folder
and read back as the next one's docs. All but the last return the columns of documents. A row without a doc_id or text
is rejected by the first stage, an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import decontaminate, jaccard, language, packing, secrets
from recallgrid.llm.common import cut, discard, table

#: Posterior probability under which the language of a text counts as unknown.
LEAST_SCORE = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't say any of these stages; the tests hold them against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language that the model knows and is surer of than not."""
    docs = _columns(docs).where("doc_id is not null and text is not null")
    model = language.fit(docs.where(~language.held_out()))
    kept = language.predict(docs, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: shingles of five words, similarity of 0.8 or more."""
    return jaccard.drop_near_copies(_columns(docs), 80, 100, 5).select(*COLUMNS)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs = _columns(docs)
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id").distinct()
    return docs.join(cut(found, "leaks"), "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in each secret's place and n_chars of the new text."""
    docs = _columns(docs)
    out = secrets.redact(docs, secrets.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences."""
    return packing.pack(_columns(docs))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", remove_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if hasattr(before, "cut_path"):
            discard(before)
    return docs
