"""A corpus pipeline of five stages. Each stage reads what its predecessor kept and gives the columns of documents; the last gives encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontamination, exact_dedup, language_id, ngram_join, piece_encoding
from siftwell.llm.common import table, written

#: A document whose best language has a smaller posterior than this is rejected, as is one without letters.
MIN_LANGUAGE_SCORE = 0.5
#: Near copies share at least so many hundredths of their distinct runs of so many words.
NEAR_SHINGLE, NEAR_NUMERATOR = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays unclear."""
    usable = ~language_id.held_out("doc_id", 3, 1)
    model = language_id.train(language_id.sample_rows(docs, usable, "doc_id", "text", "lang"))
    return language_id.identified_rows(docs, model, MIN_LANGUAGE_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id stays. Rows of one id stay or go together; those without an id stay."""
    found = ngram_join.similar_components(docs, shingle=NEAR_SHINGLE, numerator=NEAR_NUMERATOR)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a window of a benchmark item, each by its own text, whatever its id."""
    found = decontamination.contaminated_words(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("gone_"), F.col("t1").alias("hash_")).distinct()
    same = docs["doc_id"].eqNullSafe(found["gone_"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["hash_"])
    return docs.join(found, same, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, covered_bytes."""
    return piece_encoding.encoding_digests(docs.select(F.col("doc_id"), F.col("text")))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("piece_encoding", encode),
]

#: Trained prediction, set similarity and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
