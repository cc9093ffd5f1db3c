"""Corpus pipeline: language, near copies, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and is a DataFrame over all rows its
predecessor kept. Between stages the rows are written to the shared folder and
read again, so that a lost executor costs no earlier stage.
"""

from pyspark.sql import DataFrame, SparkSession

from acuity.llm import decontaminate, language, ngram_join, personal, pieces, store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts. It learns from ``docs`` themselves."""
    return language.keep_accepted(docs, language.fit(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return personal.mask_personal_data(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document: doc_id, tokens, n_tokens, round_trip."""
    return pieces.encode(docs, check=True, cache=200_000, batch_chars=100_000)  # memory is scarcer here than time


STAGES = [
    ("language", identify_language),
    ("near_copies", join_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", mask_personal_data),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.write(stage(spark, docs, sf_dir))
    return docs
