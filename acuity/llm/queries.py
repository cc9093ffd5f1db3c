"""Registered queries of the operators, and the SQL of those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from acuity.llm import (
    decontaminate, language, near_dedup, ngram_join, pages, personal, pieces, prefix_trie, quality, secrets, store, substring_dedup, warc,
    whitening,
)
from acuity.llm.oracle import ORACLE  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    """Every document without the sentences of repeated runs."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    """One row per document and benchmark item it holds."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark, sf_dir):
    """Pages written as records of an archive, and what is read back."""
    path = store.new_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op4_sentencepiece(spark, sf_dir):
    """Tokens of every document, and whether decoding gives the text back."""
    return pieces.encode(table(spark, sf_dir, "documents"), check=True)


def op5_personal_data(spark, sf_dir):
    return personal.find_personal_data(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_join(spark, sf_dir):
    """Class, links and copies of every document."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_links", "n_copies", "n_linked_texts")


def op8_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.predict_languages(docs, language.fit(docs))
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_secrets(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_main_text(spark, sf_dir):
    return pages.main_text(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark, sf_dir):
    """Nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_near_dedup(spark, sf_dir):
    """Component of near copies of every document, and whether it is the one that stays."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    """Whitened embeddings; a deviation that no long can hold is null."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_warc, op4_sentencepiece, op5_personal_data, op6_quality_rules, op7_ngram_join, op8_language,
                                 op9_secrets, op10_main_text, op11_prefix_trie, op12_near_dedup, op13_whitening)}
