"""Registered queries on the test tables: against SQL where it can express them, otherwise against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from acuity.llm import language, ngram_join, personal, pieces, quality
from acuity.llm.oracle import ORACLE
from acuity.llm.queries import QUERIES, table
from tests.llm import test_decontaminate as plain_decontaminate, test_personal as plain_personal, test_quality as plain_quality, test_secrets as plain_secrets
from tests.oracle_check import compare, connect

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(spark, sf=SMALL):
    return {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_contract():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(entry.queries()) >= {*QUERIES, "pipeline"} and set(entry.oracle_sql()) >= set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_equals_sql(spark, name, sf):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None


def test_sentencepiece(spark):
    known = texts(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = QUERIES["op4_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == len(known)
    assert all(r["tokens"] == library.encode(known[r["doc_id"]], num_threads=1) and r["round_trip"] for r in rows)


def test_personal_data(spark):
    known = texts(spark, MEDIUM)
    rows = QUERIES["op5_personal_data"](spark, MEDIUM).collect()
    assert len(rows) == len(known) and sum(r["n_email"] for r in rows)
    for r in rows:
        spans = plain_personal.brute(known[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(personal.written(spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(x == j for _, x, _ in spans) for j in range(4)]


def test_quality_rules(spark):
    known = texts(spark, MEDIUM)
    rows = QUERIES["op6_quality_rules"](spark, MEDIUM).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert all(tuple(r[n] for n in names) == plain_quality.brute(known[r["doc_id"]]) for r in rows) and len(rows) == len(known)
    good = {r["doc_id"]: r["quality"] for r in table(spark, MEDIUM, "labels").collect()}
    passed = [r for r in rows if not r["base_failed"] and r["doc_id"] in good]
    lost = [r for r in passed if good[r["doc_id"]] and not r["kept"]]
    caught = [r for r in passed if not good[r["doc_id"]] and not r["kept"]]
    assert len(lost) <= 0.02 * len(passed) and caught


def test_language(spark):
    lang = {r["doc_id"]: r["lang"] for r in table(spark, MEDIUM, "documents").collect()}
    rows = QUERIES["op8_language"](spark, MEDIUM).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_secrets(spark):
    known = texts(spark, MEDIUM)
    rows = QUERIES["op9_secrets"](spark, MEDIUM).collect()
    for r in rows:
        spans = plain_secrets.brute(known[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(plain_secrets.written(spans).encode()).hexdigest()
    assert len(rows) == len(known) and sum(r["n_hex"] for r in rows)


def test_pipeline(spark):
    """Stage by stage in plain Python over the same documents."""
    docs = table(spark, SMALL, "documents")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    rejected = language.predict(language.fit(docs), [r["text"] for r in rows])[2]
    rows = [r for r, bad in zip(rows, rejected) if not bad]
    sets, label = ngram_join.shingle_sets([r["text"] for r in rows]), list(range(len(rows)))
    for _ in rows:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if label[a] != label[b]:
                    common = len(np.intersect1d(sets[a], sets[b], True))
                    if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
        if not changed:
            break
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    rows = [r for r, found in zip(rows, plain_decontaminate.brute([r["text"] for r in rows], items)) if not found]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    wanted = {r["doc_id"]: library.encode(personal.masked(r["text"]), num_threads=1) for r in rows}
    got = {r["doc_id"]: r["tokens"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == wanted and 0 < len(wanted) < docs.count()


def test_stages_keep_columns_and_odd_rows(spark, docs):
    text = " ".join(f"word{i}" for i in range(80))
    given = docs((1, text), (1, text), (None, text), (2, None), (3, ""), (4, "mail a@b.co and more words of the text"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SMALL)
        assert out.columns == given.columns and out.count() <= given.count(), name
        assert stage(spark, given.limit(0), SMALL).collect() == []


def test_fixture_of_quality_is_plain(docs):
    assert {r["kept"] for r in quality.features(quality.counts(docs((1, "a b")))).selectExpr(f"{quality.decision([])} as kept").collect()} == {True}
