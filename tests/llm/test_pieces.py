"""SentencePiece encoding against the library and the round trip."""

import random

import pytest
import sentencepiece

from acuity.llm import pieces as P


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def texts():
    rng = random.Random(6)
    alphabet = [*"abcdeé\n\t  ß中ﬁ😀!aaa.-0123 ЖжthinTHE", "the", "ing", " tion", "  ", "     "]
    return ["", " ", "x" * 3000, "the cat  sat\n\non the mat", "ab" * 700 + " end"] + [
        "".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(1500)]


def test_equals_the_library(library):
    encoder = P.Encoder(P.MODEL)
    assert [t.tolist() for t in encoder.encode(texts())] == library.encode(texts(), num_threads=1)


def test_a_small_cache_changes_nothing(library):
    encoder = P.Encoder(P.MODEL)
    for k in range(0, 200, 20):
        part = texts()[k:k + 20]
        assert [t.tolist() for t in encoder.encode(part, cache=5, batch_chars=40)] == library.encode(part, num_threads=1)


def test_round_trip(docs):
    rows = P.encode(docs(*enumerate(texts()[:400]), (-1, None), (0, "")), check=True)
    assert all(r["round_trip"] for r in rows.collect() if r["tokens"] is not None)
    back = {r["doc_id"]: r["text"] for r in P.decode_tokens(rows.filter("doc_id > 0")).collect()}
    assert back == {i: t for i, t in enumerate(texts()[:400]) if i}
    assert [r["n_tokens"] for r in rows.filter("doc_id = -1").collect()] == [None]


def test_one_very_long_text(library):
    """A megabyte of short cuts, and a cut of 20,000 characters."""
    text = " ".join(f"word{i % 5000}" for i in range(110_000))
    long_cut = "ab1" * 7_000
    encoder = P.Encoder(P.MODEL)
    assert [t.tolist() for t in encoder.encode([text, long_cut])] == library.encode([text, long_cut], num_threads=1)


def test_empty_table(docs):
    assert P.encode(docs()).collect() == []
