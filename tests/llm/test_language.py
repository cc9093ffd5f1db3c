"""Language classifier on held-out documents and odd rows."""

import zlib

import numpy as np

from acuity.llm import language as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.predict_languages(docs, L.fit(docs)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) < 0.01 * len(rows)


def test_learns_from_no_held_out_row(spark, docs):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert L.fit(docs(*[(i, "some words here", "en") for i in held])).languages == []


def test_odd_rows(docs):
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "the thing that was" if i % 2 else "der das und nicht", "en" if i % 2 else "de") for i in free]
    model = L.fit(docs(*rows, (free[0], None, "en"), (free[1], "the", None)))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in L.predict_languages(docs((1, None), (2, ""), (3, "12 .. 5"), (4, "das und der"), (None, "THAT thing")), model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, None)] == ["und", "und", "und", "de", "en"]
    assert [got[k]["rejected"] for k in (1, 2, 3)] == [True] * 3 and got[1]["score"] == 0
    kept = L.keep_accepted(docs((1, None), (4, "das und der nicht"), (4, "das und der nicht")), model)
    assert [r["doc_id"] for r in kept.collect()] == [4, 4] and kept.columns == docs((1, "")).columns


def test_no_labels(docs):
    model = L.fit(docs((1, "text", None)))
    assert [r["lang_pred"] for r in L.predict_languages(docs((1, "text")), model).collect()] == ["und"]
    assert L.predict_languages(docs(), model).collect() == []


def test_unsure_texts_are_rejected():
    import numpy as np
    scores = np.array([[4, 0], [3, 0], [0, 3], [0.1, 0], [0, 0.1], [0.1, 0]] * 20, float)
    target = np.array([0, 0, 1, 1, 0, 0] * 20)
    temperature, threshold = L._calibrate(scores, target)
    top = L._softmax(scores / temperature).max(axis=1)
    assert (top[:3] >= threshold).all() and (top[3:6] < threshold).all()


def test_bags_are_a_few_large_arrays():
    """The driver holds the subwords of its sample in three arrays, not two per text."""
    texts = ["Ein Haus", "", None, "a house and a mouse", "12 34"]
    buckets, shares, bounds = L._bags(texts)
    assert buckets.dtype == np.uint16 and shares.dtype == np.float32 and L.BUCKETS <= 1 << 16
    assert len(bounds) == len(texts) + 1 and bounds[-1] == len(buckets) == len(shares)
    for i, text in enumerate(texts):
        found = np.concatenate([b for b, _ in L.subwords([text or ""])] or [np.zeros(0, int)])
        ids, n = np.unique(found, return_counts=True)
        assert buckets[bounds[i]:bounds[i + 1]].tolist() == ids.tolist()
        assert np.allclose(shares[bounds[i]:bounds[i + 1]], n / max(n.sum(), 1))
