"""SimHash windows against every window of every document."""

import random
from collections import Counter

import numpy as np
import pytest

from acuity.llm import decontaminate as D


def shingles(text):
    words = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
    return [tuple(words[i:i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))]


def brute(texts, items):
    """Best similarity of every item in every text, from words."""
    out = []
    for text in texts:
        s, best = shingles(text), {}
        for key, held in ((k, shingles(t)) for k, t in items):
            if set(s).isdisjoint(held):
                continue  # similarity 0 with every window
            for p in range(len(s)):
                window = s[p:p + len(held)]
                common = (Counter(window) & Counter(held)).total()
                value = common / (len(window) + len(held) - common)
                if value >= D.THRESHOLD:
                    best[key] = max(value, best.get(key, 0))
        out.append(best)
    return out


def cases():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(25)]
    texts = [None, "", "w1 w2"]
    for k in range(120):
        leak = items[k % 25][1].split()
        for _ in range(rng.randint(0, 3)):
            leak[rng.choice([0, -1, rng.randrange(len(leak))])] = "changed"
        leak = leak[rng.randint(0, 2):len(leak) - rng.randint(0, 2)]
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + " " + " ".join(leak).upper() + ", "
                     + " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))))
    return items, texts


@pytest.mark.parametrize("bits", [D.FILTER_BITS, 64])  # the second is full: every place counts as marked
def test_equals_every_window(spark, docs, monkeypatch, bits):
    items, texts = cases()
    wanted = brute(texts, items)
    assert 20 < sum(map(bool, wanted)) < len(texts)
    table = spark.createDataFrame([*items, (None, None), (99, "")], "item_id long, text string")
    monkeypatch.setattr(D, "FILTER_BITS", bits)
    got = [{} for _ in texts]
    for r in D.find_leaks(docs(*enumerate(texts)), table).collect():
        got[r["doc_id"]][r["item_id"]] = r["similarity"]
    assert got == wanted
    kept = sorted(r["doc_id"] for r in D.drop_leaks(docs(*enumerate(texts)), table).collect())
    assert kept == [i for i, w in enumerate(wanted) if not w]


def test_index_finds_all_fingerprints_within_the_radius(spark):
    rng = np.random.default_rng(1)
    own = rng.integers(-1 << 63, (1 << 63) - 1, 12).tolist()
    items = spark.createDataFrame([(i, 7 + i % 2, p) for i, p in enumerate(own)], "item long, size int, print long")
    prints = []
    for flips in range(0, 30):
        for i, p in enumerate(own):
            bits = sum(1 << int(b) for b in rng.choice(64, flips, replace=False))
            prints.append((7 + i % 2, int(np.uint64(p & (1 << 64) - 1) ^ np.uint64(bits))))
    rows = [(k, size, k, k + size, p - (1 << 64) if p >> 63 else p) for k, (size, p) in enumerate(prints)]
    windows = spark.createDataFrame(rows, "at long, size int, begin int, stop int, print long")
    got = {(r["at"], r["item"]) for r in D.near_items(windows, items).collect()}
    assert got == {(k, i) for k, (size, p) in enumerate(prints) for i, q in enumerate(own)
                   if size == 7 + i % 2 and (p ^ q & (1 << 64) - 1).bit_count() <= D.RADIUS}


def test_no_item_passes_through_the_driver(spark, docs):
    """What tasks know of the items has the same size for few and for many of them."""
    few, many = (spark.range(n).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(0, 19), i -> concat('w', id * 31 + i))) as text")
                 for n in (3, 400))
    first, second = (D.item_filter(D.item_table(x), 1 << 16) for x in (few, many))
    assert first.words.nbytes == second.words.nbytes and first.sizes.tolist() == second.sizes.tolist() == [16]
    text = " ".join(f"w{250 * 31 + i}" for i in range(20))
    assert [(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs((1, "so " + text), (2, "so")), many).collect()] == [(1, 250)]


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e f g", 2, 3, "x"), (2, "a b c d e f h", 2, 3, None), (3, None, 0, 0, "y")],
                                 "doc_id long, text string, at long, item long, row string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    kept = D.drop_leaks(rows, some)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_one_very_long_text(spark, docs):
    """A text of a megabyte with an item far from its start, and one without."""
    item = " ".join(f"item{i}" for i in range(40))
    filler = " ".join(f"w{i * 7919 % 9973}" for i in range(80_000))
    some = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = D.find_leaks(docs((1, f"{filler} {item} {filler}"), (2, filler)), some).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["first_word"], r["end_word"]) for r in rows] == [
        (1, 5, 1.0, 80_000, 80_040)]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs((1, "a b")), none).collect() == []
    assert D.drop_leaks(docs((1, "a b")), none).count() == 1
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.find_leaks(docs(), some).collect() == [] and D.drop_leaks(docs(), some).collect() == []


def test_repeated_rows_and_null_ids(spark, docs):
    some = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")
    rows = D.find_leaks(docs((None, "x a b c d e f y"), (4, "A b c, d e f"), (4, "A b c, d e f")), some).collect()
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in rows) == [(0, 1)] * 2 + [(4, 1)] * 4
