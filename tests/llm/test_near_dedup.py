"""Near-dedup against all pairs of word sequences; the join's guarantee; groups above a block."""

import random
import re

import numpy as np
import pytest

from acuity.llm import near_dedup as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """(n_shingles, component) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((str(i), len(sets[k]), least.get(find(k)), i == least.get(find(k))) for k, (i, _) in enumerate(rows))


def found(docs, rows, **sizes):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in D.near_duplicates(docs(*rows), **sizes).collect())


def corpus(seed, bases, copies, length, edits):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(rng.randint(2, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("seed, length, edits", [(1, 90, 3), (2, 200, 6), (3, 40, 1)])
def test_equals_all_pairs(docs, seed, length, edits):
    texts = corpus(seed, 12, 20, length, edits)
    rows = list(enumerate([*texts, *texts[::5], "", None, " \t ", "a b", "A\u000bB", "Ä b", "ä b", "one", "a b c d e"]))
    random.Random(seed).shuffle(rows)
    assert found(docs, rows) == brute(rows)


def test_many_members_in_one_bucket(docs):
    # members are linked by chains, not through one hub
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    text, texts = [rng.choice(words) for _ in range(120)], []
    for _ in range(80):
        text = list(text)
        text[rng.randrange(len(text))] = rng.choice(words)
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    assert found(docs, rows, block=8) == brute(rows)


def test_every_pair_within_the_radius_shares_a_slot():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, (4000, D.VALUES), dtype=np.uint16)
    other = base.copy()
    for row in other:
        at = rng.choice(D.VALUES, rng.integers(0, D.RADIUS + 1), replace=False)
        row[at] ^= np.uint16(1)
    slots = D.first_slots(base == other)
    assert (slots < D.VALUES).all()
    chunk, out = slots // D.WIDTH, slots % D.WIDTH
    for a, b, c, o in zip(base, other, chunk, out):
        kept = [c * D.WIDTH + k for k in range(D.WIDTH) if k != o]
        assert (a[kept] == b[kept]).all()


def test_keys_of_slots(spark):
    sig = np.arange(D.VALUES, dtype=np.uint16)
    changed = sig.copy()
    changed[7] += 1
    nodes = spark.createDataFrame([(0, bytearray(sig.tobytes())), (1, bytearray(changed.tobytes()))], "nid long, sig binary")
    keys = {}
    for r in D.bucket_keys(nodes).collect():
        keys.setdefault(r["slot"], {})[r["nid"]] = r["key"]
    assert len(keys) == D.VALUES
    differ = {s for s, k in keys.items() if k[0] != k[1]}
    assert differ == {5, 6, 8, 9}  # all slots of the second chunk but the one that leaves value 7 out


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, common in ((5, 0), (300, 250), (20_000, 19_000)):
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = pool[:n], pool[n - common:2 * n - common]
        bits = D.bitmaps(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= 2 * (n - common)


def test_odd_rows(docs):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, text.upper()), (None, text), (None, "alone in its class"), (9, None), (9, ""), (7, "x"), (None, None)]
    assert found(docs, rows) == sorted(
        [("5", 56, 3, False), ("5", 56, 3, False), ("3", 56, 3, True), ("None", 56, 3, False), ("None", 1, None, True), ("9", 0, 9, True),
         ("9", 0, 9, True), ("7", 1, 7, True), ("None", 0, None, True)], key=lambda r: r[:2])


def test_very_long_text(docs):
    long = " ".join(f"v{i}" for i in range(150_000))
    rows = [(2, long), (1, long.replace("v77 ", "other ")), (3, long[:600_000])]
    assert found(docs, rows) == [("1", 149_996, 1, True), ("2", 149_996, 1, False), ("3", len(shingles(long[:600_000])), 3, True)]


def test_empty_table(docs):
    assert found(docs, []) == []
