"""N-gram join against all pairs."""

import random

import numpy as np

from acuity.llm import ngram_join as J
from acuity.llm.components import components


def brute(texts):
    """(class, links, linked texts) of each text by comparing all pairs."""
    sets = J.shingle_sets(texts)
    n = len(sets)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links, other = [0] * n, [set() for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if len(sets[a]) and len(sets[b]):
                common = len(np.intersect1d(sets[a], sets[b]))
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                    links[a] += 1
                    links[b] += 1
                    if common != len(sets[a]) or common != len(sets[b]):
                        other[a].add(sets[b].tobytes())
                        other[b].add(sets[a].tobytes())
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return [(find(i), links[i], len(other[i])) for i in range(n)]


def corpus(seed, bases, copies, length):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(bases):
        base = [rng.choice(words) for _ in range(length)]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    return out + out[::5]


def test_equals_all_pairs(docs):
    texts = corpus(1, 12, 12, 90) + ["", " ", "a b", "A  b!", "one", "a b c d e"]
    rows = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_linked_texts"])
            for r in J.jaccard_classes(docs(*enumerate(texts))).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_groups_above_a_block(docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    texts = corpus(2, 2, 70, 80)
    rows = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_linked_texts"])
            for r in J.jaccard_classes(docs(*enumerate(texts))).collect()}
    assert [rows[i] for i in range(len(texts))] == brute(texts)


def test_a_long_chain_costs_its_close_pairs(docs, monkeypatch):
    """Each text resembles its neighbours only: of 600 texts in one group every one meets a few, not all blocks."""
    monkeypatch.setattr(J, "BLOCK", 16)
    words = [f"w{i}" for i in range(6 * 600 + 100)]
    texts = [" ".join(words[6 * i:6 * i + 100]) for i in range(600)]
    seen = []
    whole = J.meetings
    monkeypatch.setattr(J, "meetings", lambda *a: seen.append(whole(*a)) or seen[-1])
    rows = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_linked_texts"])
            for r in J.jaccard_classes(docs(*enumerate(texts))).collect()}
    expected = brute(texts)
    assert [rows[i] for i in range(600)] == expected and {r[0] for r in expected} == {0}
    pairs = sum(r[1] for r in expected) // 2
    met = seen[0].count()
    assert pairs < met < 600 * 38 / 2  # below all blocks by far
    assert met <= 12 * pairs


def test_many_pairs_and_few_pairs_agree():
    sets = J.shingle_sets(corpus(3, 3, 30, 60))
    left, right = np.triu_indices(len(sets), 1)
    many = J.exact_links(sets, left, right, 0.8)
    few = np.concatenate([J.exact_links(sets, left[k:k + 1], right[k:k + 1], 0.8) for k in range(len(left))])
    assert many.any() and (many == few).all()


def test_pruning_keeps_pairs_at_the_threshold():
    least = J.needed_matches(0.8)
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(300):
        base = rng.integers(1, 1 << 60, 180, dtype=np.uint64)
        a, b = np.unique(base[:160]), np.unique(np.concatenate([base[:140], base[160:175]]))  # 140 of 175: 0.8
        sig = np.stack([J.minhash(a), J.minhash(b)])
        kept += len(J.prune(sig, np.array([0]), np.array([1]), least))
    assert kept >= 299


def test_keep_one_leaves_one_row_of_each_class(docs):
    text = " ".join(f"t{i}" for i in range(60))
    near = text.replace("t59", "zz")
    rows = J.keep_one(docs((5, text), (3, near), (3, near), (9, None), (9, None), (8, ""), (None, text), (7, "clean words here")))
    assert sorted((r["doc_id"], r["text"]) for r in rows.collect()) == [
        (3, near), (7, "clean words here"), (8, ""), (9, None)]
    assert rows.columns == docs((1, "a")).columns


def test_very_long_texts(docs):
    """Texts of a megabyte that differ in one word are near copies; a third one is not."""
    words = [f"w{i}" for i in range(130_000)]
    near = words[:60_000] + ["other"] + words[60_001:]
    texts = " ".join(words), " ".join(near), " ".join(words[::-1])
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_classes(docs(*enumerate(texts))).collect()}
    assert rows == {0: (0, 1), 1: (0, 1), 2: (2, 0)}


def test_empty_table(docs):
    assert J.jaccard_classes(docs()).collect() == [] and J.keep_one(docs()).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 12), (12, 10), *[(k, k + 1) for k in range(20, 60)]]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {2: 1, 3: 1, 11: 10, 12: 10, **{k: 20 for k in range(21, 61)}}
