"""Counts against plain Python; learning on planted rules."""

import collections
import random
import re

from acuity.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    count = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts(docs):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a b c a b c", "a a a a", "x\r\nx\r\n \nx", "a b c d " * 30, "😀 é " * 40, "long " * 20_000] + [
        "".join(rng.choices("ab \n\t#$é\x0b\x1c", k=rng.randint(0, 60))) for _ in range(800)]
    rows = {r["doc_id"]: r for r in Q.counts(docs(*enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), text


def labelled(spark, docs, n=240):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 90))]
        if i % 4 == 0:
            words = [w + "###" for w in words]
        elif i % 4 == 1:
            words = [w.upper() * 3 for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 > 1), 0))
    return docs(*rows), spark.createDataFrame([*labels, (None, 1, 0), (5000, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_finds_planted_rules(spark, docs):
    given, labels = labelled(spark, docs)
    rows = Q.judge(given, labels).collect()
    assert len(rows) == 240 and all(r["kept"] == (r["doc_id"] % 4 > 1) for r in rows)


def test_no_python_in_the_plan(spark, docs):
    given, labels = labelled(spark, docs, 40)
    plan = Q.judge(given, labels)._jdf.queryExecution().toString() + Q.counts(given)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_rule_is_pruned_from_its_end():
    # feature a tells all; feature b only fits the growing part
    cells = [(0, 0, 30, 0, 5, 0), (0, 1, 8, 2, 10, 0), (1, 0, 0, 40, 0, 20), (1, 1, 0, 40, 0, 20)]
    assert Q.learn(cells, ["a", "b"], {"a": [1.0], "b": [5.0]}) == [[("a", "<", 1.0)]]


def test_without_labels_only_the_base_test_decides(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = Q.judge(docs((1, "w " * 10), (2, " ".join(f"w{i}" for i in range(60))), (2, None)), none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in rows) == [(1, 10, False), (2, 0, False), (2, 60, True)]
    assert Q.judge(docs(), none).collect() == []
