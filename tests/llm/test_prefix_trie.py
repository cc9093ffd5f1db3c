"""Prefix trie against nested dictionaries, for several lengths of segments and numbers of parts."""

import hashlib
import random
import zlib

import pytest

from acuity.llm import prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string, pre string, depth int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    original = {c: [t for *_, t in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seqs[c] = tuple(original.get(base, [])[:h] + own[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **sizes):
    return sorted((tuple(r) for r in T.trie(table(spark, rows), **sizes).collect()), key=str)


def corpus(seed, convs, longest, words):
    rng = random.Random(seed)
    said = [f"é{k}" * (k + 1) for k in range(words)]
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", said[min(rng.randrange(words), rng.randrange(words))]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("segment", [1024, 3, 1])
def test_equals_nested_dictionaries(spark, segment):
    for seed, convs, longest, words in ((1, 60, 14, 2), (2, 40, 9, 5)):
        rows = corpus(seed, convs, longest, words)
        assert found(spark, rows, segment=segment) == brute(rows)


def test_copies_reach_over_many_parts(spark):
    same = [(c, t, "user", f"turn {t}") for c in range(120) for t in range(12)]
    rows = same + [(200 + c, 0, "user", "turn 0") for c in range(40)] + [(300 + c, t, "user", f"turn {t}") for c in range(20) for t in range(13)]
    for segment in (1024, 4):
        assert found(spark, rows, segment=segment, piece=3, rows_per_part=5) == brute(rows)


def test_long_conversation_is_numbered_in_several_parts(spark):
    rows = [(5, t, "user", f"turn {t % 3}") for t in range(700)] + [(6, t, "user", f"turn {t % 3}") for t in range(400)] + [(7, 1, "a", "b")]
    assert found(spark, rows, segment=16) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 2, "user", None), (1, 2, "user", "tie"), (1, 2, "user", "tie"), (-3, 1, "", ""),
            (-5, 1, "a", "x"), (-5, 0, "a", "y"), (8, 1, "u", "long " * 50_000), (12, 1, "a", "bc"), (13, 1, "ab", "c"), (10, 3, "q", "r")]
    rows += [(12, t, "a", "bc") for t in range(9)] + [(13, t, "ab", "c") for t in range(12)]
    assert found(spark, rows) == brute(rows)


def test_only_turnless(spark):
    # neither has a turn after its first h, and their base is absent
    few = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 9 >= 1 and c % 5][:3]
    rows = [(c, 0, "u", "x") for c in few]
    assert found(spark, rows) == brute(rows)
    (root,) = found(spark, rows)
    assert root[:7] == (min(few), 0, None, 3, 0, 1, 0)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "a", "b")]) == []
