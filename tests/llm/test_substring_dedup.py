"""Sentence runs against plain Python."""

import random
import re

from acuity.llm import substring_dedup as S


def sentences(text):
    """(start, end, lower-case words) of each sentence, by the rule in words."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]
    starts = [k for k, (a, _, w) in enumerate(words) if k == 0 or "\n" in text[words[k - 1][1]:a]
              or words[k - 1][2][-1] in S.ENDS or (w[0].isupper() and not words[k - 1][2][0].isupper())]
    return [(words[a][0], words[b][0] if b < len(words) else len(text), [w.lower() for _, _, w in words[a:b]])
            for a, b in zip(starts, [*starts[1:], len(words)])]


def brute(rows, least):
    """Texts without the sentences of repeated runs; rows are (id, text)."""
    split = [sentences(t or "") for _, t in rows]
    runs = []
    for row, sent in enumerate(split):
        size = [len(w) for _, _, w in sent]
        mine = set()
        for i in range(len(sent)):
            ends = [j for j in range(i, len(sent)) if sum(size[i:j + 1]) >= least]
            starts = [j for j in range(i + 1) if sum(size[j:i + 1]) >= least]
            mine |= {(i, min(ends))} if ends else set()
            mine |= {(max(starts), i)} if starts else set()
        runs += [(row, i, j, tuple(w for s in sent[i:j + 1] for w in s[2])) for i, j in mine]
    key = lambda row: rows[row][0] if rows[row][0] is not None else S.LAST_ID
    lowest = {}
    for row, i, _, words in runs:
        lowest[words] = min(key(row), lowest.get(words, S.LAST_ID))
    gone = [set() for _ in rows]
    for row, i, j, words in runs:
        if key(row) > lowest[words] or any(r == row and a < i and w == words for r, a, _, w in runs):
            gone[row] |= set(range(i, j + 1))
    out = []
    for (_, text), sent, g in zip(rows, split, gone):
        out.append(text if not g else text[:sent[0][0]] + "".join(text[a:b] for k, (a, b, _) in enumerate(sent) if k not in g))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "Delta", "eps", "zeta", "eta", "Θeta"]) + rng.choice(["", "", "", ".", "!", ",", ".\n"])
    prose = lambda n: rng.choice([" ", "  "]).join(word() for _ in range(n))
    shared = [prose(rng.randint(12, 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        text = prose(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            text += " " + rng.choice(shared).replace(" ", rng.choice([" ", "\t"])) + " " + prose(rng.randint(0, 20))
        rows.append((i, text))
    return [*rows, (5, rows[5][1]), (7, rows[8][1]), (None, rows[3][1]), (None, rows[3][1]), (100, None), (101, ""), (102, " \n ")]


def test_equals_plain_python(docs):
    rows = corpus()
    got = S.remove_repeats(docs(*rows), 10).collect()
    wanted = brute(rows, 10)
    assert sum(a != b for a, (_, b) in zip(wanted, rows)) > 20
    order = lambda pairs: sorted(pairs, key=lambda p: (str(p[0]), str(p[1])))
    assert order((r["doc_id"], r["text"]) for r in got) == order((i, t) for (i, _), t in zip(rows, wanted))


def test_a_pasted_passage_goes_but_for_the_first_document(docs):
    passage = "The quick fox went over the hill. " * 1 + " ".join(f"w{i}" for i in range(25)) + ". " + " ".join(f"v{i}" for i in range(25)) + "."
    rows = [(i, f"start of text {i} and {passage} rest of text {i}.") for i in (4, 2, 9)]
    got = {r["doc_id"]: r["text"] for r in S.remove_repeats(docs(*rows)).collect()}
    assert got[2] == rows[1][1] and got[4] == "start of text 4 and rest of text 4." and got[9] == "start of text 9 and rest of text 9."


def test_scripts_without_blanks_and_other_marks(docs):
    hanzi = lambda a, n: "".join(chr(0x4E00 + 37 * k % 900 + a) for k in range(n))
    first, second = hanzi(0, 20) + "。", "「" + hanzi(5, 25) + "！」"
    thai = "".join(chr(0x0E01 + 7 * k % 40) for k in range(35))
    hindi = " ".join("कखगघ"[k % 4] + "तथदध"[k % 3] + str(k) for k in range(32)) + "।"
    urdu = " ".join("ابجد"[k % 4] + str(k) for k in range(32)) + "؟"
    for part, ahead, other in ((first + second, hanzi(700, 9) + "？", hanzi(800, 8) + "。"), (thai, "ไทย ", "ลาว "), (hindi, "क ख। ", "ग घ। "),
                               (urdu, "ا ب؟ ", "ج د؟ "), ("\U00020000" * 31 + "。", "中。", "文。")):
        rows = [(1, ahead + part), (2, other + part), (3, part)]
        got = {r["doc_id"]: r["text"] for r in S.remove_repeats(docs(*rows)).collect()}
        assert got == {1: rows[0][1], 2: other, 3: ""}


def test_one_very_long_text(docs):
    """A passage in the middle of a text of a megabyte goes, the rest of the text stays."""
    passage = "Once more " + " ".join(f"shared{i}" for i in range(60)) + "."
    before, after = (" ".join(f"Line {k}{i} says {k}{i * 3} and then {k}{i * 5}." for i in range(16_000)) for k in "ab")
    rows = {r["doc_id"]: r["text"] for r in S.remove_repeats(docs((1, passage), (2, f"{before} {passage} {after}"))).collect()}
    assert rows[1] == passage
    assert "shared30" not in rows[2] and rows[2].split() == f"{before} {after}".split()


def test_empty_table(docs):
    assert S.remove_repeats(docs()).collect() == []
