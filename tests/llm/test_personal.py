"""Personal data against plain regular expressions, and disguised data."""

import hashlib
import random
import re
import time

from acuity.llm import personal as P

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def test_base_spans():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choices("ab@..-+%1234567890 ()é", k=rng.randint(0, 45)))
        assert P.base_spans(text) == brute(text), text


def test_disguised():
    for text, wanted in {
        "mail jоhn (at) exаmple [dot] com now": "jоhn (at) exаmple [dot] com",
        "or mary at example dot org.": "mary at example dot org",
        "call plus four four two zero seven nine four six zero nine five eight please":
            "plus four four two zero seven nine four six zero nine five eight",
        "host 192 dot 168 dot 1 dot 7!": "192 dot 168 dot 1 dot 7",
        "tel ＋４４ ２０ ７９４６ ０９５８": "＋４４ ２０ ７９４６ ０９５８",
    }.items():
        base, added = P.all_spans(text)
        assert base == [] and [text[a:b] for a, _, b in added] == [wanted]
    for text in ("look at example.com", "the dot is at one two three", "at dot", "", "see one or two (at) home"):
        assert P.all_spans(text) == ([], [])


def test_runs_of_few_different_digits():
    for run, kind in (("four two " * 8, "CARD"), ("plus one nine one nine nine nine one one nine nine ", "PHONE")):
        for text in (run, f"{run}done", f"phone {run}and six, seven, eight"):
            assert P.masked(text) == text.replace(run.strip(), f"<{kind}>")


def test_bare_at_and_long_disguises():
    for text, wanted in {
        "ask jane.smith92 at example.com.": "jane.smith92 at example.com",
        "ask jane_s at example.co.uk now": "jane_s at example.co.uk",
        "E-mail me: jane at example.com, please": "jane at example.com",
        "contact jane at example.com": "jane at example.com",
        "a dot b dot c dot d dot e dot f at u.v.w.x.y.z.example dot com": "a dot b dot c dot d dot e dot f at u.v.w.x.y.z.example dot com",
        "jane (     at     )\n\n\n\n\nexample     dot     com": "jane (     at     )\n\n\n\n\nexample     dot     com",
        "jane\tat\texample.x\tdot\tcom": "jane\tat\texample.x\tdot\tcom",
        "jane.s\nat\nexample.com": "jane.s\nat\nexample.com",
        "plus     one, nine one nine nine\n\n\n\nnine one one nine nine": "plus     one, nine one nine nine\n\n\n\nnine one one nine nine",
    }.items():
        assert [text[a:b] for a, _, b in P.all_spans(text)[1]] == [wanted]
    for text in ("look at example.com", "contact us at example.com", "look at dotted.com", "closed at 3.5", "room2 at 10.30", "we met at home.Then"):
        assert P.all_spans(text) == ([], [])


def test_long_chains_are_linear():
    for text in ("a dot " * 200_000, "one" + " " * 500_000 + "x", "a.s at b " * 100_000, "a" * 1_000_000 + " at b.c", "mail " * 200_000 + "a at b.co",
                 "(  " * 300_000 + "dot", "a at b.co " * 50_000, "a [dot] " * 100_000):
        began = time.process_time()
        P.all_spans(text)
        assert time.process_time() - began < 10


def test_base_spans_stay_beside_added_ones():
    text = "me@x.org or me at x dot org"
    assert P.all_spans(text) == ([(0, 0, 8)], [(12, 0, 27)])
    assert P.masked(text) == "<EMAIL> or <EMAIL>"


def test_rows(docs):
    rows = P.find_personal_data(docs((1, "a@b.co"), (2, None), (None, ""), (1, "a@b.co"))).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["n_email"], r["spans"], r["base_sha256"]) for r in rows) == sorted(
        [(1, "email:0:6", hashlib.sha256(b"email:0:6").hexdigest())] * 2 + [(0, "", empty)] * 2)
    assert P.find_personal_data(docs()).collect() == []


def test_masking_keeps_rows_and_columns(docs):
    given = docs((1, "to a@b.co now"), (2, None), (3, "nothing"))
    got = {r["doc_id"]: r for r in P.mask_personal_data(given).collect()}
    assert got[1]["text"] == "to <EMAIL> now" and got[1]["n_chars"] == 14
    assert got[2]["text"] is None and got[2]["n_chars"] is None and got[3]["text"] == "nothing"
    assert P.mask_personal_data(given).columns == given.columns


def test_look_alikes_inside_an_address():
    for text, wide in (("mail jаne@example.com now", "jаne@example.com"), ("jane@example.cоm", "jane@example.cоm"), ("x јоhn@ехample.org.", "јоhn@ехample.org")):
        base, added = P.all_spans(text)
        assert [text[a:b] for a, k, b in added if k == 0] == [wide]
        assert wide not in P.masked(text) and "@" not in P.masked(text) and base == P.base_spans(text)
    assert P.masked("mail jаne@example.com now") == "mail <EMAIL> now" and P.masked("jane@example.cоm") == "<EMAIL>"


def test_added_spans_equal_a_plain_comparison():
    """The sweep against comparing each rewritten span with every base span."""
    import random
    rng = random.Random(3)
    pieces = ["jаne@example.com", "jane at example dot com", "four two four two", "jane@example.com", "10 dot 0 dot 0 dot 1", "10.0.0.1", "+1 202 555 0100",
              "plus one two zero two five five five zero one zero zero", "words", "jane [at] example.cоm", "４２４２ 4242 4242 4242"]
    for _ in range(200):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        base, added = P.all_spans(text)
        plain, starts, ends, changed = P.rewritten(text)
        want = sorted({(starts[a], k, ends[b - 1]) for a, k, b in P.base_spans(plain) if any(changed[a:b])
                       and not any(k == j and x <= starts[a] and ends[b - 1] <= y for x, j, y in base)})
        assert added == want


def test_many_added_spans_take_time_in_proportion():
    import time
    text = "jane.smith at example dot com, " * 50_000
    start = time.perf_counter()
    base, added = P.all_spans(text)
    assert len(added) == 50_000 and base == [] and time.perf_counter() - start < 10
