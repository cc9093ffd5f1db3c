"""Personal data in texts, plain and disguised.

Base spans are the leftmost non-overlapping matches of four patterns. For
disguised data, transducers rewrite a text and keep for every character of the
result the source characters it stands for: look-alike letters and full-width
characters, ``at`` and ``dot`` in brackets or between the parts of an address,
and runs of spelled digits. A bare ``at`` before plain dots counts if the part
before it has a dot, digit, underscore or plus, or follows a word such as
``mail`` or ``contact``. Identifiers found in the rewritten text are mapped
back; a span is added if it has a rewritten character and does not lie inside a
base span of its kind. An address with a look-alike letter thus has its plain
part as a base span and the whole as an added one; masking takes their union.

An empty table gives an empty one. Null and empty texts have no spans. Offsets are code points, ends are
exclusive. Of added spans of one kind that overlap, the first in the rewritten
text stays. Spans sort by start, then kind. Repeated rows get equal results.
"""

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
# fixed values: patterns of the base spans
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number pattern can only start at the first digit of a run: the look-behind keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# fixed values: letters that look like Latin ones
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοινρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoivptuABEZHIKMNOPTYX"))
LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
# fixed values: names of the digits
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
          "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "|".join(DIGITS)
_ODD = re.compile("[" + "".join(LOOKALIKES) + "]")
_BRACKET = re.compile(r"[\[({<]\s*+(?:at|dot|@|\.)\s*+[\])}>]", re.I)
_RUN = re.compile(rf"\b(?:plus[\s,-]++)?(?:{_DIGIT})(?:[\s,-]++(?:(?:dot|point)[\s,-]++)?(?:{_DIGIT}))+\b", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_DOT = r"(?:\s++dot\s++|\s*+[\[({<]\s*+(?:dot|\.)\s*+[\])}>]\s*+|\.)"
_AT = r"(?:\s++at\s++|\s*+[\[({<]\s*+(?:at|@)\s*+[\])}>]\s*+|@)"
# possessive: a chain of parts is read once, whether an "at" follows or not, so that long chains stay linear
_PART, _DOMAIN = "[A-Za-z0-9_%+-]++", rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-]){_PART}(?:(?:{_DOT}{_PART})++(?:(?P<at>{_AT}){_DOMAIN})?|(?P<at1>{_AT}){_DOMAIN})", re.I)
_PART_DOT = re.compile(_DOT, re.I)
# a bare "at" before a domain with plain dots: "look at example.com" is prose, "jane.smith at example.com" an address
_BARE = re.compile(r"\sat\s++[A-Za-z0-9-]++\.[A-Za-z0-9]", re.I)
_ENDING = re.compile(r"\.[A-Za-z]{2,}\Z")
# fixed values: words before an address, those between, and those that stand for no mailbox
_CUE = re.compile(r"\b(?:e-?mail(?:s|ed|ing)?|mail(?:s|ed|ing|to)?|contact(?:s|ed|ing)?|address|write|reach)(?:[\s:,]++(?:me|us|is|to|address)\b)*+[\s:,]++", re.I)
_NO_BOX = frozenset("me us him her them you it out list lists page pages form forms details address addresses".split())


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text)
              if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _addressed(text: str, start: int, at: int, end: int, cued: set[int]) -> bool:
    """Whether a bare "at" between a local part and a domain with plain dots makes an address."""
    local = text[start:at]
    if not _ENDING.search(text, start, end):
        return False
    return re.search("[.0-9_+]", local) is not None or (start in cued and local.lower() not in _NO_BOX)


def _edits(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the transducers, left to right without overlaps."""
    edits = []
    lowered = text if text.isascii() else text.translate({ord(k): v for k, v in LOOKALIKES.items()})
    if lowered is not text:
        edits += [(m.start(), m.end(), LOOKALIKES[m[0]]) for m in _ODD.finditer(text)]
    low = lowered.lower() if len(lowered.lower()) == len(lowered) else lowered
    if "dot" in low or _BRACKET.search(low) or _BARE.search(low):
        cued = {m.end() for m in _CUE.finditer(lowered)}
        for m in _ADDRESS.finditer(lowered):
            group = "at" if m["at"] else "at1"
            if not m[group] or not (re.search(r"\s", m[0]) or _BRACKET.search(m[0])):
                continue
            first, last = m.span(group)
            dots = [*_PART_DOT.finditer(lowered, m.start(), first), *_PART_DOT.finditer(lowered, last, m.end())]
            if (m[group].strip().lower() == "at" and all(x[0] == "." for x in dots if x.start() >= last)
                    and not _addressed(lowered, m.start(), first, m.end(), cued)):
                continue
            edits += [(x.start(), x.end(), ".") for x in dots]
            edits.append((first, last, "@"))
        for m in re.finditer(rf"(?<=[0-9]){_DOT}(?=[0-9])", lowered, re.I):
            if m[0] != ".":
                edits.append((m.start(), m.end(), "."))
    for m in _RUN.finditer(lowered):
        end = m.start()
        for w in _WORD.finditer(lowered, m.start(), m.end()):
            word = w[0].lower()
            new = "+" if word == "plus" else "." if word in ("dot", "point") else DIGITS[word]
            edits.append((end if new != "+" and end > m.start() else w.start(), w.end(), new))
            end = w.end()
    out, done = [], 0
    for e in sorted(set(edits), key=lambda e: (e[0], -e[1])):
        if e[0] >= done:
            out.append(e)
            done = e[1]
    return [e for e in out if text[e[0]:e[1]] != e[2]]


def rewritten(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """The rewritten text and, for each of its characters, source start, source end, whether it was rewritten."""
    parts, starts, ends, changed, at = [], [], [], [], 0
    for a, b, new in [*_edits(text), (len(text), len(text), "")]:
        parts += [text[at:a], new]
        starts += [*range(at, a), *[a] * len(new)]
        ends += [*range(at + 1, a + 1), *[b] * len(new)]
        changed += [*[False] * (a - at), *[True] * len(new)]
        at = b
    return "".join(parts), starts, ends, changed


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans."""
    base = base_spans(text)
    if not (_BRACKET.search(text) or (not text.isascii() and _ODD.search(text)) or "dot" in text.lower()
            or _RUN.search(text) or _BARE.search(text)):
        return base, []
    plain, starts, ends, changed = rewritten(text)
    if not any(changed):
        return base, []
    taken = {k: [(a, b) for a, kind, b in base if kind == k] for k in range(len(KINDS))}
    done = [0] * len(KINDS)
    marks = [0]
    for c in changed:
        marks.append(marks[-1] + c)
    added = []
    for a, kind, b in base_spans(plain):
        first, last = starts[a], ends[b - 1]
        # a span wider than a base span stands beside it; one inside a base span adds nothing
        near = bisect.bisect_right(taken[kind], (first, len(text))) - 1
        inside = near >= 0 and taken[kind][near][1] >= last
        if marks[b] > marks[a] and first >= done[kind] and not inside:
            done[kind] = last
            added.append((first, kind, last))
    return base, sorted(added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts per kind, digest of the base spans, all spans, number of added spans."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = all_spans(text or "")
                kinds = [k for _, k, _ in base]
                rows.append((*[kinds.count(k) for k in range(len(KINDS))], hashlib.sha256(written(base).encode()).hexdigest(),
                             written(sorted(base + added)), len(added)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, "
             "base_sha256 string, spans string, n_added long")


def masked(text: str | None) -> str | None:
    """The text with each span, or union of overlapping spans, replaced by the kind of the first: ``<EMAIL>``."""
    if not text:
        return text
    base, added = all_spans(text)
    parts, at, end = [], 0, 0
    for a, kind, b in sorted(base + added):
        if a >= end:
            parts += [text[end:a], f"<{KINDS[kind].upper()}>"]
        end = max(end, b)
    return "".join([*parts, text[end:]]) if parts else text


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns, with personal data masked in ``text`` and ``n_chars``, where present, counted anew."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [masked(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()).cast(batch.schema.field(at).type))
    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.select([F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind).alias(c)
                       if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
