"""Substring deduplication by sliding spans of sentences.

A sentence starts at the start of a text, after a line end, after ``. ! ?``
and at a capital letter behind a word that has none, so that a passage pasted
into the middle of a sentence still starts one. In scripts without blanks
(Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan) every character is a
word, a blank starts a sentence, and full-width marks end one with no white
space behind them. A *run* is a shortest run of
consecutive sentences of at least ``MIN_WORDS`` words, seen from its first or
from its last sentence. Every run of every text is hashed (96 bits, case and
white space apart), runs are grouped over all documents, and the sentences of
each run that also stands in a document with a smaller id, or earlier in the
same text, are removed.

Documents are told apart by ``doc_id``: rows that share an id are one
document and take nothing from each other, but a text never repeats itself. A
null id counts as one document behind all others. Null texts stay null, empty
texts empty. What is kept stays as it was, with its white space. Of several
copies the one with the smallest id stays whole. An empty table gives an empty
one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acuity.llm.joins import join_grouped
from acuity.llm.words import _BASE, _power, chunks, code_points, mix

MIN_WORDS = 30
LAST_ID = (1 << 63) - 1
# fixed values: sentence marks; those that end one without white space, and what may close behind them; scripts written without blanks
WIDE_ENDS = "。！？｡．"
ENDS = ".!?…‼⁇⁈⁉؟۔।॥።။។៕།༎։" + WIDE_ENDS
CLOSERS = "」』】》〉）］｝｣"
UNSPACED = ((0x0E00, 0x0EFF), (0x0F40, 0x0FBC), (0x1000, 0x1049), (0x1050, 0x109F), (0x1780, 0x17D3), (0x19E0, 0x19FF), (0x1A20, 0x1AAD), (0x3005, 0x3007),
            (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
_tables: list[np.ndarray] = []


def _table(k: int, codes: np.ndarray) -> np.ndarray:
    """Lower case (0), white space (1), upper case (2), sentence end (3), one without white space (4), closer (5) or unspaced script (6)."""
    if not _tables:
        letters = [chr(i) for i in range(0x10000)]
        _tables.append(np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(letters)], np.uint32))
        _tables.append(np.array([c.isspace() for c in letters]))
        _tables.append(np.array([c.isupper() for c in letters]))
        _tables.extend(np.array([c in marks for c in letters]) for marks in (ENDS, WIDE_ENDS, CLOSERS))
        _tables.append(np.array([any(a <= i <= b for a, b in UNSPACED) for i in range(0x10000)]))
    out = _tables[k][np.minimum(codes, 0xFFFF)]
    if k == 6:
        return np.where(codes > 0xFFFF, (codes >= 0x20000) & (codes < 0x40000), out)
    return np.where(codes > 0xFFFF, codes, out) if k == 0 else out & (codes <= 0xFFFF)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each but the first whether a sentence mark or a blank of an unspaced script stands before it."""
    space = np.ones(len(codes) + 1, bool)
    space[1:] = _table(1, codes)
    wide, marks = _table(6, codes), _table(4, codes)
    if not wide.any() and not marks.any():
        edge = np.flatnonzero(space[1:] != space[:-1])
        begins, ends = edge[::2], edge[1::2]
        return begins, ends, _table(3, codes[ends[:-1] - 1])
    closer = _table(5, codes)
    said = np.maximum.accumulate(np.where(closer, 0, np.arange(len(codes))))  # last place that is no closing bracket
    begin = wide.copy()
    begin[1:] |= marks[said[:-1]] & ~(marks | closer)[1:]
    begin = (begin | space[:-1]) & ~space[1:]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(~space[:-1] & (space[1:] | begin))
    last, nxt = ends[:-1] - 1, begins[1:]
    return begins, ends, _table(3, codes[said[last]]) | (wide[last] & wide[nxt] & (nxt > ends[:-1]))


class Runs:
    """Sentences and runs of some texts.

    ``starts``: code point of each sentence's first word; ``text_of``: its
    text; ``first``, ``last``: sentences of each run; ``h``, ``g``: its hashes.
    """

    def __init__(self, texts: list[str], min_words: int = MIN_WORDS):
        codes = code_points("\n".join([*texts, ""]))
        self.text_starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        begins, ends, ended = _words(codes)
        lines = np.concatenate([[0], np.cumsum(codes == 10)])
        fresh = np.ones(len(begins), bool)
        if len(begins):
            upper = _table(2, codes[begins])
            fresh[1:] = (lines[begins[1:]] > lines[ends[:-1]]) | ended | (upper[1:] & ~upper[:-1])
        power, inverse = _power(max(len(codes), len(begins)) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((_table(0, codes).astype(np.uint64) + np.uint64(1)) * power[:len(codes)], out=sums[1:])
        words = mix((sums[ends] - sums[begins]) * inverse[begins])
        start = np.flatnonzero(fresh)
        end = np.append(start[1:], len(begins))[:len(start)]
        self.starts = begins[start]
        self.text_of = np.searchsorted(self.text_starts, self.starts, "right") - 1
        rows = np.arange(len(start))
        forward = np.searchsorted(end, start + min_words)
        backward = np.searchsorted(start, end - min_words, "right") - 1
        first, last = np.concatenate([rows, backward]), np.concatenate([forward, rows])
        real = (first >= 0) & (last < len(start))
        first, last = first[real], last[real]
        same = self.text_of[first] == self.text_of[last]
        pairs = np.unique(first[same] * np.int64(len(start) + 1) + last[same])
        self.first, self.last = pairs // (len(start) + 1), pairs % (len(start) + 1)
        self.h, self.g = (self._hash(x, start[self.first], end[self.last], power, inverse)
                          for x in (words, mix(words ^ np.uint64(_BASE))))

    @staticmethod
    def _hash(words, a, b, power, inverse):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:len(words)])])
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))

    def repeats(self) -> np.ndarray:
        """Runs that stand earlier in the same text."""
        text = self.text_of[self.first]
        order = np.lexsort((self.first, self.g, self.h, text))
        again = np.zeros(len(order), bool)
        if len(order):
            a, b = order[1:], order[:-1]
            again[a] = (text[a] == text[b]) & (self.h[a] == self.h[b]) & (self.g[a] == self.g[b])
        return again


def _spans(min_words: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            crcs = batch.column(1).to_numpy(zero_copy_only=False)
            for first, part in chunks(batch.column(2).to_pylist()):
                r = Runs(part, min_words)
                keep = ~r.repeats()
                text = r.text_of[r.first][keep]
                base = np.searchsorted(r.text_of, np.arange(len(part)))[text]
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(r.h[keep].view(np.int64)), "g": pa.array((r.g[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    "d": pa.array(ids[first + text]), "crc": pa.array(crcs[first + text].astype(np.int64)),
                    "run": pa.array((r.first[keep] - base) << 32 | (r.last[keep] - base))})
    return run


def _cut(min_words: int):
    def run(batches):
        for batch in batches:
            texts, runs = batch.column("text").to_pylist(), batch.column("runs").to_pylist()
            out, total, removed = [], [], []
            for first, part in chunks(texts):
                r = Runs(part, min_words)
                again = r.repeats()
                bounds = np.searchsorted(r.text_of, np.arange(len(part) + 1))
                cover = np.zeros(len(r.starts) + 1, np.int64)
                np.add.at(cover, r.first[again], 1)
                np.add.at(cover, r.last[again] + 1, -1)
                for i in range(len(part)):
                    if runs[first + i]:
                        packed = np.array(runs[first + i], np.int64)
                        np.add.at(cover, bounds[i] + (packed >> 32), 1)
                        np.add.at(cover, bounds[i] + (packed & 0xFFFFFFFF) + 1, -1)
                gone = np.cumsum(cover)[:-1] > 0
                for i, text in enumerate(part):
                    mine = gone[bounds[i]:bounds[i + 1]]
                    total.append(len(mine))
                    removed.append(int(mine.sum()))
                    if mine.any():
                        places = [*(r.starts[bounds[i]:bounds[i + 1]] - r.text_starts[i]).tolist(), len(text)]
                        text = text[:places[0]] + "".join(text[a:b] for a, b, m in zip(places, places[1:], mine.tolist()) if not m)
                    out.append(text)
            out = [o if t is not None else None for o, t in zip(out, texts)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string()),
                                              "n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())})
    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, text without repeated sentences, n_sentences, n_removed.

    Runs are grouped with their smallest id, combined before the shuffle, and
    only then matched with the runs again; a run in a third of all documents is
    one row per task of the grouping, and the join is split by its rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("d"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(-1)).alias("crc"), "text", "doc_id")
    spans = rows.select("d", "crc", "text").mapInArrow(_spans(min_words), "h long, g int, d long, crc long, run long")
    owners = spans.groupBy("h", "g").agg(F.min("d").alias("_low"), F.max("d").alias("_high")).filter("_low < _high")
    later = join_grouped(spans, owners.drop("_high"), ["h", "g"]).filter("d > _low")
    cuts = later.groupBy("d", "crc").agg(F.collect_set("run").alias("runs"))
    return (rows.join(cuts, ["d", "crc"], "left").select("doc_id", "text", "runs")
            .mapInArrow(_cut(min_words), "doc_id long, text string, n_sentences long, n_removed long"))
