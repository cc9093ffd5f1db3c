"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items are five-word shingles. A window of a document has as many
shingles as an item (fewer where the document ends first). Its 64-bit SimHash
is joined with an index of the items' SimHashes: four blocks of 16 bits, each
item filed under its size and every block value within four bits of its own.
Two fingerprints within ``RADIUS`` = 19 bits differ in at most four bits of
some block, so the join returns all of them. Candidates are verified exactly by
the weighted Jaccard similarity of window and item, weights being how often a
shingle occurs; 0.8 or more is a leak.

Items, index, windows and candidates are tables; none passes through the
driver. Tasks that read documents know two bitmaps of ``FILTER_BITS`` bits each
(of the items' shingles, and of these with the size of their item) and the
distinct sizes, at most one number per word of the longest item. A window gets
a fingerprint if the bitmaps let it reach the threshold: equal shingles are
marked alike, so a window below that bound has a smaller similarity with every
item of its size. With very many items the bitmaps fill up, which costs
fingerprints and changes no result.

Null and empty texts, on either side, match nothing. A text of one to four
words is one shingle, which only a text of the same words has. Repeated rows,
on either side, give equal results, each for itself. Items with equal
shingles match alike; among windows with equal similarity the first counts. Without documents there are no
leaks; without items none either, and all documents stay.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.words import chunks, mix, shingle_hashes, word_hashes

THRESHOLD = 0.8
BLOCKS = 4
BLOCK_ERRORS = 4
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
FILTER_BITS = 1 << 24
STARTS = 20_000  # window starts fingerprinted at a time
ITEMS = 100  # items filed at a time


def simhash(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each run ``shingles[start:end]``; a bit is set if most of its shingles have it set."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
    most = 2 * (sums[ends] - sums[starts]) > (ends - starts)[:, None]
    return np.packbits(most, axis=1).view(np.uint64).ravel()


def _masks() -> np.ndarray:
    """All 16-bit values with at most ``BLOCK_ERRORS`` bits set."""
    values = np.arange(1 << 16, dtype=np.uint64)
    return values[np.bitwise_count(values) <= BLOCK_ERRORS]


# --- items -------------------------------------------------------------------
def _item_shingles(batches):
    for batch in batches:
        for first, part in chunks(batch.column("text").to_pylist()):
            shingles, bounds = shingle_hashes(*word_hashes(part)[:2])
            prints = simhash(shingles, bounds[:-1], bounds[1:])
            out = pa.RecordBatch.from_arrays([
                batch.column("item_id").slice(first, len(part)), pa.array(np.diff(bounds).astype(np.int32)),
                pa.array(prints.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64))),
            ], names=["item_id", "size", "print", "item_shingles"])
            yield out.filter(pa.array(np.diff(bounds) > 0))


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, size, print, item_shingles of the items that have words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_item_shingles, "item_id long, size int, print long, item_shingles array<long>")


def index_items(items: DataFrame) -> DataFrame:
    """One row per item, block and value that a fingerprint within the radius can have there."""
    def file(batches):
        masks = _masks()
        for batch in batches:
            for k in range(0, batch.num_rows, ITEMS):
                item, size, prints = (c.to_numpy(zero_copy_only=False) for c in batch.slice(k, ITEMS).columns)
                for b in range(BLOCKS):
                    part = prints.view(np.uint64) >> np.uint64(16 * b) & np.uint64(0xFFFF)
                    values = (part[:, None] ^ masks[None, :]).ravel().astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array(np.repeat(x, len(masks))) for x in (item, size, prints)),
                        pa.array(np.full(len(values), b, np.int32)), pa.array(values),
                    ], names=["item", "size", "item_print", "block", "value"])
    return items.select("item", "size", "print").mapInArrow(
        file, "item long, size int, item_print long, block int, value int")


class Filter:
    """What tasks know of all items: two bitmaps of a fixed size and the distinct sizes."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros((2, max(bits // 64, 1)), np.uint64)
        self.sizes = np.zeros(0, np.int64)

    def places(self, shingles: np.ndarray, size: int | None = None) -> np.ndarray:
        if size is not None:
            shingles = mix(shingles ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
        return (shingles & self.mask).astype(np.int64)

    def add(self, shingles: np.ndarray, size: int) -> None:
        for words, at in zip(self.words, (self.places(shingles), self.places(shingles, size))):
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

    def holds(self, shingles: np.ndarray, size: int | None = None) -> np.ndarray:
        at = self.places(shingles, size)
        return (self.words[int(size is not None)][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def windows(self, shingles: np.ndarray, hits: np.ndarray, threshold: float) -> Iterator[tuple]:
        """(size, starts, ends) of the windows that can reach the threshold; ``hits`` are the places that ``holds`` names."""
        n = len(shingles)
        for size in self.sizes[self.sizes * threshold <= len(hits)].tolist():
            mine = hits[self.holds(shingles[hits], size)]
            if len(mine) < size * threshold - 1e-9:
                continue
            starts = np.arange(max(mine[0] - size + 1, 0), mine[-1] + 1)
            ends = np.minimum(starts + size, n)
            common = np.searchsorted(mine, ends) - np.searchsorted(mine, starts)
            able = common * (1 + threshold) >= threshold * (ends - starts + size) - 1e-9
            if able.any():
                yield size, starts[able], ends[able]


def item_filter(items: DataFrame, bits: int) -> Filter:
    """Bitmaps are joined by Spark; ``bits`` / 32 numbers and the sizes reach the driver, however many items there are."""
    def mark(batches):
        part = Filter(bits)
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            values = batch.column("item_shingles")
            for i, size in enumerate(sizes):
                part.add(values[i].values.to_numpy().view(np.uint64), size)
        kind, word = np.nonzero(part.words)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(word.astype(np.int32)),
                                          pa.array(part.words[kind, word].view(np.int64))], names=["kind", "word", "bits"])
    words = items.select("size", "item_shingles").mapInArrow(mark, "kind int, word int, bits long").groupBy("kind", "word").agg(
        F.expr("bit_or(bits) as bits")).toArrow()
    known = Filter(bits)
    kind, word, value = (words.column(c).to_numpy() for c in ("kind", "word", "bits"))
    known.words[kind, word] = value.view(np.uint64)
    known.sizes = np.sort(items.select("size").distinct().toArrow().column(0).to_numpy().astype(np.int64))
    return known


# --- documents ---------------------------------------------------------------
def _text_windows(known: Filter, texts: list, threshold: float) -> Iterator[tuple[int, np.ndarray, list]]:
    """(place of the text, its shingles, [(size, starts, ends)]) of the texts with a window that can reach the threshold."""
    for first, part in chunks(texts):
        shingles, bounds = shingle_hashes(*word_hashes(part)[:2])
        hits = np.flatnonzero(known.holds(shingles))
        low, high = np.searchsorted(hits, bounds[:-1]), np.searchsorted(hits, bounds[1:])
        for i in np.flatnonzero(high > low).tolist():
            own = shingles[bounds[i]:bounds[i + 1]]
            found = list(known.windows(own, hits[low[i]:high[i]] - bounds[i], threshold))
            if found:
                yield first + i, own, found


def _fingerprints(shingles: np.ndarray, found: list) -> list[np.ndarray]:
    """Columns size, begin, stop, print of the windows."""
    columns = []
    for size, starts, ends in found:
        prints = []
        while sum(map(len, prints)) < len(starts):
            k = sum(map(len, prints))
            base, stop = starts[k], np.searchsorted(starts, starts[k] + STARTS)
            prints.append(simhash(shingles[base:ends[stop - 1]], starts[k:stop] - base, ends[k:stop] - base))
        columns.append((np.full(len(starts), size, np.int32), starts.astype(np.int32), ends.astype(np.int32),
                        np.concatenate(prints).view(np.int64)))
    return [np.concatenate(c) for c in zip(*columns)]


def _suspects(rows: DataFrame, sent, threshold: float) -> DataFrame:
    """Rows (row, text) with a window that can reach the threshold: row, shingles, windows, and their number ``at``, as files."""
    def run(batches):
        for batch in batches:
            for i, shingles, found in _text_windows(sent.value, batch.column("text").to_pylist(), threshold):
                columns = _fingerprints(shingles, found)
                windows = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["size", "begin", "stop", "print"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(i, 1),
                    pa.ListArray.from_arrays(pa.array([0, len(shingles)], pa.int32()), pa.array(shingles.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array([0, len(windows)], pa.int32()), windows),
                ], names=["row", "shingles", "windows"])
    schema = rows.select("row", F.expr("cast(null as array<bigint>) as shingles"), F.expr(
        "cast(null as array<struct<size: int, begin: int, stop: int, print: bigint>>) as windows")).schema
    return store.write(rows.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id()))


def near_items(windows: DataFrame, items: DataFrame) -> DataFrame:
    """at, item, spans: the windows (at, size, begin, stop, print) within the radius of an item of their size.

    The index is some 10,000 rows per item, so it is dealt out by its keys and never copied to every executor.
    """
    probes = windows.select("at", "size", "begin", "stop", "print", F.posexplode(F.expr(
        f"transform(sequence(0, {BLOCKS - 1}), b -> cast(shiftrightunsigned(print, 16 * b) & 65535 as int))")).alias("block", "value"))
    near = probes.join(index_items(items).hint("merge"), ["size", "block", "value"]).filter(f"bit_count(print ^ item_print) <= {RADIUS}")
    return near.groupBy("at", "item").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))


def _similarity(window: np.ndarray, held: dict[int, int], size: int) -> float:
    values, counts = np.unique(window, return_counts=True)
    common = sum(min(n, held.get(v, 0)) for v, n in zip(values.tolist(), counts.tolist()))
    return common / (len(window) + size - common)


def _verified(suspects: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """at, item_id, similarity, first_word, end_word of the best window of every leak."""
    def verify(batches):
        for batch in batches:
            rows = []
            at, item_id, low = (batch.column(c).to_pylist() for c in ("at", "item_id", "low"))
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                part, item = (batch.column(c)[i].values.to_numpy() for c in ("part", "item_shingles"))
                held = dict(zip(*(x.tolist() for x in np.unique(item, return_counts=True))))
                best = (0.0, 0, 0)
                for begin, stop in sorted((s["begin"], s["stop"]) for s in spans):
                    value = _similarity(part[begin - low[i]:stop - low[i]], held, len(item))
                    if value > best[0]:
                        best = (value, begin, stop)
                if best[0] >= threshold:
                    rows.append((at[i], item_id[i], best[0], best[1], best[2] + 4))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                names=["at", "item_id", "similarity", "first_word", "end_word"])
    windows = suspects.select("at", F.inline("windows"))
    near = near_items(windows, items).withColumn("low", F.expr("array_min(spans.begin)"))
    parts = near.join(suspects.select("at", "shingles"), "at").select(
        "at", "item", "spans", "low", F.expr("slice(shingles, low + 1, array_max(spans.stop) - low) as part"))
    return parts.join(items.select("item", "item_id", "item_shingles"), "item").mapInArrow(
        verify, "at long, item_id long, similarity double, first_word long, end_word long")


def _kept_items(items: DataFrame) -> DataFrame:
    return store.write(items.withColumn("item", F.monotonically_increasing_id()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, similarity, first_word, end_word."""
    items = _kept_items(item_table(benchmark))
    sent = docs.sparkSession.sparkContext.broadcast(item_filter(items, FILTER_BITS))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    suspects = _suspects(rows, sent, threshold)
    return _verified(suspects, items, threshold).join(suspects.select("at", "row.doc_id"), "at").select(
        "doc_id", "item_id", "similarity", "first_word", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    ``docs`` is read twice: rows without a window that can reach the threshold
    stay where they are, only the others are written, verified and joined.
    """
    items = _kept_items(item_table(benchmark).dropDuplicates(["item_shingles"]))
    sent = docs.sparkSession.sparkContext.broadcast(item_filter(items, FILTER_BITS))
    at = docs.columns.index("text")

    def clear(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _, _ in _text_windows(sent.value, batch.column(at).cast(pa.string()).to_pylist(), threshold)]] = False
            yield batch.filter(pa.array(keep))
    suspects = _suspects(docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text")), sent, threshold)
    leaked = _verified(suspects, items, threshold).select("at").distinct()
    cleared = suspects.join(leaked, "at", "left_anti").select("row.*")
    return docs.mapInArrow(clear, docs.schema).unionAll(cleared)
