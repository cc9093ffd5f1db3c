"""MinHash near-dedup by a multi-index Hamming join: texts whose five-word shingle sets have a Jaccard similarity of 0.85 or more.

1. Words are runs of anything but the blanks U+0020 and U+0009 to U+000D, with
   A-Z lowered. A text becomes its set of shingles, a 128-bit hash of the set
   and a signature of ``VALUES`` MinHash values cut to 16 bits. Texts with equal
   sets are one *node*; copies never meet each other.
2. Two nodes are candidates if their signatures differ in at most ``RADIUS``
   values. The signature is split into ``CHUNKS`` chunks; by the pigeonhole
   principle one of them has at most one wrong value, so that a key per chunk and
   per value left out of it (60 keys) brings every such pair into a bucket. At
   similarity 0.85 a pair lies beyond the radius with probability 2.4e-6.
3. In each bucket all nodes first meet one hub, the node that shares most
   buckets with others. These links are confirmed on full sets, and join the
   members of most buckets. Only buckets that still hold several components
   go on: there, nodes of different components meet in blocks of ``BLOCK``, by
   pairs of blocks. Pairs beyond the radius are dropped, and pairs whose sets can't
   reach the threshold by the exact bound on hashed bitmaps: the sets' symmetric
   difference is no smaller than that of their bitmaps. Others are confirmed on
   full sets as well.
4. Confirmed links give the components.

No task holds a whole large bucket, and nothing is collected on the driver.

A text of one to four words has one shingle of all its words. Null and empty
texts and texts without words have none, and are linked with nothing: each is
its own component. Repeated rows are copies; each of them is kept if their id
names the component. A null ``doc_id`` names a component only if no id in it is
known. An empty table gives an empty one. Other columns don't matter. Long
texts are hashed whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.components import components
from acuity.llm.joins import join_grouped
from acuity.llm.ngram_join import _groups, _pairs
from acuity.llm.words import chunks, code_points, mix, shingle_hashes

PERCENT = 85
CHUNKS = 12
WIDTH = 5
VALUES = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
BITMAP = 2048
BLOCK = 2048
_MULTIPLIERS = mix(np.arange(1001, 1001 + VALUES, dtype=np.uint64)) | np.uint64(1)
_NONE = np.zeros(0, np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the bounds of each text in them."""
    codes = code_points("\n".join([*texts, ""])).astype(np.uint64)
    codes[(codes >= 65) & (codes <= 90)] += np.uint64(32)
    inside = np.zeros(len(codes) + 1, bool)
    inside[1:] = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    if not len(starts):
        return _NONE, bounds
    letters = codes[inside[1:]]
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    place = np.arange(len(letters)) - np.repeat(first, ends - starts)
    return mix(np.add.reduceat(mix(letters | (place.astype(np.uint64) << np.uint64(32))), first)), bounds


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, and the bounds of each text in them."""
    shingles, bounds = shingle_hashes(*word_hashes(texts))
    new = np.ones(len(shingles), bool)
    for a, b in zip(bounds[:-1], bounds[1:]):
        shingles[a:b].sort()
    new[1:] = shingles[1:] != shingles[:-1]
    some = bounds[:-1][bounds[:-1] < bounds[1:]]
    new[some] = True
    return shingles[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values of the non-empty sets that begin at ``starts``."""
    out = np.empty((len(starts), VALUES), np.uint16)
    for k in range(VALUES):
        out[:, k] = mix(np.minimum.reduceat(shingles * _MULTIPLIERS[k], starts)) & np.uint64(0xFFFF)
    return out


def _features(batches):
    for batch in batches:
        for first, part in chunks(batch.column(2).to_pylist()):
            shingles, bounds = shingle_sets(part)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            keys, sig = np.zeros((2, len(part)), np.int64), [None] * len(part)
            if len(some):
                starts = bounds[some]
                for row, seed in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    keys[row, some] = np.add.reduceat(mix(shingles ^ np.uint64(seed)), starts).view(np.int64)
                for i, row in zip(some, signatures(shingles, starts)):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), pa.array(keys[0]), pa.array(keys[1]),
                pa.array(sizes, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_crc", "s0", "s1", "n_shingles", "sig"])


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text.cast("binary")).alias("text_crc"), text.alias("text"))


def features(docs: DataFrame) -> DataFrame:
    """One row per document: its identity, set hash, set size and signature (null without shingles)."""
    return _rows(docs).mapInArrow(_features, "doc_id long, text_crc long, s0 long, s1 long, n_shingles long, sig binary")


def bucket_keys(nodes: DataFrame) -> DataFrame:
    """(nid, slot, key): slot names a chunk and the value left out of it, key is the hash of its other values."""
    parts = []
    for chunk in range(CHUNKS):
        for out in range(WIDTH):
            at = 2 * chunk * WIDTH + 1
            parts.append(f"xxhash64({chunk * WIDTH + out}, substring(sig, {at}, {2 * out}), "
                         f"substring(sig, {at + 2 * out + 2}, {2 * (WIDTH - out - 1)}))")
    return nodes.select("nid", F.posexplode(F.expr(f"array({', '.join(parts)})")).alias("slot", "key"))


def first_slots(equal: np.ndarray) -> np.ndarray:
    """The first slot that two signatures share, from which of their values are equal; ``VALUES`` if none."""
    wrong = ~equal.reshape(-1, CHUNKS, WIDTH)
    fits = wrong.sum(axis=2) <= 1
    chunk = fits.argmax(axis=1)
    slot = chunk * WIDTH + wrong[np.arange(len(wrong)), chunk].argmax(axis=1)
    return np.where(fits.any(axis=1), slot, VALUES)


def bitmaps(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each shingle flips one of ``BITMAP`` bits of its set's row."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    odd = np.zeros((len(bounds) - 1, BITMAP), np.uint8)
    np.bitwise_xor.at(odd, (owner, (mix(shingles) % np.uint64(BITMAP)).astype(np.int64)), 1)
    return np.packbits(odd, axis=1).view(np.uint64)


def meetings(rows: DataFrame, block: int) -> DataFrame:
    """Rows (slot, key, nid, n, ...) dealt to the meetings of the blocks of their bucket, sorted by bucket and meeting.

    ``side`` tells the two blocks of a meeting apart; it is -1 where a block meets itself.
    """
    dealt = rows.withColumn("_nb", F.expr(f"cast(ceil(n / {block}) as int)")).withColumn("_own", F.expr("cast(pmod(xxhash64(nid), _nb) as int)"))
    met = dealt.withColumn("_other", F.explode(F.expr("sequence(0, _nb - 1)")))
    return (met.selectExpr("slot", "key", "least(_own, _other) as a", "greatest(_own, _other) as b",
                           "if(_own = _other, -1, if(_own < _other, 0, 1)) as side", "nid", "root", "n_shingles", "sig", "bits")
            .repartition("slot", "key", "a", "b").sortWithinPartitions("slot", "key", "a", "b"))


def _candidates(percent: int):
    def run(batches):
        for table, group in _groups(batches, 4):
            nid, root, slot, size, side = (table.column(c).to_numpy() for c in ("nid", "root", "slot", "n_shingles", "side"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(nid), -1)
            for left, right in _pairs(group, side):
                fits = (root[left] != root[right]) & (100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right]))
                left, right = left[fits], right[fits]
                # sets that reach the threshold differ in at most this share of their sizes
                most = (100 - percent) * (size[left] + size[right])
                close = (100 + percent) * np.bitwise_count(bits[left] ^ bits[right]).sum(axis=1, dtype=np.int64) <= most
                left, right = left[close], right[close]
                equal = sig[left] == sig[right]
                here = (equal.sum(axis=1) >= VALUES - RADIUS) & (first_slots(equal) == slot[left])
                left, right = left[here], right[here]
                yield pa.RecordBatch.from_pydict({"u": pa.array(nid[left]), "v": pa.array(nid[right])})
    return run


def _with_sets(batches):
    for batch in batches:
        for first, part in chunks(batch.column(1).to_pylist()):
            shingles, bounds = shingle_sets(part)
            packed = bitmaps(shingles, bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(part)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64))),
                 pa.array([row.tobytes() for row in packed], pa.binary())], names=["nid", "shingles", "bits"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold, counted on the full sets.

    Pairs and sets both grow with the documents, so nothing is broadcast. Each
    side gets its sets on its own; the sides meet by pair, so that a node of
    many pairs fills no task.
    """
    left = pairs.hint("merge").join(sets.select(F.col("nid").alias("u"), F.col("shingles").alias("_a")), "u")
    right = pairs.hint("merge").join(sets.select(F.col("nid").alias("v"), F.col("shingles").alias("_b")), "v")
    common = "cast(size(array_intersect(_a, _b)) as bigint)"
    return (left.join(right, ["u", "v"]).selectExpr("u", "v", "size(_a) + size(_b) as _sum", f"{common} as _common")
            .filter(f"100 * _common >= {percent} * (_sum - _common)").select("u", "v"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept."""
    known = store.write(features(docs))
    nodes = store.write(
        known.filter("n_shingles > 0").groupBy("s0", "s1")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_crc")).alias("_least"), F.first("n_shingles").alias("n_shingles"),
             F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("nid"), "s0", "s1", F.col("_least.doc_id").alias("first_id"),
                F.col("_least.text_crc").alias("first_crc"), "n_shingles", "sig"))
    keys = bucket_keys(nodes)
    shared = keys.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = store.write(join_grouped(keys, shared, ["slot", "key"]))

    # what is needed to confirm links: one text of every node that shares a bucket
    scores = store.write(members.groupBy("nid").agg(F.sum("n").alias("score")).join(
        nodes.select("nid", "first_id", "first_crc", "n_shingles", "sig"), "nid"))
    texts = _rows(docs).withColumnsRenamed({"doc_id": "_id", "text_crc": "_crc"})
    sets = store.write(scores.hint("merge").join(texts, F.col("first_id").eqNullSafe(F.col("_id")) & (F.col("first_crc") == F.col("_crc")))
                       .select("nid", "text").dropDuplicates(["nid"]).mapInArrow(_with_sets, "nid long, shingles array<long>, bits binary"))

    # every node against the hubs of its buckets
    scored = members.join(scores.select("nid", "score"), "nid")
    hubs = scored.groupBy("slot", "key").agg(F.max(F.struct("score", (-F.col("nid")).alias("low"))).alias("_hub")).select(
        "slot", "key", (-F.col("_hub.low")).alias("v"))
    met = store.write(join_grouped(members, hubs, ["slot", "key"]).filter("nid <> v"))
    star = met.select(F.col("nid").alias("u"), "v").distinct()
    facts = scores.select("nid", "n_shingles", "sig")
    star = store.write(
        star.join(facts.toDF("u", "_nu", "_su"), "u").join(facts.toDF("v", "_nv", "_sv"), "v")
        .filter(f"100 * least(_nu, _nv) >= {percent} * greatest(_nu, _nv)")
        .filter(f"size(filter(sequence(0, {VALUES - 1}), i -> substring(_su, 2 * i + 1, 2) <> substring(_sv, 2 * i + 1, 2))) <= {RADIUS}")
        .select("u", "v"))
    links = store.write(confirmed(star, sets, percent))
    roots = components(links)

    # buckets that hold several components beside their hub, all of whose pairs are settled
    rooted = met.filter("n > 2").selectExpr("slot", "key", "nid", "n - 1 as n").join(roots.withColumnsRenamed({"u": "nid", "v": "_root"}), "nid", "left").withColumn(
        "root", F.coalesce("_root", "nid")).drop("_root")
    torn = rooted.groupBy("slot", "key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("slot", "key")
    open_ = (join_grouped(rooted, torn, ["slot", "key"]).join(facts, "nid").join(sets.select("nid", "bits"), "nid"))
    pairs = store.write(meetings(open_, block).mapInArrow(_candidates(percent), "u long, v long"))
    whole = components(roots.unionAll(store.write(confirmed(pairs, sets, percent))))

    named = nodes.select("nid", "s0", "s1", "first_id").join(whole.selectExpr("u as nid", "v as _root"), "nid", "left").withColumn(
        "_root", F.coalesce("_root", "nid"))
    least = named.groupBy("_root").agg(F.min("first_id").alias("component_id"))
    named = join_grouped(named, least, ["_root"]).select("s0", "s1", "component_id")
    found = known.filter("n_shingles > 0").join(named, ["s0", "s1"]).select("doc_id", "n_shingles", "component_id")
    alone = known.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
