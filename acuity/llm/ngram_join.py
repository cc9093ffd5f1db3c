"""N-gram Jaccard join: documents whose five-word shingle sets have a similarity of 0.8 or more.

1. Every text becomes its set of shingles, a 128-bit hash of the set and 128
   MinHash values of 16 bits. Documents with equal sets are one *node*.
2. 32 bands of four values put nodes into buckets. A pair with similarity 0.8
   shares no bucket with probability 5e-8.
3. Inside a bucket, MinHash values of a pair are compared 16 at a time. The
   posterior of the similarity after m of n equal values (uniform prior) is
   Beta(m + 1, n - m + 1); a pair whose probability of reaching the threshold
   falls below ``TOLERANCE`` is dropped; of pairs at the threshold this loses
   one in 1e8. What remains connects nodes to groups.
4. Inside a group pairs pass the same pruning, survivors are verified exactly
   on their shingle sets, and each node gets its number of links. Pairs never
   leave the task: rows are link counts per node and the edges of a spanning
   forest.

Buckets and groups above ``BLOCK`` nodes are cut into blocks, and two blocks
meet in a task of their own, so no task holds a whole large group. In a bucket
every two blocks meet. In a group only those nodes of two blocks meet that have
a surviving pair there, found in the buckets of the group once more: a long
chain of near copies, where most pairs are far apart, costs work by its close
pairs and not by the square of its length. Copies of one text never meet each
other.

Null and empty texts and texts without words have no shingles: they link to
nothing and each is a class of its own. A text of one to four words has one
shingle of all its words. Repeated rows are copies of each other. A null
``doc_id`` counts as a document; it never names a class unless all ids of the
class are null. Ties: the class is named by its smallest id. An empty table
gives an empty one.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acuity.llm import store
from acuity.llm.components import components
from acuity.llm.joins import join_grouped
from acuity.llm.words import chunks, mix, shingle_hashes, word_hashes

THRESHOLD = 0.8
TOLERANCE = 1e-9
VALUES = 128
ROWS = 4
BANDS = VALUES // ROWS
STEP = 16
BLOCK = 256
_MULTIPLIERS = mix(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)
FEATURES = "doc_id long, text_crc long, s0 long, s1 long, n_shingles int, sig binary"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of one non-empty set."""
    least = np.full(VALUES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 1024):
        part = shingles[at:at + 1024]
        for k in range(VALUES):
            least[k] = min(least[k], (part * _MULTIPLIERS[k]).min())
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def shingle_sets(texts: list) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for _, part in chunks(texts):
        shingles, bounds = shingle_hashes(*word_hashes(part)[:2])
        out += [np.unique(shingles[bounds[i]:bounds[i + 1]]) for i in range(len(part))]
    return out


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    twice = mix(s ^ np.uint64(0x5851F42D4C957F2D)), mix(s + np.uint64(0x14057B7EF767814F))
    return tuple(int(np.bitwise_xor.reduce(x).astype(np.int64)) if k else int(x.sum(dtype=np.uint64).astype(np.int64))
                 for k, x in enumerate(twice))


def _features(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("text_crc", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()),
                        ("n_shingles", pa.int32()), ("sig", pa.binary())])
    for batch in batches:
        for first, part in chunks(batch.column(2).to_pylist()):
            sets = shingle_sets(part)
            keys = [_set_hash(s) if len(s) else (0, 0) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)),
                pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary())], schema=schema)


def features(docs: DataFrame) -> DataFrame:
    """One row per document: its identity, set hash, set size and MinHash values."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.crc32(F.col("text").cast("string").cast("binary")).alias("text_crc"), F.col("text").cast("string"))
    return rows.mapInArrow(_features, FEATURES)


def needed_matches(threshold: float) -> np.ndarray:
    """Fewest equal values after each step that keep the posterior at or above the tolerance."""
    x = (np.arange(20_000) + 0.5) / 20_000
    least = []
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            density = np.exp(log - log.max())
            if density[x >= threshold].sum() / density.sum() >= TOLERANCE:
                break
        least.append(m)
    return np.array(least)


def prune(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indexes of the pairs that survive the incremental comparison."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for step, need in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (sig[left[alive], part] == sig[right[alive], part]).sum(axis=1, dtype=np.int32)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def _merge(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Gives the ends of each pair the least label of their component."""
    while True:
        low = np.minimum(label[left], label[right])
        if (label[left] == low).all() and (label[right] == low).all():
            return
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while (label[label] != label).any():
            label[:] = label[label]


def _pairs(group: np.ndarray, block: np.ndarray):
    """Pairs of rows of the same group, distance by distance.

    ``block`` is -1 where the group is one block, otherwise which of the two
    meeting blocks a row belongs to: then only rows of different blocks meet.
    """
    start = np.arange(len(group))
    distance = 1
    while len(start):
        start = start[start + distance < len(group)]
        start = start[group[start] == group[start + distance]]
        meet = start[(block[start] < 0) | (block[start] != block[start + distance])]
        for at in range(0, len(meet), 50_000):
            yield meet[at:at + 50_000], meet[at:at + 50_000] + distance
        distance += 1


def _groups(batches, n_keys: int):
    """Tables of whole groups from rows sorted by the first ``n_keys`` columns."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        changed = np.zeros(table.num_rows, bool)
        for k in range(n_keys):
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        last = np.flatnonzero(changed)
        cut = int(last[-1]) if len(last) else 0
        if cut:
            changed[0] = False
            yield table.slice(0, cut).combine_chunks(), np.cumsum(changed[:cut])
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        changed = np.zeros(rest.num_rows, bool)
        yield rest.combine_chunks(), np.cumsum(changed)


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with a count ``n`` of their group, dealt to the meetings of its blocks, sorted by group.

    Adds ``a``, ``b`` (the meeting) and ``side`` (-1: one block meets itself).
    """
    dealt = rows.withColumn("_nb", F.expr(f"cast(ceil(n / {BLOCK}) as int)")).withColumn(
        "_own", F.expr("cast(pmod(xxhash64(nid), _nb) as int)"))
    met = dealt.withColumn("_other", F.explode(F.expr("sequence(0, _nb - 1)")))
    return (met.selectExpr(*keys, "least(_own, _other) as a", "greatest(_own, _other) as b",
                           "if(_own = _other, -1, if(_own < _other, 0, 1)) as side", *[c for c in rows.columns if c not in keys])
            .drop("n").repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b"))


def _survivors(table: pa.Table, group: np.ndarray, threshold: float, least: np.ndarray, wanted=None):
    """Surviving pairs of rows of whole buckets, each in the first bucket that its nodes share.

    ``wanted(left, right)`` says which pairs are compared at all.
    """
    band, size, side = (table.column(c).to_numpy() for c in ("band", "n_shingles", "side"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
    keys = np.ascontiguousarray(sig).view(np.uint64)
    for left, right in _pairs(group, side):
        fits = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right])
        if wanted is not None:
            fits &= wanted(left, right)
        left, right = left[fits], right[fits]
        earlier = (keys[left] == keys[right]) & (np.arange(BANDS) < band[left][:, None])
        new = ~earlier.any(axis=1)
        left, right = left[new], right[new]
        kept = prune(sig, left, right, least)
        yield left[kept], right[kept]


def _candidate_edges(threshold: float):
    least = needed_matches(threshold)

    def run(batches):
        for table, group in _groups(batches, 4):
            nid = table.column("nid").to_numpy()
            label = np.arange(len(nid))
            for left, right in _survivors(table, group, threshold, least, lambda a, b: label[a] != label[b]):
                _merge(label, left, right)
            joined = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_pydict({"u": pa.array(nid[joined]), "v": pa.array(nid[label[joined]])})
    return run


def _meeting_rows(threshold: float):
    least = needed_matches(threshold)

    def run(batches):
        for table, group in _groups(batches, 4):
            nid, own = table.column("nid").to_numpy(), table.column("own").to_numpy().astype(np.int64)
            width = int(own.max()) + 1
            found = np.zeros(0, np.int64)  # row and the block it has a pair in
            for left, right in _survivors(table, group, threshold, least):
                found = np.union1d(found, np.concatenate([left * width + own[right], right * width + own[left]]))
            row, other = found // width, found % width
            yield pa.RecordBatch.from_pydict({"nid": pa.array(nid[row]), "own": pa.array(own[row].astype(np.int32)),
                                              "other": pa.array(other.astype(np.int32))})
    return run


def meetings(group: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(nid, own, other): the nodes of groups above ``BLOCK`` and the blocks in which each has a surviving pair.

    ``group`` has nid, grp, n (nodes of the group), n_shingles and sig. A node
    stands in one row for each block that it has to meet.
    """
    large = group.filter(f"n > {BLOCK}").selectExpr(
        "nid", "grp", "n_shingles", "sig", f"cast(pmod(xxhash64(nid), ceil(n / {BLOCK})) as int) as own")
    bands = large.select("nid", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(grp, substring(sig, i * {2 * ROWS} + 1, {2 * ROWS})))")).alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = join_grouped(bands, buckets, ["band", "key"]).join(large.select("nid", "n_shingles", "sig", "own"), "nid")
    return _blocks(members, ["band", "key"]).mapInArrow(_meeting_rows(threshold), "nid long, own int, other int").distinct()


def exact_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold, by exact counts of common shingles."""
    if not len(left):
        return np.zeros(0, bool)
    used = np.unique(np.concatenate([left, right]))
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    size = np.array([len(sets[i]) for i in used], np.float64)
    if len(left) * 8 < len(used) ** 2:  # few pairs: one by one
        common = np.array([len(np.intersect1d(sets[a], sets[b], True)) for a, b in zip(left, right)], np.float64)
    else:  # many pairs: products of incidence matrices, some columns at a time
        values, column = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        row = np.repeat(np.arange(len(used)), size.astype(np.int64))
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        product = np.zeros((len(used), len(used)), np.float32)
        width = 4096
        for at in range(0, len(values), width):
            a, b = np.searchsorted(column, [at, at + width])
            dense = np.zeros((len(used), min(width, len(values) - at)), np.float32)
            dense[row[a:b], column[a:b] - at] = 1
            product += dense @ dense.T
        common = product[place[left], place[right]].astype(np.float64)
    total = size[place[left]] + size[place[right]] - common
    return common >= threshold * total - 1e-9


def _verified(threshold: float):
    least = needed_matches(threshold)

    def run(batches):
        for table, all_groups in _groups(batches, 3):
            # group by group, so that the shingle sets of one meeting at a time are unpacked
            for at in np.unique(all_groups):
                rows = np.flatnonzero(all_groups == at)
                part = table.slice(rows[0], len(rows))
                nid, copies = part.column("nid").to_numpy(), part.column("copies").to_numpy()
                side = part.column("side").to_numpy()
                sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
                size = np.array([len(s) for s in sets])
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
                lefts, rights = [], []
                for left, right in _pairs(np.zeros(len(rows), int), side):
                    fits = np.minimum(size[left], size[right]) >= threshold * np.maximum(size[left], size[right])
                    left, right = left[fits], right[fits]
                    kept = prune(sig, left, right, least)
                    lefts.append(left[kept])
                    rights.append(right[kept])
                left = np.concatenate(lefts) if lefts else np.zeros(0, int)
                right = np.concatenate(rights) if rights else np.zeros(0, int)
                linked = exact_links(sets, left, right, threshold)
                left, right = left[linked], right[linked]
                label = np.arange(len(rows))
                _merge(label, left, right)
                texts = np.bincount(left, minlength=len(rows)) + np.bincount(right, minlength=len(rows))
                links = (np.bincount(left, copies[right], len(rows)) + np.bincount(right, copies[left], len(rows))).astype(np.int64)
                some = np.flatnonzero(texts)
                yield pa.RecordBatch.from_pydict({"u": pa.array(nid[some]), "v": pa.array(nid[label[some]]),
                                                  "texts": pa.array(texts[some]), "links": pa.array(links[some])})
    return run


def _with_sets(batches):
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for first, part in chunks(batch.column(at).to_pylist()):
            sets = pa.array([s.tobytes() for s in shingle_sets(part)], pa.binary())
            yield batch.slice(first, len(part)).set_column(at, "shingles", sets)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, text_crc, class_id, n_links, n_copies, n_linked_texts, first.

    ``n_links`` counts the other documents at or above the threshold, copies
    included; ``n_linked_texts`` the different shingle sets among them.
    ``class_id`` is the smallest id of the connected component and ``first``
    marks its rows with the smallest (doc_id, text_crc). With ``doc_id`` null
    in the whole class, ``class_id`` is null.
    """
    known = store.write(features(docs))
    some = known.filter("n_shingles > 0")
    # one node per shingle set; copies are counted before they are shuffled
    nodes = store.write(
        some.groupBy("s0", "s1").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_crc"))
                                     .alias("_least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("nid"), "s0", "s1", "copies",
                F.col("_least.doc_id").alias("first_id"), F.col("_least.text_crc").alias("first_crc"), "n_shingles", "sig"))
    bands = nodes.select("nid", F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(substring(sig, i * {2 * ROWS} + 1, {2 * ROWS})))")).alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = join_grouped(bands, buckets, ["band", "key"])
    edges = (_blocks(members.join(nodes.select("nid", "n_shingles", "sig"), "nid"), ["band", "key"])
             .mapInArrow(_candidate_edges(threshold), "u long, v long"))
    near = components(edges)

    group = near.select(F.col("u").alias("nid"), F.col("v").alias("grp")).unionAll(
        near.selectExpr("v as nid", "v as grp").distinct())
    sizes = group.groupBy("grp").agg(F.count("*").alias("n"))
    group = store.write(join_grouped(group, sizes, ["grp"])
                        .join(nodes.select("nid", "first_id", "first_crc", "copies", "n_shingles", "sig"), "nid"))
    # a short list for each node: at most one entry for every BLOCK nodes of its group
    met = meetings(group, threshold).groupBy("nid").agg(F.collect_list(F.expr(
        "struct(least(own, other) as a, greatest(own, other) as b, if(own = other, -1, if(own < other, 0, 1)) as side)")).alias("_met"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("_crc", F.crc32(F.col("text").cast("binary")))
    # a node needs one of its texts; rows repeated under the same id are the same text
    held = (group.join(texts, F.col("first_id").eqNullSafe(F.col("_id")) & (F.col("first_crc") == F.col("_crc")))
            .select("nid", "grp", "n", "copies", "sig", "text").dropDuplicates(["nid"]).join(met, "nid", "left")
            .withColumn("_met", F.expr(f"if(n <= {BLOCK}, array(struct(0 as a, 0 as b, -1 as side)), _met)")).drop("n")
            .mapInArrow(_with_sets, "nid long, grp long, copies long, sig binary, shingles binary, "
                                    "_met array<struct<a: int, b: int, side: int>>"))
    meeting = held.select("grp", F.inline("_met"), "nid", "copies", "sig", "shingles").repartition("grp", "a", "b")
    found = store.write(meeting.sortWithinPartitions("grp", "a", "b")
                        .mapInArrow(_verified(threshold), "u long, v long, texts long, links long"))
    links = found.groupBy("u").agg(F.sum("texts").alias("n_linked_texts"), F.sum("links").alias("_links"))
    whole = components(found.select("u", "v"))

    named = (nodes.select("nid", "s0", "s1", "copies", "first_id", "first_crc")
             .join(links.withColumnRenamed("u", "nid"), "nid", "left").join(whole.selectExpr("u as nid", "v as _root"), "nid", "left")
             .withColumn("_root", F.coalesce("_root", "nid")))
    least = named.groupBy("_root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "first_crc")).alias("_least"))
    named = join_grouped(named, least, ["_root"]).selectExpr(
        "s0", "s1", "copies", "coalesce(n_linked_texts, 0L) as n_linked_texts", "copies - 1 + coalesce(_links, 0L) as n_links",
        "_least.first_id as class_id", "_least.first_crc as class_crc")
    alone = known.filter("n_shingles = 0").selectExpr(
        "doc_id", "text_crc", "doc_id as class_id", "0L as n_links", "1L as n_copies", "0L as n_linked_texts", "true as first")
    return known.filter("n_shingles > 0").join(named, ["s0", "s1"]).selectExpr(
        "doc_id", "text_crc", "class_id", "n_links", "copies as n_copies", "n_linked_texts",
        "doc_id <=> class_id and text_crc = class_crc as first").unionAll(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are first of their class, with all their columns; one row where rows repeat.

    Rows without words stay, one for each (doc_id, text).
    """
    first = jaccard_classes(docs, threshold).filter("first")
    kept = store.write(first.groupBy(F.col("doc_id").alias("_k_id"), F.col("text_crc").alias("_k_crc"))
                       .agg(F.count("*").alias("_k_n")))
    match = [docs["doc_id"].cast("long").eqNullSafe(kept["_k_id"]),
             F.crc32(docs["text"].cast("string").cast("binary")).eqNullSafe(kept["_k_crc"])]
    once = docs.join(kept.filter("_k_n = 1"), match, "left_semi")
    if kept.filter("_k_n > 1").isEmpty():
        return once
    return once.unionAll(docs.join(kept.filter("_k_n > 1"), match, "left_semi").dropDuplicates(["doc_id", "text"]))
