"""Prefix trie of conversations: sparse-table range minima over the sorted longest common prefixes.

1. A turn becomes a 128-bit digest of (role, text) and the bytes of its text. A
   conversation c is rebuilt as the first h turns of conversation c - c % 5 and
   its own turns after its first h, h = crc32(decimal c) % 9.
2. Rebuilt conversations are cut into segments of ``SEGMENT`` turns, so that
   no row holds a whole long conversation. Segments are sorted over all tasks by
   (number of the segment, digest of all turns before it, its digests): equal
   prefixes are neighbours, and a frequent sequence may lie in several tasks.
3. In each task the longest common prefixes of neighbours give a sparse table.
   Every new prefix (row, depth) finds the left and the right end of its members
   by binary search over range minima, each for itself; counts and bytes are
   differences of running sums. The left end of the prefix that is one turn
   shorter is its parent.
4. A prefix whose members reach over the border of a task is marked as shared
   by the common prefixes at the border; the shares of its tasks are added up.
   Everything a node reports is a sum over its rows, in which each distinct turn
   counts at the first row that has it.

Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
n_leaves, saved_tokens, ends_sha256. SHA-256 can only be computed in order: the
ids of a node's ends go through one hash, as pieces of ``PIECE`` ids, never as
one value.

Turns are ordered by ``turn``, null first; ties by the digest, and repeated rows
are repeated turns. A null role or text is empty. Rows without ``conv_id``
belong to no conversation and are left out. An empty table has no node, not
even a root. Long texts are digested whole. Other columns don't matter.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from acuity.llm import store

SEGMENT = 1024
PIECE = 1000
ROWS = 100_000
TURNS = 1_000_000
DIGEST = 16
HEADS = 9
FAMILY = 5
ROOT = b"root"
NODE = ("id binary, depth long, conv_id long, parent_conv_id long, parent_id binary, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, piece_part long, piece_no long, piece string")
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SORT = ["seg", "pre", "key", "more", "conv"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), n (turns of the conversation), digest, bytes.

    Turns are dealt by range, so a long conversation is numbered by several
    tasks: places in a task plus the turns that earlier tasks have.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv", "turn", "digest"]
    placed = store.write(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", "digest", "bytes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("conv")
    runs = runs.select("conv", "part", "first", F.sum("k").over(whole).alias("n"),
                       (F.sum("k").over(whole.orderBy("part")) - F.col("k")).alias("before"))
    return store.write(placed.join(runs, ["conv", "part"]).selectExpr("conv", "at - first + before + 1 as pos", "n", "digest", "bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, total) of every conversation, and its rebuilt turns (conv, pos, digest, bytes)."""
    own = turns.filter("pos = 1").selectExpr("conv", "n", f"crc32(cast(cast(conv as string) as binary)) % {HEADS} as h", f"conv - conv % {FAMILY} as base")
    counts = own.select(F.col("conv").alias("base"), F.col("n").alias("_n"))
    convs = own.join(counts, "base", "left").selectExpr("conv", "base", "h", "least(h, coalesce(_n, 0L)) as head", "n").selectExpr(
        "*", "head + greatest(n - h, 0L) as total")
    heads = turns.filter(f"conv % {FAMILY} = 0 and pos < {HEADS}").select(F.col("conv").alias("base"), "pos", "digest", "bytes")
    first = convs.select("conv", "base", "h").join(heads, "base").filter("pos <= h").select("conv", "pos", "digest", "bytes")
    rest = turns.select("conv", "pos", "digest", "bytes").join(convs.select("conv", "h", "head"), "conv").filter("pos > h").selectExpr(
        "conv", "pos - h + head as pos", "digest", "bytes")
    return convs.select("conv", "total"), first.unionAll(rest)


def segments(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows (conv, seg, pre, key, post, more, sizes, later): up to ``segment`` turns of a conversation.

    ``pre`` and ``post`` stand for all turns before and up to the end of the
    segment, ``more`` says that the conversation goes on, ``later`` has the
    bytes of its later segments.
    """
    cut = turns.groupBy("conv", F.expr(f"cast((pos - 1) div {segment} as int)").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("_t"))
    rows = convs.join(cut, "conv", "left").selectExpr(
        "conv", "coalesce(seg, 0) as seg", "unhex(coalesce(array_join(_t.digest, ''), '')) as key", "coalesce(_t.bytes, array()) as sizes", "total")
    rows = store.write(rows.selectExpr("conv", "seg", "key", "sizes", f"(seg + 1) * {segment} < total as more", "xxhash64(seg, key) as x",
                                       "xxhash64(key, seg) as y", f"seg > 0 or total > {segment} as _long"))
    number = "unhex(concat(lpad(hex({0}), 16, '0'), lpad(hex({1}), 16, '0')))"
    up = Window.partitionBy("conv").orderBy("seg")
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    size = F.expr("aggregate(sizes, 0L, (a, b) -> a + b)")
    long = rows.filter("_long").select(
        "*", F.bit_xor("x").over(up).alias("px"), F.bit_xor("y").over(up).alias("py"), F.bit_xor("x").over(earlier).alias("ex"),
        F.bit_xor("y").over(earlier).alias("ey"), F.sum(size).over(up.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    long = long.selectExpr("conv", "seg", f"if(seg = 0, X'', {number.format('ex', 'ey')}) as pre", "key", f"{number.format('px', 'py')} as post",
                           "more", "sizes", "coalesce(_later, 0L) as later")
    short = rows.filter("not _long").selectExpr("conv", "seg", "X'' as pre", "key", f"{number.format('x', 'y')} as post", "more", "sizes", "0L as later")
    return short.unionAll(long)


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: level k has the least of every 2 ** k neighbours."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def right_ends(table: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """Last row of each prefix: binary search for the furthest row up to which all common prefixes reach the depth."""
    end = rows.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = end + (1 << k) < len(table[0])
        fits[fits] = table[k][end[fits] + 1] >= depths[fits]
        end[fits] += 1 << k
    return end


def left_ends(table: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """First row of each prefix, found the same way to the other side."""
    start = rows.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = start - (1 << k) >= 0
        fits[fits] = table[k][start[fits] - (1 << k) + 1] >= depths[fits]
        start[fits] -= 1 << k
    return start


def least_between(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    level = np.array([n.bit_length() - 1 for n in range(len(table[0]) + 1)])[last - first + 1]
    out = np.empty(len(first), table[0].dtype)
    for k in np.unique(level):
        here = level == k
        out[here] = np.minimum(table[k][first[here]], table[k][last[here] - (1 << int(k)) + 1])
    return out


class Part:
    """The sorted segments of one part, with the common prefixes at its borders."""

    def __init__(self, table: pa.Table, before: int, after: int, segment: int, piece: int):
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        self.pre, self.post, self.key = (column[c].to_pylist() for c in ("pre", "post", "key"))
        self.seg, self.conv, self.later = (column[c].to_numpy() for c in ("seg", "conv", "later"))
        self.more = column["more"].to_numpy(zero_copy_only=False)
        self.deep_bytes, self.deep_leaves = (column[c].to_numpy() for c in ("deep_bytes", "deep_leaves"))
        self.n, self.before, self.after, self.segment, self.piece = len(self.conv), before, after, segment, piece
        self.length = np.array([len(k) for k in self.key], np.int64) // DIGEST
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.running = np.concatenate([[0], np.cumsum(column["sizes"].flatten().to_numpy().astype(np.int64))])
        new = np.ones(self.n, bool)
        new[1:] = [self.seg[i] != self.seg[i - 1] or self.pre[i] != self.pre[i - 1] for i in range(1, self.n)]
        self.group = np.cumsum(new) - 1
        self.lcp = self._common_prefixes(new)
        following = np.append(self.lcp[1:], after)
        self.leaf = ~self.more & (following < self.length)
        self.new_bytes = self.bytes_between(np.arange(self.n), self.lcp, self.length)

    def bytes_between(self, rows, low, high):
        """Bytes of the turns after the first ``low`` and up to ``high`` of each row."""
        return self.running[self.offset[rows] + high] - self.running[self.offset[rows] + low]

    def _common_prefixes(self, new: np.ndarray) -> np.ndarray:
        words = np.frombuffer(b"".join(self.key), np.uint64).reshape(-1, 2)
        lcp = np.zeros(self.n, np.int64)
        lcp[0] = self.before
        shared = np.minimum(self.length[1:], self.length[:-1])
        shared[new[1:]] = 0
        rows = np.flatnonzero(shared)
        if len(rows):
            size = shared[rows]
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            place = np.arange(size.sum()) - np.repeat(first, size)
            left, right = np.repeat(self.offset[rows], size) + place, np.repeat(self.offset[rows + 1], size) + place
            differs = (words[left] != words[right]).any(axis=1)
            lcp[rows + 1] = np.minimum.reduceat(np.where(differs, place, np.repeat(size, size)), first)
        return lcp

    def own_sums(self) -> pa.RecordBatch:
        """Bytes and leaves that count at each segment behind the first: (conv, seg, bytes, leaves)."""
        at = np.flatnonzero(self.seg > 0)
        return pa.RecordBatch.from_pydict({"conv": pa.array(self.conv[at]), "seg": pa.array(self.seg[at], pa.int32()),
                                           "bytes": pa.array(self.new_bytes[at]), "leaves": pa.array(self.leaf[at].astype(np.int64))})

    def nodes(self, part: int) -> pa.Table:
        every = np.arange(self.n)
        low = self.lcp.copy()
        low[0] = 0  # the first row also stands for the prefixes that the part before shares
        size = self.length - low
        base = np.concatenate([[0], np.cumsum(size)])
        row = np.repeat(every, size)
        depth = np.arange(base[-1]) - base[row] + low[row] + 1
        new = depth > self.lcp[row]
        inner = np.append(0, self.lcp[1:])
        minima = range_minima(inner)
        last = right_ends(minima, row, depth)
        start = left_ends(minima, row, depth - 1)
        start[depth == 1] = -1
        parent = np.where(depth > 1, base[start] + depth - 2 - low[start], -1)

        def between(values, first, final):
            total = np.concatenate([[0], np.cumsum(values)])
            return total[final + 1] - total[first]
        whole = self.bytes_between(every, np.zeros(self.n, np.int64), self.length) + self.later
        members = last - row + 1
        said = between(whole, row, last) - members * self.bytes_between(row, 0 * row, depth - 1)
        known = between(self.new_bytes + self.deep_bytes, row, last)
        known[new] -= self.bytes_between(row[new], self.lcp[row[new]], depth[new] - 1)
        saved = said - known
        leaves = between(self.leaf + self.deep_leaves, row, last)
        children = np.bincount(parent[new & (parent >= 0)], minlength=len(row))
        least = range_minima(self.conv)
        conv = least_between(least, row, last) if len(row) else row
        shared = (depth == self.segment) | ((row == 0) & (depth <= self.before)) | ((last == self.n - 1) & (depth <= self.after))
        ids = {int(k): self.post[row[k]] if depth[k] == self.segment else
               hashlib.md5(self.pre[row[k]] + self.key[row[k]][:DIGEST * int(depth[k])]).digest() for k in np.flatnonzero(shared)}

        # ends: the rows that are no longer than the prefix come first among its members
        run = np.ones(self.n, bool)
        run[1:] = (self.lcp[1:] != self.length[1:]) | (self.lcp[1:] != self.length[:-1]) | (self.more[1:] != self.more[:-1]) | (self.group[1:] != self.group[:-1])
        first = np.flatnonzero(run)
        finish = np.append(first[1:], self.n)
        digest = {}
        pieces = []

        def keep_pieces(identity, a, b):
            for k in range(a, b, self.piece):
                pieces.append((identity, int(self.length[a] + self.seg[a] * self.segment), len(pieces), ",".join(map(str, self.conv[k:min(b, k + self.piece)].tolist()))))
        for a, b in zip(first.tolist(), finish.tolist()):
            if not self.more[a]:
                if self.length[a] == 0:
                    keep_pieces(ROOT, a, b)
                    continue
                k = int(base[a] + self.length[a] - 1 - low[a]) if self.length[a] > low[a] else -1
                if k in ids:
                    keep_pieces(ids[k], a, b)
                else:
                    digest[k] = hashlib.sha256(",".join(map(str, self.conv[a:b].tolist())).encode()).hexdigest()
        none = hashlib.sha256(b"").hexdigest()
        rows = {
            "id": [ids.get(k) for k in range(len(row))], "depth": depth + self.seg[row] * self.segment, "conv_id": conv,
            "parent_conv_id": [None if p < 0 or p in ids else int(conv[p]) for p in parent.tolist()],
            "parent_id": [(ROOT if self.seg[r] == 0 else self.pre[r]) if p < 0 else ids.get(p) for p, r in zip(parent.tolist(), row.tolist())],
            "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
            "ends_sha256": [None if k in ids else digest.get(k, none) for k in range(len(row))]}
        # what the part adds to the root, and to the nodes before later segments
        top = {c: [] for c in rows}
        for g in range(int(self.group[-1]) + 1):
            inside = self.group == g
            r = int(np.flatnonzero(inside)[0])
            below = int((new & (depth == 1) & inside[row]).sum())
            if self.seg[r] == 0:
                own = [ROOT, 0, int(self.conv[inside].min()), None, None, int(inside.sum()), below, int((self.leaf + self.deep_leaves)[inside].sum()),
                       int((whole - self.new_bytes - self.deep_bytes)[inside].sum()), None]
            else:
                own = [self.pre[r], int(self.seg[r]) * self.segment, None, None, None, 0, below, 0, 0, None]
            for c, v in zip(rows, own):
                top[c].append(v)
        kinds = pa.schema([("id", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_id", pa.binary()),
                           ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                           ("ends_sha256", pa.string()), ("piece_part", pa.int64()), ("piece_no", pa.int64()), ("piece", pa.string())])

        def made(values):
            count = len(values["id"])
            return pa.Table.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(count, f.type) for f in kinds], schema=kinds)
        text = {"id": [p[0] for p in pieces], "depth": [p[1] for p in pieces], "piece_part": [part] * len(pieces),
                "piece_no": [p[2] for p in pieces], "piece": [p[3] for p in pieces],
                **{c: [0] * len(pieces) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}}
        return pa.concat_tables([made(rows), made(top), made(text)])


def _parts(batches):
    """(part, table) of whole parts from rows sorted by part."""
    held, now = [], None
    for batch in batches:
        number = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                if held and number[a] != now:
                    yield int(now), pa.Table.from_batches(held)
                    held = []
                now = number[a]
                held.append(batch.slice(a, b - a))
    if held:
        yield int(now), pa.Table.from_batches(held)


def _each_part(borders: dict[int, tuple[int, int]], what: str, segment: int, piece: int):
    def run(batches):
        for part, table in _parts(batches):
            found = Part(table, *borders[part], segment, piece)
            yield from [found.own_sums()] if what == "sums" else found.nodes(part).to_batches(max_chunksize=10_000)
    return run


def _borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Common prefixes of each part with the part before and after it. The driver gets one number per part."""
    key = F.struct("seg", "pre", "key", "more", "conv")
    ends = rows.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())
    if len(parts) < 2:
        return {p: (0, 0) for p in parts}
    following = rows.sparkSession.createDataFrame(list(zip(parts[:-1], parts[1:])), "part int, next int")
    met = (following.join(ends.select("part", "high"), "part").join(ends.selectExpr("part as next", "low"), "next")
           .selectExpr("part", "high.key as a", "low.key as b", "high.seg = low.seg and high.pre = low.pre as same")
           .selectExpr("part", "a", "b", f"if(same, least(octet_length(a), octet_length(b)) div {DIGEST}, 0) as n")
           .selectExpr("part", f"""if(n = 0, 0L, coalesce(get(filter(sequence(0L, n - 1), i -> substring(a, cast({DIGEST} * i + 1 as int), {DIGEST})
               <> substring(b, cast({DIGEST} * i + 1 as int), {DIGEST})), 0), n)) as lcp"""))
    after = {r["part"]: int(r["lcp"]) for r in met.collect()}
    return {p: (after.get(q, 0), after.get(p, 0)) for p, q in zip(parts, [None, *parts[:-1]])}


def _hashed(batches):
    """(id, sha) of pieces sorted by (id, part, number): one running hash."""
    now, running = None, None
    for batch in batches:
        out = []
        for identity, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if identity == now:
                running.update(b"," + piece.encode())
            else:
                if running:
                    out.append((now, running.hexdigest()))
                now, running = identity, hashlib.sha256(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["id", "sha"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["id", "sha"])


def trie(conversations: DataFrame, segment: int = SEGMENT, piece: int = PIECE, rows_per_part: int = ROWS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    rows = store.write(segments(*rebuilt(numbered_turns(conversations)), segment))
    count, turns = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // rows_per_part + turns // TURNS + 1)
    placed = store.write(rows.repartitionByRange(n_parts, *_SORT).withColumn("part", F.spark_partition_id()))
    borders = _borders(placed)
    zero = placed.withColumns({"deep_bytes": F.lit(0).cast("long"), "deep_leaves": F.lit(0).cast("long")})
    columns = ["part", "seg", "pre", "key", "more", "conv", "post", "sizes", "later", "deep_bytes", "deep_leaves"]

    def per_part(df, what, schema):
        return df.select(*columns).repartition(n_parts, "part").sortWithinPartitions("part", *_SORT).mapInArrow(_each_part(borders, what, segment, piece), schema)
    full = zero
    if not placed.filter("seg > 0").isEmpty():  # what later segments add to the first ones of their conversation
        sums = per_part(zero, "sums", "conv long, seg int, bytes long, leaves long")
        later = Window.partitionBy("conv").orderBy(F.col("seg").desc())
        deep = store.write(sums.select("conv", (F.col("seg") - 1).alias("seg"), F.sum("bytes").over(later).alias("deep_bytes"),
                                       F.sum("leaves").over(later).alias("deep_leaves")))
        full = placed.join(deep, ["conv", "seg"], "left").withColumns(
            {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("deep_bytes", "deep_leaves")})
    found = store.write(per_part(full, "nodes", NODE))

    shares = found.filter("id is not null")
    merged = shares.groupBy("id", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("parent_id").alias("parent_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    sha = (shares.filter("piece is not null").select("id", "piece_part", "piece_no", "piece").repartition("id")
           .sortWithinPartitions("id", "piece_part", "piece_no").mapInArrow(_hashed, "id binary, sha string"))
    merged = store.write(merged.join(sha, "id", "left").select(
        "id", *OUT[:3], "parent_id", "n_convs", "n_children",
        F.expr("if(depth = 0, greatest(n_leaves, 1L), n_leaves)").alias("n_leaves"), "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    nodes = found.filter("id is null").select(*OUT, "parent_id").unionByName(merged.select(*OUT, "parent_id"))
    parents = merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("_parent"))
    return nodes.join(parents, "parent_id", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent")).select(*OUT)
