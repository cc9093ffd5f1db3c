"""SentencePiece encoding and decoding by suffix-array matching.

A text is cut where no piece can cross: before a run of spaces and around
other white space. The distinct cuts of a batch are joined into one array of
characters and encoded together:

1. *Index.* A suffix array orders all positions by their next characters, as
   far as the longest piece reaches.
2. *Match.* Binary search finds the range of suffixes that start with each piece of
   the vocabulary; every range is a set of edges (position, piece).
3. *Relax.* Edges are sorted by the position they end at. Going through the
   positions, the one edge is kept whose piece can stand after the last piece of
   the shorter prefix. That is the byte-pair encoding of the prefix, because a
   sequence of pieces is the encoding of a text if and only if each piece
   encodes itself and each two neighbours encode to themselves.

Two neighbours encode to themselves if no merge across their border comes
first. This is seen by undoing their merges from the last to the first
(``_stands``).

Characters that are no piece become their UTF-8 bytes. The vocabulary is read
from a model file whose path is a parameter; nothing is trained.

A null text gives null tokens, an empty text none. Decoding gives the exact
text back, but for U+2581 (the model's own mark for a space), which becomes a
space, and lone surrogates. Repeated rows give equal tokens. An empty table
gives an empty one.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
BATCH = 400_000
CACHE = 600_000
NEVER = np.int64(1) << 60
_loaded: dict[str, "Encoder"] = {}


class Vocabulary:
    """Pieces of a byte-pair model with their merges."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("a  ﬁ") not in (SPACE + "a" + 2 * SPACE + "ﬁ",):
            raise ValueError("only models that keep their text as it is and put a space before it are supported")
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # an ASCII byte is a character of its own
        self.shown = [chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else self.text[i] for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.plain = np.array(plain)
        self.id_of = {self.text[i]: i for i in plain}
        scores = sorted({-model.get_score(i) for i in plain})
        rank = {s: k for k, s in enumerate(scores)}
        n = len(self.text)
        self.rank = np.full(n, NEVER)
        for i in plain:
            self.rank[i] = rank[-model.get_score(i)]
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.time = np.full(n, -1, np.int64)
        self.whole = np.zeros(n, bool)
        for i in sorted(plain, key=lambda i: len(self.text[i])):
            self._build(i)
        pairs = {}
        for i in plain:
            p = self.text[i]
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.rank[i]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([*[pairs[k] for k in self.pair_keys.tolist()], NEVER], np.int64)
        self.pair_seen = np.zeros(1 << 22, bool)
        self.pair_seen[self._slot(self.pair_keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) >> 20) & ((1 << 22) - 1)

    def _build(self, i: int) -> None:
        """Merges that make piece ``i`` out of its characters: the last one and its time."""
        parts = list(self.text[i])
        if len(parts) == 1:
            self.whole[i] = True
            return
        while len(parts) > 1:
            found = [(self.rank[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.id_of]
            if not found:
                return
            _, k = min(found)
            if len(parts) == 2:
                a, b = self.id_of.get(parts[0]), self.id_of.get(parts[1])
                if a is None or b is None:
                    return
                self.left[i], self.right[i], self.whole[i] = a, b, True
                self.time[i] = max(self.rank[i], self.time[a], self.time[b])
                return
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbouring pieces merge into."""
        keys = a * len(self.text) + b
        out = np.full(len(keys), NEVER)
        maybe = np.flatnonzero(self.pair_seen[self._slot(keys)])
        at = np.searchsorted(self.pair_keys, keys[maybe])
        at[at == len(self.pair_keys)] = 0
        real = self.pair_keys[at] == keys[maybe]
        out[maybe[real]] = self.pair_ranks[at[real]]
        return out

    def stands(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can follow piece a: no merge across their border comes before a merge inside them."""
        good = np.ones(len(a), bool)
        active = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        while len(active):
            bad = self.pair_rank(a, b) < limit
            good[active[bad]] = False
            ta, tb = self.time[a], self.time[b]
            more = ~bad & ((ta >= 0) | (tb >= 0))
            active, a, b, ta, tb = active[more], a[more], b[more], ta[more], tb[more]
            undo = ta > tb  # of merges at the same time the left one comes first
            limit = np.where(undo, ta, tb + 1)
            a = np.where(undo, self.right[a], a)
            b = np.where(undo, b, self.left[b])
        return good


class Encoder:
    """Encodes texts; keeps the tokens of up to ``CACHE`` distinct cuts."""

    def __init__(self, path: str):
        v = self.vocabulary = Vocabulary(path)
        letters = sorted({c for i in v.plain for c in v.text[i]})
        self.code = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(letters, 1):
            self.code[ord(c)] = k
        crossing = {c for i in v.plain if len(v.text[i]) > 1 for c in v.text[i]}
        self.cuts = re.compile(f"{SPACE}*[^{SPACE}\\s]+|{SPACE}+" + (r"|\s+" if any(c.isspace() for c in crossing) else r"|\s"))
        self.ids = v.plain[v.whole[v.plain]]
        self.lengths = np.zeros(len(v.text) + 1, np.int64)
        for i in v.plain:
            self.lengths[i] = len(v.text[i])
        self.lengths[-1] = 1
        self.words = -(-int(self.lengths.max()) // 4)
        width = 4 * self.words
        low = np.zeros((len(self.ids), width), np.uint64)
        high = np.full((len(self.ids), width), 0xFFFF, np.uint64)
        for r, i in enumerate(self.ids):
            codes = self.code[[ord(c) for c in v.text[i]]]
            low[r, :len(codes)] = high[r, :len(codes)] = codes
        self.low, self.high = (self._packed(x) for x in (low, high))
        self.clear()

    def _packed(self, codes: np.ndarray) -> list[np.ndarray]:
        shift = np.array([48, 32, 16, 0], np.uint64)
        return [np.bitwise_or.reduce(codes[:, 4 * k:4 * k + 4] << shift, axis=1) for k in range(self.words)]

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """Binary search of all rows at once: first sorted suffix not below (or, ``after``, above) each wanted one."""
        low = np.zeros(len(wanted[0]), np.int64)
        high = np.full(len(wanted[0]), len(keys[0]), np.int64)
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high) // 2, 0)
            less, same = np.zeros(len(low), bool), np.ones(len(low), bool)
            for k, w in zip(keys, wanted):
                x = k[middle]
                less |= same & (x < w)
                same &= x == w
            right = open_ & (less | same if after else less)
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence of a piece."""
        padded = np.concatenate([codes, np.zeros(4 * self.words + 4, np.uint16)]).astype(np.uint64)
        n = len(codes) + 4 * self.words
        four = padded[:n] << np.uint64(48) | padded[1:n + 1] << np.uint64(32) | padded[2:n + 2] << np.uint64(16) | padded[3:n + 3]
        keys = [four[4 * k:4 * k + len(codes)] for k in range(self.words)]
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        first, end = self._search(keys, self.low, False), self._search(keys, self.high, True)
        n = end - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return suffixes[at], np.repeat(self.ids, n)

    def encode_cuts(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all cuts, one after the other, and where each cut's tokens end."""
        v = self.vocabulary
        joined = "\0".join([*cuts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        sizes = np.array([len(c) for c in cuts])
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes[starts + sizes] = 0
        position, piece = self.edges(codes)
        inside = np.ones(len(codes), bool)
        inside[starts + sizes] = False
        odd = np.flatnonzero((codes == 0) & inside)  # characters that are no piece
        position, piece = np.concatenate([position, odd]), np.concatenate([piece, np.full(len(odd), -1)])
        end = position + self.lengths[piece]
        step = end - np.repeat(starts, sizes + 1)[position]
        longest = np.int64(4 * self.words)
        order = np.argsort((step * np.int64(len(codes) + 1) + end) * (longest + 1) + longest - self.lengths[piece])
        position, piece, end, step = position[order], piece[order], end[order], step[order]
        fresh = np.ones(len(end), bool)
        fresh[1:] = (end[1:] != end[:-1])
        nth = np.arange(len(end)) - np.maximum.accumulate(np.where(fresh, np.arange(len(end)), 0))
        last = np.full(len(codes) + 1, -3)  # -3: not reached, -2: start of a cut, -1: no piece
        last[starts] = -2
        bounds = np.searchsorted(step, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            rank = nth[a:b]
            for k in range(int(rank.max(initial=-1)) + 1):
                mine = a + np.flatnonzero(rank == k)
                mine = mine[last[end[mine]] == -3]
                before = last[position[mine]]
                mine, before = mine[before > -3], before[before > -3]
                good = (before < 0) | (piece[mine] < 0)
                ask = np.flatnonzero(~good)
                if len(ask):
                    good[ask] = v.stands(before[ask], piece[mine[ask]])
                last[end[mine[good]]] = piece[mine[good]]
        on_path = np.zeros(len(codes) + 1, bool)
        at, start = (starts + sizes)[sizes > 0], starts[sizes > 0]
        while len(at):
            on_path[at] = True
            at = at - self.lengths[last[at]]
            start, at = start[at > start], at[at > start]
        ends = np.flatnonzero(on_path)
        tokens = last[ends].astype(np.int64)
        cut = np.searchsorted(starts, ends - 1, "right") - 1
        if (tokens < 0).any():
            raw = [[v.bytes[b] for b in chr(points[e - 1]).encode("utf-8", "replace")] if t < 0 else [t]
                   for t, e in zip(tokens.tolist(), ends.tolist())]
            cut = np.repeat(cut, [len(x) for x in raw])
            tokens = np.array([t for x in raw for t in x], np.int64)
        return tokens.astype(np.int32), np.searchsorted(cut, np.arange(len(cuts)), "right")

    def _learn(self, cuts: list[str], batch_chars: int) -> None:
        flat, ends = [self.flat], [self.ends]
        at = 0
        while at < len(cuts):
            part, size = [], 0
            while at < len(cuts) and (not part or size + len(cuts[at]) < batch_chars):
                part.append(cuts[at])
                size += len(cuts[at]) + 1
                at += 1
            tokens, stops = self.encode_cuts(part)
            ends.append(stops + sum(map(len, flat)))
            flat.append(tokens)
        self.flat, self.ends = np.concatenate(flat), np.concatenate(ends)

    def encode(self, texts: list, cache: int = CACHE, batch_chars: int = BATCH) -> list:
        """Token ids of each text, None for null."""
        parts = [None if t is None else self.cuts.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > cache:
            self.clear()
        known = self.known
        new = list(set().union(*filter(None, parts)).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._learn(new, batch_chars)
        out = []
        for p in parts:
            if not p:
                out.append(None if p is None else np.zeros(0, np.int32))
                continue
            at = np.fromiter(map(known.__getitem__, p), np.int64, len(p))
            first, n = self.ends[at], self.ends[at + 1] - self.ends[at]
            out.append(self.flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])
        return out


def encoder(path: str = MODEL) -> Encoder:
    """The encoder of a model file; read once per process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def decode(tokens, vocabulary: Vocabulary) -> str | None:
    """Text of token ids; runs of byte tokens are read as UTF-8."""
    if tokens is None:
        return None
    text, byte_of = vocabulary.shown, vocabulary.byte_of
    joined = "".join(map(text.__getitem__, tokens))
    if "<0x" in joined:
        out, raw = [], bytearray()
        for t in tokens:
            if t in byte_of:
                raw.append(byte_of[t])
            else:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(text[t])
        joined = "".join([*out, raw.decode("utf-8", "replace")])
    joined = joined.replace(SPACE, " ")
    return joined[1:] if joined.startswith(" ") else joined


def _slices(texts: list, size: int = 2_000_000):
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t or "") > size:
            yield first, i
            first, total = i, 0
        total += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, path: str = MODEL, check: bool = False, cache: int = CACHE, batch_chars: int = BATCH) -> DataFrame:
    """doc_id, tokens, n_tokens of every row; with ``check`` also round_trip: decoding gives the text back.

    ``cache`` bounds the distinct cuts that a worker remembers from one batch to
    the next, ``batch_chars`` the characters of new cuts that share a suffix
    array; they change time and memory only.
    """
    def run(batches):
        e = encoder(path)
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            for a, b in _slices(all_texts):
                texts = all_texts[a:b]
                tokens = e.encode(texts, cache, batch_chars)
                columns = {"doc_id": batch.column(0).slice(a, b - a), "tokens": pa.array(tokens, pa.list_(pa.int32())),
                           "n_tokens": pa.array([None if t is None else len(t) for t in tokens], pa.int32())}
                if check:
                    columns["round_trip"] = pa.array(
                        [None if t is None else decode(k.tolist(), e.vocabulary) == t for t, k in zip(texts, tokens)], pa.bool_())
                yield pa.RecordBatch.from_pydict(columns)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tokens array<int>, n_tokens int" + ", round_trip boolean" * check)


def decode_tokens(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of every row of (doc_id, tokens)."""
    def run(batches):
        v = encoder(path).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(
                [decode(t, v) for t in batch.column(1).to_pylist()], pa.string())})
    return tokens.select("doc_id", "tokens").mapInArrow(
        run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
