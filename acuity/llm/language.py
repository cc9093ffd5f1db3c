"""Language of a text: averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of one to four lower-case letters of a word, with a mark
on both sides of the word. Their embeddings are averaged over the whole text
and go through one linear layer. The model is trained by stochastic gradient
descent in numpy on a sample of labelled rows; a temperature and a rejection
threshold are fitted on a fifth of that sample which the descent does not see.

A text that is null or has no letter gets ``und`` with score 0 and is rejected.
Null languages and null ids are never learned from. Without labelled rows
every text is ``und``. Repeated rows get equal results; ties of scores go to
the first language in alphabetical order. An empty table gives an empty one.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from acuity.llm.words import chunks, code_points

SAMPLE_ROWS = 4_000
BUCKETS = 1 << 15
DIMENSION = 16
EPOCHS = 6
ORDERS = (1, 2, 3, 4)
ACCURACY = 0.995
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Model:
    """``weights`` is the product of the embeddings and the linear layer: one row per subword bucket."""
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _letter_codes(codes: np.ndarray) -> np.ndarray:
    """Code points with everything that is no letter set to 0."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x10000)]))
    keep = _letters[0][np.minimum(codes, 0xFFFF)]
    far = codes > 0xFFFF
    if far.any():
        keep[far] = [chr(c).isalpha() for c in codes[far]]
    return np.where(keep, codes, 0)


def subwords(texts: list[str]):
    """For each order: bucket of every subword and bounds of each text in them."""
    lowered = [t.lower() for t in texts]
    codes = _letter_codes(code_points("\n".join(["", *lowered, ""])))
    ends = np.cumsum([len(t) + 1 for t in lowered])
    for n in ORDERS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        valid = np.ones(size, bool)
        for k in range(n):
            if 0 < k < n - 1 or n == 1:
                valid &= codes[k:k + size] > 0
        if n == 2:
            valid &= (codes[:size] > 0) | (codes[1:] > 0)
        at = np.flatnonzero(valid)
        value = np.full(len(at), n, np.uint32)
        for k in range(n):
            value = (value ^ codes[at + k].astype(np.uint32)) * _FACTORS[k]
            value ^= value >> np.uint32(15)
        yield (value & np.uint32(BUCKETS - 1)).astype(np.int64), np.concatenate([[0], np.searchsorted(at, ends)])


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct subword buckets of the texts and their shares, joined, and the bounds of each text in them.

    A few large arrays in place of two small ones per text: the driver gives their memory back.
    """
    buckets, shares, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.float32)], [0]
    for _, part in chunks(texts):
        orders = list(subwords(part))
        found = [np.unique(np.concatenate([b[e[i]:e[i + 1]] for b, e in orders]), return_counts=True) for i in range(len(part))]
        buckets.append(np.concatenate([ids for ids, _ in found]).astype(np.uint16))  # below 1 << 16
        shares.append(np.concatenate([(n / max(n.sum(), 1)).astype(np.float32) for _, n in found]))
        sizes += [len(ids) for ids, _ in found]
    return np.concatenate(buckets), np.concatenate(shares), np.cumsum(sizes)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fits a model to texts with their languages."""
    languages = sorted(set(langs))
    buckets, shares, bounds = _bags(texts)
    bag = [slice(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    known = np.flatnonzero(np.diff(bounds)).tolist()
    target = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(known)
    checks, learned = order[:len(order) // 5], order[len(order) // 5:]
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    linear, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for i in rng.permutation(learned):
            ids, share = buckets[bag[i]], shares[bag[i]]
            mean = share @ embed[ids]
            z = mean @ linear + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            step = linear @ p
            linear -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            embed[ids] -= rate * share[:, None] * step
    weights = embed @ linear
    scores = np.array([shares[bag[i]] @ weights[buckets[bag[i]]] + bias for i in checks]).reshape(-1, len(languages))
    temperature, threshold = _calibrate(scores, target[checks])
    return Model(languages, weights, bias, temperature, threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _calibrate(scores: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Temperature of the least log loss; the lowest threshold whose accepted texts are accurate enough."""
    if not len(scores):
        return 1.0, 0.0
    grid = np.geomspace(0.1, 10, 41)
    rows = np.arange(len(target))
    loss = [-np.log(_softmax(scores / t)[rows, target] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(scores / temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = (p.argmax(axis=1) == target)[order]
    accurate = np.flatnonzero(np.cumsum(right) / np.arange(1, len(right) + 1) >= ACCURACY)
    if len(accurate) == 0:
        return temperature, 1.0
    last = accurate[-1]
    top = p.max(axis=1)[order]
    # with every checked text accepted, nothing speaks for a threshold above an even chance
    return temperature, float(0.5 * top[last] if last == len(top) - 1 else top[last])


def predict(model: Model, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and rejection of each text."""
    names, scores, rejected = [], [], []
    for _, part in chunks(texts):
        z = np.zeros((len(part), max(len(model.languages), 1)))
        n = np.zeros(len(part))
        for buckets, bounds in subwords(part):
            some = np.flatnonzero(np.diff(bounds))
            n += np.diff(bounds)
            if len(some) and model.languages:
                z[some] += np.add.reduceat(model.weights[buckets], bounds[some], axis=0)
        known = (n > 0) & bool(model.languages)
        p = np.zeros_like(z)
        if known.any():
            p[known] = _softmax((z[known] / n[known, None] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        top = np.where(known, p.max(axis=1), 0.0)
        names += [model.languages[b] if k else "und" for b, k in zip(best, known)]
        scores.append(top)
        rejected.append(~known | (top < model.threshold))
    return names, np.concatenate(scores or [np.zeros(0)]), np.concatenate(rejected or [np.zeros(0, bool)])


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on about ``sample_rows`` labelled rows, spread evenly over the languages by the hash of their text.

    The sample is the bound of what the driver holds; at most twice as many
    rows are fetched.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    each = sample_rows / len(counts)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))])[F.col("lang")]
    taken = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)
    found = taken.select("text", "lang").limit(2 * sample_rows).collect()
    return train([r["text"] for r in found], [r["lang"] for r in found])


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row."""
    def run(batches):
        for batch in batches:
            names, scores, rejected = predict(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()),
                                              "score": pa.array(scores, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is accepted, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~predict(model, batch.column(at).to_pylist())[2]))
    return docs.mapInArrow(run, docs.schema)
