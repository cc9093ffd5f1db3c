"""Whitening of embeddings from exact integer cross-products.

1. An entry c becomes x = floor(1024 * c) + ``OFFSET``. A task takes
   ``BLOCK`` rows at a time, shifts every dimension by its least value and packs
   each bit of each dimension across the rows into words. The popcount of the
   AND of two such planes, weighted by both places of the bits, adds up to the
   exact cross-products. Shifts are undone in whole numbers, so that the sums
   of all blocks and tasks are exact.
2. The driver gets sums per pair of dimensions, whatever the number of rows,
   centres them as whole numbers (n * sum(xy) - sum(x) * sum(y)) and takes the
   eigenvectors of the covariance.
3. Tasks project the centred rows.

Vectors that are null or hold a null or a non-finite entry are left out, all
others are fitted and returned, repeated rows each for itself and a null
``vec_id`` as it is. A vector shorter than the longest one counts as continued
with zeros. Entries beyond 2 ** 62 / 1024 count as that bound. Components whose
variance is 0 (all vectors equal, fewer different vectors than dimensions) have
a null value and ``explained`` 0. Ties of variance may come in any order, but
in the same for all rows. An empty table gives an empty one. Other columns
don't matter.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from acuity.llm import store

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
BLOCK = 8192
LIMB = 32
_BOUND = 1 << 62


@dataclass(frozen=True)
class Model:
    """``sums`` belong to x - OFFSET; ``components`` has one column per component, by falling ``variances``."""
    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def entries(column: pa.Array, dimensions: int = 0) -> np.ndarray:
    """x - OFFSET of every entry: one row per vector."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    width = max(dimensions, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * SCALE), -_BOUND, _BOUND).astype(np.int64)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every bit of every column of non-negative numbers, with their column and the place of the bit."""
    rows, columns = y.shape
    bits = np.array([int(m).bit_length() for m in y.max(axis=0)])
    column = np.repeat(np.arange(columns), bits)
    place = np.concatenate([np.arange(b) for b in bits]) if len(column) else np.zeros(0, np.int64)
    words = np.zeros((len(column), -(-rows // 64) * 8), np.uint8)
    for at in range(int(bits.max(initial=0))):
        here = np.flatnonzero(place == at)
        plane = ((y[:, column[here]] >> at) & 1).astype(np.uint8)
        words[here, :-(-rows // 8)] = np.packbits(plane, axis=0).T
    return words.view(np.uint64), column, place


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and cross-products (upper triangle) of a block, as Python numbers."""
    rows, columns = x.shape
    least = x.min(axis=0).astype(object)
    y = (x.astype(object) - least).astype(np.uint64) if np.abs(x).max() > 1 << 60 else (x - x.min(axis=0)).astype(np.uint64)
    words, column, place = bit_planes(y)
    starts = np.flatnonzero(np.diff(column, prepend=-1))
    exact = object if len(place) and 2 * int(place.max()) + int(rows).bit_length() > 58 else np.int64
    weight = np.array([1 << int(p) for p in place], exact)
    sums, products = np.zeros(columns, object), np.zeros((columns, columns), object)
    if len(place):
        count = np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(exact)
        sums[column[starts]] = np.add.reduceat(count * weight, starts)
        for k, first in enumerate(starts):
            total = np.zeros(len(starts) - k, exact)
            for p in range(first, starts[k + 1] if k + 1 < len(starts) else len(column)):
                both = np.bitwise_count(words[first:] & words[p]).sum(axis=1, dtype=np.int64).astype(exact)
                total += np.add.reduceat(both * weight[first:], starts[k:] - first) * weight[p]
            products[column[first], column[starts[k:]]] = total
    products += np.outer(least, sums) + np.outer(sums, least) + rows * np.outer(least, least)
    return sums + rows * least, np.triu(products)


def _limbs(value: int):
    """Parts of a whole number that can be added up as longs: all but the last are below 2 ** LIMB."""
    place = 0
    while not -(1 << LIMB) < value < 1 << LIMB:
        yield place, value & ((1 << LIMB) - 1)
        value >>= LIMB
        place += 1
    yield place, value


def _wider(total: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size,) * total.ndim, object)
    out[tuple(slice(k) for k in total.shape)] = total
    return out


def _scatter(block: int):
    """Tasks give rows (i, j, place, value): sums of x_i * x_j; j = -1 has the sums of x_i, i = -1 the count."""
    def run(batches):
        n, sums, products = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                x = entries(batch.column(0).slice(at, block))
                n += len(x)
                size = max(len(sums), x.shape[1])
                sums, products = _wider(sums, size), _wider(products, size)
                if x.shape[1]:
                    s, p = cross_products(x)
                    sums[:len(s)] += s
                    products[:len(s), :len(s)] += p
        rows = [(-1, -1, place, v) for place, v in _limbs(n)]
        for i in range(len(sums)):
            rows += [(i, -1, place, v) for place, v in _limbs(int(sums[i]))]
            rows += [(i, j, place, v) for j in range(i, len(sums)) for place, v in _limbs(int(products[i, j]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] * 3 + [pa.int64()])],
                                         names=["i", "j", "place", "value"])
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that can be fitted."""
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        "forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")


def fit(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Model | None:
    """The model of the usable vectors; None if there are none. The driver gets sums per pair of dimensions only."""
    parts = usable(vectors).select("embedding").mapInArrow(_scatter(block), "i int, j int, place int, value long")
    totals = {}
    for i, j, place, value in parts.groupBy("i", "j", "place").agg(F.sum("value")).collect():
        totals[i, j] = totals.get((i, j), 0) + (value << LIMB * place)
    n = totals.get((-1, -1), 0)
    if not n:
        return None
    size = max(i for i, _ in totals) + 1
    sums = [totals[i, -1] for i in range(size)]
    covariance = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            covariance[i, j] = covariance[j, i] = (n * totals[i, j] - sums[i] * sums[j]) / (n * n)
    variances, axes = np.linalg.eigh(covariance)
    variances, axes = variances[::-1][:components].copy(), axes[:, ::-1][:, :components].copy()
    if size:
        variances[variances <= variances.max() * size * np.finfo(float).eps] = 0
        axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    return Model(n, sums, axes, variances, float(np.trace(covariance)))


def deviations(model: Model, x: np.ndarray) -> np.ndarray:
    """n * x - sum(x), exact: longs where they and the sum of their squares surely fit."""
    sums = np.array(model.sums, object)
    most = max((max(abs(int(x.max())), abs(int(x.min()))) * model.n + max(map(abs, model.sums)) if x.size else 0), 1)
    if most ** 2 * max(1, x.shape[1]) < 1 << 62:
        return x * model.n - sums.astype(np.int64)
    return x.astype(object) * model.n - sums


def _project(model: Model):
    scale = np.sqrt(model.variances)
    axes = np.divide(model.components, scale, out=np.zeros_like(model.components), where=scale > 0)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                off = deviations(model, entries(part.column(1), len(model.sums)))
                square = (off * off).sum(axis=1)
                square = pa.array(square).cast(pa.decimal128(38, 0)) if off.dtype != object else pa.array(
                    [Decimal(v) if v < 10 ** 38 else None for v in square.tolist()], pa.decimal128(38, 0))
                white = (off / model.n).astype(float) @ axes
                missing = np.broadcast_to(scale == 0, white.shape)
                values = pa.array(white.ravel(), pa.float64(), mask=missing.ravel())
                ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), square, pa.ListArray.from_arrays(ends, values)],
                                                 names=["vec_id", "deviation", "whitened"])
    return run


def project(vectors: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation (exact; null beyond 38 digits), whitened (one value per component)."""
    rows = usable(vectors)
    return rows.mapInArrow(_project(model), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation decimal(38,0), "
                           "whitened array<double>")


def identity_error(projected: DataFrame, model: Model) -> float:
    """Largest entry of the covariance of the projected rows minus the identity, over components with a variance."""
    used = [int(k) for k in np.flatnonzero(model.variances > 0)]
    if not used:
        return 0.0
    columns = projected.select(*[F.col("whitened")[k].alias(f"w{k}") for k in used])
    means = columns.agg(*[F.avg(f"w{k}") for k in used]).first()
    centred = columns.select(*[(F.col(f"w{k}") - F.lit(m)).alias(f"w{k}") for k, m in zip(used, means)])
    pairs = [(a, b) for a in used for b in used if a <= b]
    found = centred.agg(*[F.avg(F.col(f"w{a}") * F.col(f"w{b}")) for a, b in pairs]).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, found))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components)
    schema = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {schema}")
    projected = store.write(project(vectors, model))
    share = [float(v / model.trace) if model.trace else 0.0 for v in model.variances]
    shares = F.array(*[F.lit(s) for s in share]).cast("array<double>")
    return projected.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(identity_error(projected, model)).alias("identity_error"))
