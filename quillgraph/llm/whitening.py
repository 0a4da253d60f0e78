"""Whitening of embeddings by the exact covariance of their distinct integer vectors.

A component becomes the integer floor(256 * c).  A task takes the distinct
vectors in blocks, shifts each dimension by its least value and packs the bits
of equal weight across the rows into machine words: a bit plane.  The popcount of
two planes' AND, weighted by their bits, adds up to the exact cross-products;
shifts are taken back and blocks added as integers.  Only then the sums are
centred, still as integers, and divided for the eigenvectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut_lineage

SCALE = 256
COMPONENTS = 4
#: Vectors that stand in one set of bit planes.
BLOCK_ROWS = 1 << 14
#: Bits of one limb of an exact sum on its way to the driver.
LIMB = 32
#: A component whose eigenvalue is no more than this share of the largest one, times the dimension, has no variance.
FLAT = 1e-12


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, dim, x`` of the vectors that can take part: not null, not empty, finite components only.

    A component beyond a long becomes the nearest long.
    """
    v = F.transform(F.col(embedding), lambda c: c.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter("v is not null and size(v) > 0")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return rows.filter(~bad).select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def bit_planes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``planes, dimension, bit, least``: row ``t`` of ``planes`` holds bit ``bit[t]`` of the shifted ``dimension[t]``."""
    least = block.min(0)
    shifted = block.view(np.uint64) - least.view(np.uint64)
    widths = [int(v).bit_length() for v in shifted.max(0)]
    words = -(-len(block) // 64)
    dimension = np.repeat(np.arange(block.shape[1]), widths)
    bit = np.concatenate([np.arange(w) for w in widths]) if len(dimension) else np.zeros(0, np.int64)
    planes = np.zeros((len(dimension), words * 8), np.uint8)
    for b in range(max(widths, default=0)):
        rows = np.flatnonzero(bit == b)
        bits = (shifted[:, dimension[rows]] >> np.uint64(b)).astype(np.uint8) & np.uint8(1)
        packed = np.packbits(bits, axis=0, bitorder="little").T
        planes[rows, : packed.shape[1]] = packed
    return planes.view(np.uint64), dimension, bit, least


def cross_products(block: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of each dimension and of each product of two dimensions, as Python integers; the second upper-triangular."""
    planes, dimension, bit, least = bit_planes(block)
    n, dim = len(block), block.shape[1]
    shifts = [int(m) for m in least]
    # weights of two planes and a count of rows fit a long, else Python's integers take over
    wide = object if len(bit) and 2 * (int(bit.max()) + 1) + n.bit_length() + 1 > 62 else np.int64
    weight = np.array([1 << int(b) for b in bit], wide)
    sums = np.zeros(dim, wide)
    np.add.at(sums, dimension, np.bitwise_count(planes).sum(1, dtype=np.int64).astype(wide) * weight)
    product = np.zeros((dim, dim), wide)
    for t in range(len(planes)):
        common = np.bitwise_count(planes[t] & planes[t:]).sum(1, dtype=np.int64).astype(wide)
        # within a dimension each pair of planes stands for both orders
        common[1:] += common[1:] * (dimension[t + 1 :] == dimension[t])
        np.add.at(product[dimension[t]], dimension[t:], common * weight[t:] * weight[t])
    sums, product = sums.tolist(), product.tolist()
    total = [s + n * m for s, m in zip(sums, shifts, strict=True)]
    for i in range(dim):
        for j in range(i, dim):
            product[i][j] += shifts[i] * sums[j] + shifts[j] * sums[i] + n * shifts[i] * shifts[j]
    return total, product


def _scatter(distinct: DataFrame) -> DataFrame:
    """``dim, i, j, limb, value``: the exact totals in limbs; ``j`` of -1 is the sum of ``i``, both -1 the number of vectors."""

    def run(batches):
        found: dict[tuple[int, int, int], int] = {}
        waiting: dict[int, list[np.ndarray]] = {}

        def take(dim: int) -> None:
            block = np.concatenate(waiting.pop(dim))
            for at in range(0, len(block), BLOCK_ROWS):
                part = np.ascontiguousarray(block[at : at + BLOCK_ROWS])
                total, product = cross_products(part)
                made = [((dim, -1, -1), len(part)), *(((dim, i, -1), s) for i, s in enumerate(total))]
                made += [((dim, i, j), product[i][j]) for i in range(dim) for j in range(i, dim)]
                for key, value in made:
                    found[key] = found.get(key, 0) + value

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                waiting.setdefault(dim, []).append(_matrix(batch.column("x").filter(pa.array(dims == dim)), dim))
                if sum(map(len, waiting[dim])) >= BLOCK_ROWS:
                    take(dim)
        for dim in list(waiting):
            take(dim)
        rows = []
        for (dim, i, j), value in found.items():
            limb = 0
            while value >> LIMB not in (0, -1):
                rows.append((dim, i, j, limb, value & ((1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
            rows.append((dim, i, j, limb, value))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dim", "i", "j", "limb", "value"])

    return distinct.select("dim", "x").mapInArrow(run, "dim int, i int, j int, limb int, value bigint")


class Model:
    """The fit of one dimension: exact ``n`` and ``sums``, and the leading components of the covariance."""

    def __init__(self, dim: int, totals: dict[tuple[int, int], int], components: int):
        self.n = n = totals[-1, -1]
        self.sums = [totals[i, -1] for i in range(dim)]
        covariance = np.zeros((dim, dim))
        for i in range(dim):
            for j in range(i, dim):
                centred = n * totals[i, j] - self.sums[i] * self.sums[j]
                covariance[i, j] = covariance[j, i] = centred / (n * n)
        values, vectors = np.linalg.eigh(covariance)
        kept = min(components, dim)
        self.values, self.vectors = np.maximum(values[::-1][:kept], 0.0), vectors[:, ::-1][:, :kept]
        trace = float(np.trace(covariance))
        self.flat = self.values <= FLAT * dim * max(float(values[-1]), 0.0)
        self.explained = np.where(self.flat, 0.0, self.values / (trace or 1.0))
        self.mean = np.array([s / n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """One column per component; NaN for a component without variance."""
        length = np.where(self.flat, np.nan, np.sqrt(np.where(self.flat, 1.0, self.values)))
        return (x - self.mean) @ self.vectors / length

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of ``(n * x - S)**2``."""
        most = self.n * (int(np.abs(x.astype(object)).max(initial=0))) + max(map(abs, self.sums))
        exact = x if x.shape[1] * most * most < 1 << 63 else x.astype(object)
        gap = self.n * exact - np.array(self.sums, exact.dtype)
        return (gap * gap).sum(1).tolist()


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per dimension of the distinct vectors; the driver sees one exact total per pair of dimensions."""
    totals: dict[int, dict[tuple[int, int], int]] = {}
    for r in _scatter(distinct).groupBy("dim", "i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        own = totals.setdefault(r["dim"], {})
        own[r["i"], r["j"]] = own.get((r["i"], r["j"]), 0) + (r["value"] << LIMB * r["limb"])
    return {dim: Model(dim, own, components) for dim, own in totals.items()}


def _projected(rows: DataFrame, models: dict[int, Model], with_rows: bool) -> DataFrame:
    """Whitened values, one row per vector and component: with the vector's columns, or as ``dim, w`` for the check."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["vec_id"].dataType.simpleString() if with_rows else ""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                model, part = sent.value[dim], batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    x = _matrix(some.column("x"), dim)
                    w = model.whiten(x)
                    n, k = w.shape
                    if not with_rows:
                        yield pa.RecordBatch.from_pydict({"dim": some.column("dim"), "w": pa.array(np.nan_to_num(w).tolist(), pa.list_(pa.float64()))})
                        continue
                    values = w.ravel()
                    deviations = [d if d < 10**38 else None for d in model.deviations(x)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "vec_id": some.column("vec_id").take(pa.array(np.repeat(np.arange(n), k))),
                            "dim": pa.array(np.full(n * k, dim), pa.int32()),
                            "component": pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                            "n": pa.array(np.full(n * k, model.n), pa.int64()),
                            "deviation": pa.array([None if d is None else str(d) for d in deviations for _ in range(k)], pa.string()),
                            "whitened": pa.array(values, pa.float64(), mask=np.isnan(values)),
                            "explained": pa.array(np.tile(model.explained, n), pa.float64()),
                        }
                    )

    if not with_rows:
        return rows.mapInArrow(run, "dim int, w array<double>")
    schema = f"vec_id {kind}, dim int, component int, n bigint, deviation string, whitened double, explained double"
    return rows.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_errors(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Per dimension the largest absolute entry of the whitened vectors' covariance minus the identity, measured on them."""
    if not models:
        return {}
    most = max(len(m.values) for m in models.values())
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    made = _projected(distinct, models, with_rows=False)
    cells = [F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs]
    errors = {}
    for r in made.groupBy("dim").agg(*cells).collect():
        solid = np.flatnonzero(~models[r["dim"]].flat).tolist()
        gaps = [abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in solid and j in solid]
        errors[r["dim"]] = max(gaps, default=0.0)
    return errors


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, dim, component, n, deviation, whitened, explained, identity_error``, a row per vector and component.

    Vectors that are null, empty or hold null or non-finite entries take no
    part; ids may be null or repeat, every row is answered.  The fit is over
    each distinct integer vector once, for each length of vectors apart.  A
    component without variance (one distinct vector, or fewer independent
    dimensions than components) has a null ``whitened`` and an ``explained`` of
    zero.  ``deviation`` is exact, a decimal, null beyond 38 digits.  An empty
    table gives no rows; other columns are not read.

    The driver holds the covariance, whose size follows the dimension alone.
    """
    rows = integer_vectors(vectors, vec_id, embedding)
    distinct = cut_lineage(rows.select("dim", "x").distinct())
    models = fit(distinct, components)
    errors = identity_errors(distinct, models)
    out = _projected(rows, models, with_rows=True)
    known = F.create_map(*[F.lit(v) for pair in errors.items() for v in pair]) if errors else None
    error = known[F.col("dim")] if errors else F.lit(None).cast("double")
    return out.withColumn("identity_error", error).withColumnRenamed("vec_id", vec_id)
