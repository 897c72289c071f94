"""Vectors as exact integers, and exact integer matrix products through float64 BLAS.

An integer is cut into limbs so narrow that a dot product of limbs stays below 2 ** 53, where float64 is exact; the
products of limbs are put together again in int64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a limb, fewer where vectors have over 8,192 components.
LIMB_BITS = 20


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and v: floor(scale * x) of each component x in double, as longs.

    Rows whose vector is null, or holds a null or a non-finite component, are dropped.
    """
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull() & fit).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def largest(rows: DataFrame) -> int:
    """The largest magnitude of a component of v."""
    top = F.array_max(F.transform("v", lambda c: F.greatest(c, -c)))
    return rows.agg(F.max(top).alias("m")).first()["m"] or 0


def check_range(most: int, d: int, times: int) -> None:
    """Fail unless ``times`` a dot product of d components up to ``most`` fits into 64 bits."""
    if times * max(1, d) * most * most >= 1 << 63:
        raise ValueError(f"components up to {most} after scaling are too large: products of {d} of them leave 64 bits")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs of int64 as float64, the lowest first; all but the last are in [0, 2 ** bits), the last has the sign."""
    out = []
    while True:
        high = x >> bits
        if len(x) == 0 or (-1 <= high.min() and high.max() <= 0):  # at most a sign is left, which stays with this limb
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = high


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of int64 matrices, exact as long as the results fit into int64."""
    out = np.zeros((len(x), len(y)), np.int64)
    d = max(1, x.shape[1] if x.ndim == 2 else 1)
    bits = min(LIMB_BITS, (53 - d.bit_length()) // 2)
    right = limbs(y, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out
