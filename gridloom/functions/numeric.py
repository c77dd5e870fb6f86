"""Numeric rules that decide merges, for numpy arrays and for DataFrame columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**-23, the spacing of single-precision numbers at 1.
FLOAT_EPSILON = 1.1920928955078125e-7
#: Relative tolerances of the second stage: equal candidates, and mutual distances.
TIE, MUTUAL = 1e-6, 1e-9


def is_close(a, b, rel: float):  # noqa: ANN001, ANN201
    """|a - b| within ``rel`` of either; an infinity is close to itself only, NaN to nothing."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    with np.errstate(invalid="ignore"):
        d = np.abs(b - a)
        near = (d <= np.abs(rel * b)) | (d <= np.abs(rel * a))
    return (a == b) | (near & ~np.isinf(a) & ~np.isinf(b))


def is_close_col(a: Column, b: Column, rel: float) -> Column:
    inf = F.lit(float("inf"))
    d = F.abs(b - a)
    finite = (F.abs(a) < inf) & (F.abs(b) < inf)
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (finite & ((d <= F.abs(rel * b)) | (d <= F.abs(rel * a)))))


def distance2_col(a: str, b: str, kind: str) -> Column:
    """Squared distance of two array columns, band by band, in ``bigint``, ``float`` or ``double`` throughout."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as {kind}) - cast(y as {kind})), cast(0 as {kind}), (s, d) -> cast(s + d * d as {kind}))")


def distance2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, band by band in the arrays' own precision."""
    out = np.zeros(len(a), a.dtype)
    for k in range(a.shape[1]):
        d = a[:, k] - b[:, k]
        out += d * d
    return out


def merged_centre(n1: np.ndarray, c1: np.ndarray, n2: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """(n1 c1 + n2 c2) / (n1 + n2) in the centres' precision; the sizes are added as integers first."""
    kind = c1.dtype
    total = (n1 + n2).astype(kind)[:, None]
    return (n1.astype(kind)[:, None] * c1 + n2.astype(kind)[:, None] * c2) / total


def ordered_sum32(x: np.ndarray) -> np.float32:
    """Single-precision sum from first to last."""
    return np.add.accumulate(x.astype(np.float32), dtype=np.float32)[-1] if len(x) else np.float32(0)


def pairwise_sum32(x: np.ndarray) -> np.float32:
    """Single-precision pairwise sum: halves, split at a multiple of 8, down to blocks of at most 128.

    A block keeps 8 running sums, of every eighth element, adds them as a balanced tree, and then adds what is left.
    """
    n = len(x)
    if n < 8:
        return ordered_sum32(x)
    if n > 128:
        cut = n // 2 // 8 * 8
        return np.float32(pairwise_sum32(x[:cut]) + pairwise_sum32(x[cut:]))
    whole = n // 8 * 8
    lanes = np.add.accumulate(x[:whole].reshape(-1, 8).astype(np.float32), axis=0, dtype=np.float32)[-1]
    while len(lanes) > 1:
        lanes = lanes[0::2] + lanes[1::2]
    return ordered_sum32(np.concatenate((lanes, x[whole:].astype(np.float32))))


def float_mean(total: np.float32, n: int) -> float:
    """A single-precision mean: divided in double, rounded back, widened."""
    return float(np.float32(float(total) / n))
