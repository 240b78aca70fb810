"""Squared Euclidean distances over 16-bit lanes, in 64-bit integers.

Column forms are unrolled sums, which stay inside generated code (higher-order
functions would be interpreted element by element).  Array forms are the same
arithmetic for bulk scans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from votegrid.plans.config import DIM


def lane(vector: Column, k: int) -> Column:
    """Widened first: differences of 16-bit values do not fit 16 bits."""
    return F.get(vector, F.lit(k)).cast("bigint")


def _total(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def l2_squared(a: Column, b: Column, lanes: range | list[int] = range(DIM)) -> Column:
    return _total([(lane(a, k) - lane(b, k)) * (lane(a, k) - lane(b, k)) for k in lanes])


def box_bound_squared(q: Column, low: Column, high: Column, dim: int = DIM) -> Column:
    """Least squared distance from a point to anything in an axis-aligned box."""
    zero = F.lit(0).cast("bigint")
    gaps = [F.greatest(lane(low, k) - lane(q, k), lane(q, k) - lane(high, k), zero) for k in range(dim)]
    return _total([g * g for g in gaps])


def l2_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two integer matrices, exact."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def l2_matrix_fast(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same in doubles: every intermediate value is an integer below 2**53, so
    results are exact, and the product runs in the linear algebra library."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
