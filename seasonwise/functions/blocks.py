"""Distances of many points to many others with numpy, some points at a time."""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Numbers in one block of distances: it stays in the cache of a core.
BLOCK = 1 << 16
# Integers up to here are exact as doubles.
EXACT = 1 << 53
LARGEST = (1 << 63) - 1

# Tasks get this module's functions with their code, so they need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """An array column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def blocks(rows: int, width: int) -> Iterator[slice]:
    step = max(1, BLOCK // max(1, width))
    return (slice(at, at + step) for at in range(0, rows, step))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, summed dimension by dimension."""
    total = np.zeros((len(x), len(y)), x.dtype)
    gap = np.empty_like(total)
    for p, q in zip(x.T, np.ascontiguousarray(y.T)):
        np.subtract(p[:, None], q, out=gap)
        np.multiply(gap, gap, out=gap)
        total += gap
    return total


def exact_as_doubles(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether squared distances of all rows of integers are exact when summed as doubles."""
    largest = max([max(int(a.max()), -int(a.min())) for a in (x, y) if a.size], default=0)
    most = x.shape[1] * (2 * largest) ** 2
    if most > LARGEST:
        raise OverflowError("squared distances of the points do not fit into 64 bits")
    # Doubles are as exact as integers while no sum can exceed what they hold.
    return most < EXACT


def nearest_rows(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Place of the nearest of ``centres`` for every row of integers, the first one on ties."""
    out = np.empty(len(x), np.int64)
    exact = exact_as_doubles(x, centres)
    if exact:
        x, centres = x.astype(np.float64), centres.astype(np.float64)
        squares, turned = (centres * centres).sum(axis=1), -2 * centres.T
    for part in blocks(len(x), len(centres)):
        far = squares + x[part] @ turned if exact else squared(x[part], centres)
        out[part] = far.argmin(axis=1)
    return out
