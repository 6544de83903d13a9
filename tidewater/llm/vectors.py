"""What the operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector can have a cosine: not null, no component null or not finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for the same seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def matrix(column) -> np.ndarray:
    """Rows of equal width as doubles, scaled by a power of two so that squares neither overflow nor vanish."""
    rows = np.array([np.asarray(x, np.float64) for x in column]).reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def cosines(row: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cosine of one vector with others, in double precision and the same for equal vectors."""
    return (rows * row).sum(axis=1) / (norms(rows) * np.sqrt((row * row).sum()))
