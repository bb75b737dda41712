"""Cosine distance and similarity on array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, v: acc + v)


def _cosine(a: Column, b: Column) -> Column:
    """NULL when a vector is unknown, zero, or the lengths differ."""
    norm = F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), _dot(a, b) / norm)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; an unknown vector is maximally distant, never a match."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.coalesce(1.0 - _cosine(a, b), F.lit(1.0))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine; an unknown vector has similarity 0."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.coalesce(_cosine(a, b), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def cosine_distance_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same distance in Arrow batches; faster than the expression for
    vectors of more than about a hundred dimensions."""
    out = np.ones(len(a))
    same = [x is not None and y is not None and len(x) == len(y) for x, y in zip(a, b)]
    lengths = [len(x) if ok else -1 for x, ok in zip(a, same)]
    for length in set(lengths) - {-1, 0}:
        at = np.flatnonzero(np.asarray(lengths) == length)
        left = np.stack(a.iloc[at].to_list()).astype(np.float64)
        right = np.stack(b.iloc[at].to_list()).astype(np.float64)
        dot = np.einsum("ij,ij->i", left, right)
        norm = np.sqrt(np.einsum("ij,ij->i", left, left)
                       * np.einsum("ij,ij->i", right, right))
        out[at] = np.where(norm > 0, 1.0 - dot / np.where(norm > 0, norm, 1.0), 1.0)
    return pd.Series(out)
