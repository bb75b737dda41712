"""Small groups handed to a numpy function, many groups per Python task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint


def oversized(rows: DataFrame, part, limit: int, *extra) -> DataFrame | None:
    """Keys with more than `limit` rows, with `size` and the `extra` aggregates;
    None when every group is small."""
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("size"), *extra)
    big = sizes.where(F.col("size") > limit)
    return None if big.isEmpty() else checkpoint(big)


def known(values: tuple) -> tuple:
    """Key values in which every form of NULL is None, so that they compare equal."""
    return tuple(None if pd.isna(v) else v for v in values)


def _starts(pdf: pd.DataFrame, keys) -> np.ndarray:
    """Row offsets where the key changes, always including 0; NULL is one key."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for key in keys:
        column, missing = pdf[key].to_numpy(), pdf[key].isna().to_numpy()
        changed[1:] |= (column[1:] != column[:-1]) & ~(missing[1:] & missing[:-1])
    return np.flatnonzero(changed)


def map_groups(df: DataFrame, keys, sort, fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
               schema: str) -> DataFrame:
    """Apply fn to whole groups, the rows of each sorted by `sort`.

    fn gets many groups at once: a frame and the offsets that bound the groups
    in it. The groups must be known to be small; only the unfinished last group
    of a batch is kept for the next one.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            starts = _starts(batch, keys)
            if tail and known(tail[-1][keys].iloc[-1]) != known(batch[keys].iloc[0]):
                yield finish(tail)
                tail = []
            if len(starts) > 1:
                yield finish([*tail, batch.iloc[:starts[-1]]])
                tail = []
            tail.append(batch.iloc[starts[-1]:])
        if tail:
            yield finish(tail)

    def finish(frames):
        pdf = pd.concat(frames, ignore_index=True)
        return fn(pdf, np.append(_starts(pdf, keys), len(pdf)))

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *sort)
    return placed.mapInPandas(run, schema)


def each(fn: Callable[[pd.DataFrame], pd.DataFrame]):
    """Turn a function of one group into one of many."""
    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        parts = [fn(pdf.iloc[a:b].reset_index(drop=True)) for a, b in zip(bounds, bounds[1:])]
        return pd.concat(parts, ignore_index=True)
    return run


def stack(vectors) -> np.ndarray:
    """Vectors as rows of unit length; unknown or zero ones become NaN rows.

    Vectors of different length get columns of their own, so their product is 0:
    nothing is known about how similar they are.
    """
    lengths = np.array([0 if v is None else len(v) for v in vectors], dtype=int)
    sizes = [int(n) for n in np.unique(lengths) if n]
    out = np.full((len(vectors), max(sum(sizes), 1)), np.nan)
    left = 0
    for size in sizes:
        at = np.flatnonzero(lengths == size)
        rows = np.array([vectors[i] for i in at], dtype=np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        out[at] = np.where(norms > 0, 0.0, np.nan)[:, None]
        out[at, left:left + size] = rows / np.where(norms > 0, norms, np.nan)[:, None]
        left += size
    return out


def laid(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, as in `stack` but of their own length, and their lengths; unknown or
    zero ones have length NaN."""
    sizes = np.array([0 if v is None else len(v) for v in vectors], dtype=int)
    kinds = [int(n) for n in np.unique(sizes) if n]
    out, norms = np.zeros((len(vectors), max(sum(kinds), 1))), np.full(len(vectors), np.nan)
    left = 0
    for size in kinds:
        at = np.flatnonzero(sizes == size)
        rows = np.array([vectors[i] for i in at], dtype=np.float64)
        out[at, left:left + size] = rows
        norms[at] = np.sqrt((rows * rows).sum(axis=1))
        left += size
    return out, np.where(norms > 0, norms, np.nan)


def similarities(rows: np.ndarray, norms: np.ndarray, row: np.ndarray, norm: float) -> np.ndarray:
    """Cosine similarity of each of `rows` to one more, 0 where unknown. Equal vectors have
    equal ones to the last bit wherever they lie, as a matrix product doesn't grant, so that
    ties go by the order and not by the place in a batch."""
    return np.nan_to_num((rows * row).sum(axis=1) / (norms * norm), nan=0.0)
