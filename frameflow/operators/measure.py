"""Frame measurements from decoded luminance planes, as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..params import CLIP_HIGH, CLIP_LOW, LUMA
from ..params import TILE_GRID as GRID

TILE_SCHEMA = ("tiles array<array<double>>, sharpness_max double, sharpness_mean double, "
               "clipped_hi double, clipped_lo double")


#: Pixels whose gradients are taken at once, and planes whose tiles leave together.
STACK_PIXELS, AT_ONCE = 1 << 20, 4000


def gradient_energy(pixels: np.ndarray) -> np.ndarray:
    """Squared Sobel gradient of every interior pixel of 8-bit planes; the last two axes
    are rows and columns, any axes before them hold separate planes."""
    p = pixels.astype(np.int16)
    across = p[..., 2:] - p[..., :-2]
    gx = (across[..., :-2, :] + 2 * across[..., 1:-1, :] + across[..., 2:, :]).astype(np.int32)
    down = p[..., 2:, :] - p[..., :-2, :]
    gy = (down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:]).astype(np.int32)
    return gx * gx + gy * gy


def tenengrad(pixels: np.ndarray) -> float:
    """Mean squared gradient, scaled; 0 when there is no interior."""
    if min(pixels.shape) <= 2:
        return 0.0
    return float(gradient_energy(pixels).mean()) / (4.0 * 255 * 255)


def tile_maps(planes: list[np.ndarray]) -> np.ndarray:
    """16 x 16 tile energies of planes of one size; rows and columns beyond the last
    whole tile are ignored, tiles of up to 2 pixels have no energy.

    A row of tiles of as many planes as fit STACK_PIXELS goes through one convolution, so
    neither many small planes nor one large one take more memory than that.
    """
    out = np.zeros((len(planes), GRID, GRID))
    high, wide = planes[0].shape[0] // GRID, planes[0].shape[1] // GRID
    if high <= 2 or wide <= 2:
        return out
    step = max(1, STACK_PIXELS // (high * wide * GRID))
    for first in range(0, len(planes), step):
        some = planes[first:first + step]
        for row in range(GRID):
            band = np.stack([grey(p[row * high:(row + 1) * high, :wide * GRID]) for p in some])
            energy = gradient_energy(band.reshape(len(some), high, GRID, wide).transpose(0, 2, 1, 3))
            out[first:first + step, row] = energy.sum(axis=(2, 3), dtype=np.int64)
    return out / ((high - 2) * (wide - 2)) / (4.0 * 255 * 255)


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels if pixels.ndim == 2 else luminance(pixels)


def clipped_shares(plane: np.ndarray) -> tuple[float | None, float | None]:
    """Shares of pixels that are blown out and black; unknown for an empty plane."""
    if not plane.size:
        return None, None
    high = low = 0
    rows = max(1, STACK_PIXELS // max(plane.shape[1], 1))
    for first in range(0, len(plane), rows):
        part = grey(plane[first:first + rows])
        high += int((part >= CLIP_HIGH).sum())
        low += int((part <= CLIP_LOW).sum())
    n = plane.shape[0] * plane.shape[1]
    return high / n, low / n


def luminance(rgb: np.ndarray) -> np.ndarray:
    """8-bit luma of an (h, w, 3) plane."""
    return np.clip(rgb.astype(np.float64) @ np.array(LUMA), 0, 255).astype(np.uint8)


def channel_gains(planes: DataFrame, key: str = "photo_id") -> DataFrame:
    """(key, gains): what to multiply each channel with so that all have one mean; NULL
    for planes without colour. A black channel is raised by 10,000 at most."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gains = []
            for size, pixels in zip(pdf["width"] * pdf["height"], pdf["pixels"], strict=True):
                colour = len(pixels) == 3 * size and size > 0
                level = np.frombuffer(pixels, np.uint8).reshape(-1, 3).mean(axis=0) if colour else None
                gains.append(None if level is None or not level.any() else (level.mean() / np.maximum(level, level.mean() / 1e4)).tolist())
            yield pd.DataFrame({key: pdf[key], "gains": gains})
    return measure_with(planes.select(key, "width", "height", "pixels"), run,
                        f"`{key}` {dict(planes.dtypes)[key]}, gains array<double>")


def plane_of(width: int, height: int, pixels: pa.Scalar) -> np.ndarray:
    """A plane on the batch's own bytes: rows and columns, and channels if there are three."""
    flat = np.frombuffer(pixels.as_buffer(), np.uint8)
    return flat.reshape((height, width) if len(flat) == width * height else (height, width, 3))


def measured(planes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(tiles, shares of clipped pixels: high, low; NaN where unknown) of each plane; those
    of equal size go through the convolution together."""
    tiles, clipped = np.zeros((len(planes), GRID, GRID)), np.full((len(planes), 2), np.nan)
    sizes: dict[tuple, list[int]] = {}
    for i, plane in enumerate(planes):
        sizes.setdefault(plane.shape, []).append(i)
        clipped[i] = [np.nan if x is None else x for x in clipped_shares(plane)]
    for at in sizes.values():
        tiles[at] = tile_maps([planes[i] for i in at])
    return tiles, clipped


def measure_planes(planes: list[np.ndarray]) -> list[tuple]:
    """tiles, sharpness_max, sharpness_mean, clipped_hi, clipped_lo of each plane."""
    return [(t.tolist(), float(t.max()), float(t.mean()), *(None if np.isnan(x) else float(x) for x in c))
            for t, c in zip(*measured(planes), strict=True)]


def measure_frames(planes: DataFrame, key: str = "photo_id") -> DataFrame:
    """Tiles, sharpness and clipping of planes (key, width, height, pixels).

    `pixels` holds width*height luma bytes or three times as many RGB bytes. Spark ends
    an Arrow batch at 64 MB, whatever the number of rows, and planes are read where
    they lie in it, AT_ONCE at a time, so memory follows neither the number nor the size of planes. A plane
    whose pixels, width or height are unknown has unknown measurements.
    """
    kind = planes.schema[key].dataType
    names = ["tiles", "sharpness_max", "sharpness_mean", "clipped_hi", "clipped_lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, AT_ONCE) for whole in batches for lo in range(0, len(whole), AT_ONCE)):
            width, height = (batch.column(c).to_pylist() for c in ("width", "height"))
            pixels = batch.column("pixels")
            known = [i for i in range(len(batch)) if None not in (width[i], height[i]) and pixels[i].is_valid]
            tiles, clipped = measured([plane_of(width[i], height[i], pixels[i]) for i in known])
            place = np.full(len(batch), -1)
            place[known] = np.arange(len(known))
            # rows of the measured planes, null for the others
            rows = pa.array(place, mask=place < 0)
            lists = pa.array(tiles.reshape(-1))
            for _ in range(2):
                lists = pa.ListArray.from_arrays(np.arange(0, len(lists) + 1, GRID, dtype=np.int32), lists)
            means = tiles.reshape(len(known), GRID * GRID)
            columns = [lists, pa.array(means.max(axis=1)), pa.array(means.mean(axis=1)), *(pa.array(c, mask=np.isnan(c)) for c in clipped.T)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(c.take(rows) for c in columns)], names=[key, *names])
    return planes.select(key, "width", "height", "pixels").mapInArrow(run, f"`{key}` {kind.simpleString()}, {TILE_SCHEMA}")


def measure_with(rows: DataFrame, analyzer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                 schema: str) -> DataFrame:
    """Run a user's analyzer over batches of rows; the plug point for models."""
    return rows.mapInPandas(analyzer, schema)
