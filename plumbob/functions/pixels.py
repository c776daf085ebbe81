"""Pixel metrics of one decoded image (NumPy, inside tasks)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

HASH_SIZE = 8
GRID = 4 * HASH_SIZE


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma in 0..255. Decoded pixels are rows of B, G, R (and alpha)."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[..., 0]
    b, g, r = (pixels[..., i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def sharpness(image: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, edges repeated."""
    if min(image.shape) < 3:
        return 0.0
    p = np.pad(image.astype(np.float64), 1, mode="edge")
    centre = p[1:-1, 1:-1]
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * centre).var())


@lru_cache(maxsize=512)
def _resampling(source: int, target: int) -> np.ndarray:
    """Lanczos-3 weights, one row per target pixel."""
    scale = source / target
    stretch = max(scale, 1.0)
    centre = (np.arange(target)[:, None] + 0.5) * scale
    taps = np.arange(source)[None, :]
    x = (taps + 0.5 - centre) / stretch
    reach = 3.0 * stretch
    inside = (taps >= np.floor(np.maximum(centre - reach + 0.5, 0))) & (taps < np.floor(centre + reach + 0.5))
    weights = np.where(inside & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """The first rows of the orthonormal DCT matrix."""
    u, x = np.arange(HASH_SIZE)[:, None], np.arange(GRID)[None, :]
    rows = np.cos(np.pi * (2 * x + 1) * u / (2 * GRID)) * np.sqrt(2 / GRID)
    rows[0] = np.sqrt(1 / GRID)
    return rows


def perceptual_hash(image: np.ndarray) -> str:
    """64 bits: low DCT coefficients of the 32 x 32 image above their median.

    Coefficients are rounded, so that the noise of a flat image decides nothing.
    """
    height, width = image.shape
    whole = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    small = whole(image.astype(np.float64) @ _resampling(width, GRID).T)
    small = whole(_resampling(height, GRID) @ small)
    low = np.round(_cosines() @ small @ _cosines().T, 6)
    bits = (low > np.median(low)).ravel()
    return np.packbits(bits).tobytes().hex()
