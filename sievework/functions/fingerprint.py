"""Perceptual fingerprints of pixels; decoding of files is the caller's."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE, LOW = 32, 8


def _cosines() -> np.ndarray:
    k, x = np.meshgrid(np.arange(SIDE), np.arange(SIDE), indexing="ij")
    return 2 * np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _weights(size: int, side: int, lobes: int = 3) -> np.ndarray:
    """Lanczos weights of ``size`` pixels for each of ``side`` pixels."""
    step = size / side
    wide = max(step, 1.0)
    centre = (np.arange(side) + 0.5) * step
    x = (np.arange(size) + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def shrink(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey image as ``side`` x ``side``, by the Lanczos filter; rows first, whole grey levels after each pass, as image libraries do."""
    level = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = level(grey.astype(float) @ _weights(grey.shape[1], side).T)
    return level(_weights(grey.shape[0], side) @ across)


def perceptual_hash(grey: np.ndarray) -> str:
    """64 bits in hex: which low-frequency cosine coefficients exceed their median."""
    c = _cosines()
    low = (c @ shrink(grey) @ c.T)[:LOW, :LOW].ravel()
    bits = low > np.median(low)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def perceptual_hash_of(content: Column, decode: Callable[[bytes], np.ndarray | None]) -> Column:
    """Fingerprint of file contents; ``decode`` gives grey pixels, or None for what it can't read (then null)."""

    @F.pandas_udf("string")
    def hashes(contents: pd.Series) -> pd.Series:
        out = []
        for b in contents:
            try:
                grey = decode(bytes(b)) if b is not None else None
            except (OSError, ValueError):
                grey = None
            out.append(None if grey is None or 0 in grey.shape else perceptual_hash(grey))
        return pd.Series(out, dtype="object")

    return hashes(content)
