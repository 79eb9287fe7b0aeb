"""SetSketch registers: exponentially spaced, truncated minima of a set.

Register i of a set is ``K_i = clip(floor(1 - log_b(min_x E_i(x) / SCALE)), 0, 255)``
with ``E_i`` an exponential hash of element x. Registers of a union are the
elementwise maxima (so sketches merge), equal registers become likelier the more
alike two sets are (so they can be banded), and the counts of larger, smaller and
equal registers of two sets give their similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

BASE = 1.1
SCALE = 20.0
_LEVELS = 255


def parameters(m: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks of ``m`` register hashes."""
    rng = np.random.RandomState(seed)
    return rng.randint(0, 2**32, m, np.uint32) | np.uint32(1), rng.randint(0, 2**32, m, np.uint32)


def finish(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of unsigned integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def registers(elements: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Registers (sets x m, uint8) of non-empty sets laid end to end: 64-bit hashes and set starts."""
    mult, mask = parameters(m)
    x = (elements ^ (elements >> np.uint64(32))).astype(np.uint32)
    least = np.empty((m, len(starts)), np.uint32)
    for i in range(m):
        least[i] = np.minimum.reduceat((x ^ mask[i]) * mult[i], starts)
    spaced = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / SCALE
    k = np.floor(1.0 - np.log(spaced) / np.log(BASE))
    return np.ascontiguousarray(np.clip(k, 0, _LEVELS).astype(np.uint8).T)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of the sets behind ``a`` and ``b``."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE - 1.0) / BASE) / np.log(BASE)


def estimate(more: np.ndarray, fewer: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, m: int, steps: int = 100) -> np.ndarray:
    """Jaccard similarity by maximum likelihood over a grid.

    ``more`` and ``fewer`` count registers of U above and below V's; the set sizes
    are known, so the similarity is the only unknown.
    """
    out = np.empty(len(more))
    for at in range(0, len(more), 20_000):
        s = slice(at, at + 20_000)
        u = (n_u[s] / (n_u[s] + n_v[s]))[:, None]
        v = 1.0 - u
        j = np.linspace(0.0, 1.0, steps + 1)[None, :] * np.minimum(u / v, v / u)
        up, down = _p(u - v * j), _p(v - u * j)
        tiny = 1e-12
        a, b = more[s][:, None], fewer[s][:, None]
        log_l = a * np.log(up + tiny) + b * np.log(down + tiny) + (m - a - b) * np.log(np.maximum(1.0 - up - down, tiny))
        best = np.argmax(log_l, axis=1)
        out[s] = j[np.arange(len(best)), best]
    return out
