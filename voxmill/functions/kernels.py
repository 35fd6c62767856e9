"""Vectorised kernels on numpy batches [N, C, extents...], for what expressions can't say well."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np


def interpolate(x: np.ndarray, size: Sequence[int], mode: str, align: bool | None = None, factors=None) -> np.ndarray:
    """Resizes the extents, one axis after another; modes nearest, linear (any rank), bicubic, area."""
    if mode in ("nearest", "area") and align is not None:
        raise ValueError("align_corners goes with linear and cubic modes only")
    known = {"nearest": 0, "area": 0, "linear": 1, "bilinear": 2, "trilinear": 3, "bicubic": 2}
    if mode not in known:
        raise ValueError(f"unknown mode {mode}")
    if known[mode] and known[mode] != x.ndim - 2:
        raise ValueError(f"{mode} needs {known[mode]} spatial dimensions, not {x.ndim - 2}")
    for d, m in enumerate(size):
        f = factors[d] if factors is not None else None
        x = np.moveaxis(np.tensordot(x, axis_weights(x.shape[d + 2], m, mode, align, f), (d + 2, 1)), -1, d + 2)
    return x


def axis_weights(n: int, m: int, mode: str, align: bool | None, factor: float | None = None) -> np.ndarray:
    """Weights [m, n] of one axis."""
    w, out = np.zeros((m, n)), np.arange(m)
    step = 1 / factor if factor else n / m
    if mode == "nearest":
        w[out, np.minimum(np.floor(out * step).astype(int), n - 1)] = 1
        return w
    if mode == "area":
        for i in range(m):
            a, b = i * n // m, -(-(i + 1) * n // m)
            w[i, a:b] = 1 / (b - a)
        return w
    if align:
        src = out * ((n - 1) / (m - 1) if m > 1 else 0.0)
    else:
        src = (out + 0.5) * step - 0.5
    if mode == "bicubic":
        low = np.floor(src).astype(int)
        t, a = src - low, -0.75
        far = lambda s: ((a * s - 5 * a) * s + 8 * a) * s - 4 * a
        near = lambda s: ((a + 2) * s - (a + 3)) * s * s + 1
        for k, weight in ((-1, far(t + 1)), (0, near(t)), (1, near(1 - t)), (2, far(2 - t))):
            np.add.at(w, (out, np.clip(low + k, 0, n - 1)), weight)
        return w
    src = np.maximum(src, 0)
    low = np.minimum(np.floor(src).astype(int), n - 1)
    t = src - low
    np.add.at(w, (out, low), 1 - t)
    np.add.at(w, (out, np.minimum(low + 1, n - 1)), t)
    return w


def affine_grid(theta: np.ndarray, size: Sequence[int], align: bool) -> np.ndarray:
    """Sampling points [N, extents..., D] for matrices [N, D, D + 1]; the first coordinate is the last axis."""
    axes = []
    for n in size:
        j = np.arange(n)
        axes.append((2 * j / (n - 1) - 1 if n > 1 else np.zeros(n)) if align else (2 * j + 1) / n - 1)
    base = np.stack([*reversed(np.meshgrid(*axes, indexing="ij")), np.ones(tuple(size))], axis=-1)
    return np.einsum("nij,...j->n...i", theta, base)


def grid_sample(x: np.ndarray, grid: np.ndarray, mode: str = "bilinear", padding: str = "zeros", align: bool = False) -> np.ndarray:
    """Values of x [N, C, extents...] at the points of the grid."""
    if mode not in ("bilinear", "nearest") or padding not in ("zeros", "border", "reflection"):
        raise ValueError(f"unknown mode {mode} or padding {padding}")
    extents = x.shape[2:]
    at = []
    for d, n in enumerate(extents):
        g = grid[..., len(extents) - 1 - d]
        p = (g + 1) / 2 * (n - 1) if align else ((g + 1) * n - 1) / 2
        if padding == "reflection":
            low, span = (0.0, float(n - 1)) if align else (-0.5, float(n))
            if span == 0:
                p = np.zeros_like(p)
            else:
                q = np.abs(p - low) % (2 * span)
                p = np.minimum(q, 2 * span - q) + low
        if padding != "zeros":
            p = np.clip(p, 0, n - 1)
        at.append(p)
    rows = np.arange(len(x)).reshape((-1,) + (1,) * (grid.ndim - 2))
    channels = np.moveaxis(x, 1, -1)

    def pick(index: list[np.ndarray]) -> np.ndarray:
        inside = np.ones(index[0].shape, bool)
        for i, n in zip(index, extents):
            inside &= (i >= 0) & (i < n)
        safe = [np.clip(i, 0, n - 1) for i, n in zip(index, extents)]
        return channels[(rows, *safe)] * inside[..., None]

    if mode == "nearest":
        out = pick([np.rint(p).astype(int) for p in at])
    else:
        lows = [np.floor(p).astype(int) for p in at]
        out = 0.0
        for corner in itertools.product((0, 1), repeat=len(extents)):
            w = 1.0
            for c, p, low in zip(corner, at, lows):
                w = w * (p - low if c else 1 - (p - low))
            out = out + pick([low + c for low, c in zip(lows, corner)]) * np.asarray(w)[..., None]
    return np.moveaxis(out, -1, 1)


def pad(x: np.ndarray, amounts: Sequence[tuple[int, int]], mode: str) -> np.ndarray:
    """Pads the extents, first axis first."""
    names = {"zero": "constant", "zeros": "constant", "constant": "constant", "reflect": "reflect", "replicate": "edge", "circular": "wrap"}
    if mode not in names:
        raise ValueError(f"unknown padding mode {mode}")
    if names[mode] == "reflect" and any(max(a) >= n for a, n in zip(amounts, x.shape[2:])):
        raise ValueError("reflection needs a padding below the extent")
    return np.pad(x, [(0, 0), (0, 0), *amounts], names[mode])


def convolve(x: np.ndarray, kernel: np.ndarray, stride: Sequence[int]) -> np.ndarray:
    """Depthwise cross-correlation of [N, C, ...] with a kernel [C, 1, ...]."""
    d = x.ndim - 2
    windows = np.lib.stride_tricks.sliding_window_view(x, kernel.shape[2:], axis=tuple(range(2, 2 + d)))
    windows = windows[(slice(None), slice(None), *[slice(None, None, s) for s in stride])]
    letters = "abcdef"[:d]
    taps = "uvwxyz"[:d]
    return np.einsum(f"nc{letters}{taps},c{taps}->nc{letters}", windows, kernel[:, 0])


def gaussian_kernel(channels: int, size: Sequence[int], std: Sequence[float]) -> np.ndarray:
    """Product of Gaussians about the middle, made to sum to 1."""
    k = np.ones(tuple(size))
    for d, (n, s) in enumerate(zip(size, std)):
        g = np.exp(-(((np.arange(n) - (n - 1) / 2) / s) ** 2) / 2)
        k = k * g.reshape([-1 if i == d else 1 for i in range(len(size))])
    return np.broadcast_to(k / k.sum(), (channels, 1, *size)).copy()


def interp1d(x: np.ndarray, y: np.ndarray, new: np.ndarray, eps: float = np.finfo(float).eps) -> np.ndarray:
    """Linear interpolation on sorted x, carried on beyond both ends."""
    i = np.clip(np.searchsorted(x, new, "left") - 1, 0, len(x) - 2)
    slope = (y[i + 1] - y[i]) / (eps + (x[i + 1] - x[i]))
    return y[i] + slope * (new - x[i])


def bezier_curve(p1: Sequence[float], p2: Sequence[float], low: float = 0.0, high: float = 1.0, n: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Points of the cubic through (0, 0) and (1, 1) with two control points, x in order, scaled to the range."""
    t = np.linspace(0, 1, n)
    cx, cy = (3 * (1 - t) ** 2 * t * a + 3 * (1 - t) * t**2 * b + t**3 for a, b in zip(p1, p2))
    return np.sort(cx) * (high - low) + low, np.sort(cy) * (high - low) + low


def _below(rng: np.random.Generator, low: int, high: int) -> int:
    """low to high - 1."""
    if high <= low:
        raise ValueError("the volume is too small for this operator")
    return int(rng.integers(low, high))


def _box(rng: np.random.Generator, extents: Sequence[int], sizes: Sequence[int], margin: int) -> tuple[slice, ...]:
    at = [_below(rng, margin, e - s - margin) for e, s in zip(extents, sizes)]
    return tuple(slice(a, a + s) for a, s in zip(at, sizes))


def pixel_shuffle(x: np.ndarray, rng: np.random.Generator, n: int = -1, block: Sequence[int] = (0, 0, 0), share: float = 0.1) -> np.ndarray:
    """Permutes the voxels inside n random blocks, each of one channel, in a copy of [C, D, H, W]."""
    out, extents = x.copy(), x.shape[1:]
    for _ in range(n if n >= 0 else 1000 * x.shape[0]):
        sizes = [_below(rng, 2, int(e * share)) for e in extents] if share > 0 else list(block)
        view = out[(int(rng.integers(x.shape[0])), *_box(rng, extents, sizes, 0))]
        view[...] = rng.permutation(view.ravel()).reshape(view.shape)
    return out


def inpaint(x: np.ndarray, rng: np.random.Generator, n: int = 5, high: float = 1.0, low: float = 0.0) -> np.ndarray:
    """Fills up to n blocks, of all channels and 3 voxels off the border, with noise; each next with chance 0.95."""
    out, extents = x.copy(), x.shape[1:]
    while n > 0 and rng.random() < 0.95:
        where = (slice(None), *_box(rng, extents, [_below(rng, e // 10, max(e // 4, e // 10 + 1)) for e in extents], 3))
        out[where] = rng.uniform(low, high, out[where].shape)
        n -= 1
    return out


def outpaint(x: np.ndarray, rng: np.random.Generator, high: float = 1.0, low: float = 0.0) -> np.ndarray:
    """Noise everywhere but in a block of 5/7 to 6/7 of each extent."""
    out, extents = rng.uniform(low, high, x.shape), x.shape[1:]
    where = (slice(None), *_box(rng, extents, [_below(rng, 5 * e // 7, 6 * e // 7) for e in extents], 3))
    out[where] = x[where]
    return out


def corners(ndim: int) -> np.ndarray:
    """All corners of the unit box."""
    return np.array(list(itertools.product([0.0, 1.0], repeat=ndim)))


def moved_extents(extents: Sequence[int], matrices: np.ndarray, zero_border: bool = False) -> np.ndarray:
    """Extents that hold the moved corners of every matrix [N, D, D + 1]; from 0 on with ``zero_border``."""
    box = corners(len(extents)) * np.asarray(extents, float)
    moved = np.einsum("nij,pj->npi", np.asarray(matrices, float), np.hstack([box, np.ones((len(box), 1))]))
    low = 0.0 if zero_border else moved.min(axis=1)
    return (moved.max(axis=1) - low).max(axis=0)
