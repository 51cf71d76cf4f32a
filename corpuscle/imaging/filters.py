"""Small numpy filters used inside image tasks."""

from __future__ import annotations

import numpy as np


def gaussian_kernel(sigma: float) -> np.ndarray:
    half = max(int(4 * sigma + 0.5), 1)
    x = np.arange(-half, half + 1)
    k = np.exp(-x * x / (2 * sigma * sigma))
    return k / k.sum()


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur, mirrored at the borders."""
    kernel = gaussian_kernel(sigma)
    half = len(kernel) // 2
    for axis, n in enumerate(image.shape):
        index = np.arange(-half, n + half) % (2 * n)
        index = np.where(index >= n, 2 * n - 1 - index, index)
        padded = np.take(image, index, axis=axis)
        out = np.zeros(image.shape)
        for i, w in enumerate(kernel):
            cut = [slice(None)] * image.ndim
            cut[axis] = slice(i, i + n)
            out += w * padded[tuple(cut)]
        image = out
    return image


def extremum(image: np.ndarray, largest: bool, cross: bool = False) -> np.ndarray:
    """Largest (smallest) value in the 3-wide neighbourhood of every pixel, or along the axes only."""
    pick = np.maximum if largest else np.minimum
    out = image
    for axis in range(image.ndim):
        source = image if cross else out
        padded = np.pad(source, [(1, 1) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
        n = image.shape[axis]
        low, high = (np.take(padded, np.arange(s, s + n), axis=axis) for s in (0, 2))
        out = pick(out, pick(low, high))
    return out


def clear_border(mask: np.ndarray, margin: int) -> np.ndarray:
    if margin > 0:
        for axis, n in enumerate(mask.shape):
            lows, highs = [slice(None)] * mask.ndim, [slice(None)] * mask.ndim
            lows[axis], highs[axis] = slice(0, margin), slice(max(n - margin, 0), None)
            mask[tuple(lows)] = False
            mask[tuple(highs)] = False
    return mask


def zoom2(image: np.ndarray) -> np.ndarray:
    """Twice as many pixels along every axis, by linear interpolation."""
    for axis, n in enumerate(image.shape):
        image = np.moveaxis(image, axis, 0)
        at = np.arange(2 * n) / 2
        low = np.minimum(at.astype(int), n - 1)
        high = np.minimum(low + 1, n - 1)
        frac = (at - low).reshape([-1] + [1] * (image.ndim - 1))
        image = np.moveaxis(image[low] * (1 - frac) + image[high] * frac, 0, axis)
    return image


def refine(values: np.ndarray, at: np.ndarray, limit: float = 1.0) -> tuple[np.ndarray, float]:
    """Sub-pixel shift and value of an extremum from the quadratic through its 3-wide neighbourhood."""
    centre = tuple(at)
    ndim = values.ndim
    grad, hess = np.zeros(ndim), np.zeros((ndim, ndim))

    def value(*moves):
        index = list(centre)
        for axis, step in moves:
            index[axis] += step
        return values[tuple(index)]
    for a in range(ndim):
        up, down = value((a, 1)), value((a, -1))
        grad[a] = (up - down) / 2
        hess[a, a] = up + down - 2 * values[centre]
        for b in range(a):
            hess[a, b] = hess[b, a] = (value((a, 1), (b, 1)) + value((a, -1), (b, -1))
                                       - value((a, 1), (b, -1)) - value((a, -1), (b, 1))) / 4
    try:
        shift = -np.linalg.solve(hess, grad)
    except np.linalg.LinAlgError:
        shift = np.zeros(ndim)
    shift = np.clip(shift, -limit, limit)
    return shift, float(values[centre] + 0.5 * grad @ shift)
