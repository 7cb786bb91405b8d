"""Minimisation from low-discrepancy starts, and image registration, as numpy functions for grouped use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def radical_inverse(i: int, base: int) -> float:
    out, scale = 0.0, 1.0 / base
    while i:
        i, digit = divmod(i, base)
        out += digit * scale
        scale /= base
    return out


def halton(i: int, dimensions: int) -> np.ndarray:
    return np.array([radical_inverse(i, p) for p in _PRIMES[:dimensions]])


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    """Central differences."""
    out = np.empty(len(x))
    for k in range(len(x)):
        step = 1e-6 * max(1.0, abs(x[k]))
        a, b = x.copy(), x.copy()
        a[k] -= step
        b[k] += step
        out[k] = (f(b) - f(a)) / (2 * step)
    return out


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, rounds: int = 200, memory: int = 8) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent with backtracking."""
    x, value, g = start.astype(float), f(start), gradient(f, start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-8:
            break
        d, sums = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            sums.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(sums), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        d = -d
        slope, t = g @ d, 1.0
        if slope >= 0:
            d, slope, steps = -g, -(g @ g), []
        while t > 1e-14 and not f(x + t * d) <= value + 1e-4 * t * slope:
            t /= 2
        if t <= 1e-14:
            break
        new = x + t * d
        ng = gradient(f, new)
        if (new - x) @ (ng - g) > 1e-14:
            steps = [*steps, (new - x, ng - g)][-memory:]
        x, value, g = new, f(new), ng
    return x, float(value)


def multi_start(f: Callable[[np.ndarray], float], low: np.ndarray, high: np.ndarray, starts: int) -> tuple[np.ndarray, float]:
    """The best minimum found from Halton points between the bounds; the first of equals."""
    best = None
    for i in range(1, starts + 1):
        x, value = minimise(f, low + halton(i, len(low)) * (high - low))
        if best is None or value < best[1] - 1e-12:
            best = (x, value)
    return best


def sampled(img: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values; outside the image the nearest pixel."""
    h, w = img.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    fy, fx = y - y0, x - x0
    return img[y0, x0] * (1 - fy) * (1 - fx) + img[y0, x0 + 1] * (1 - fy) * fx + img[y0 + 1, x0] * fy * (1 - fx) + img[y0 + 1, x0 + 1] * fy * fx


def align(template: np.ndarray, img: np.ndarray, affine: bool = False, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Inverse-compositional registration: the 2 x 3 warp from template to image coordinates, and the final rms difference.

    affine=False estimates a translation only.
    """
    h, w = template.shape
    yy, xx = np.mgrid[0:h, 0:w]
    gy, gx = np.gradient(template.astype(float))
    parts = [gx, gy] if not affine else [gx * xx, gy * xx, gx * yy, gy * yy, gx, gy]
    jac = np.stack([p.reshape(-1) for p in parts], axis=1)
    solve = np.linalg.pinv(jac.T @ jac) @ jac.T
    warp = np.eye(3)
    for _ in range(rounds):
        x, y = warp[0, 0] * xx + warp[0, 1] * yy + warp[0, 2], warp[1, 0] * xx + warp[1, 1] * yy + warp[1, 2]
        d = solve @ (sampled(img.astype(float), y, x) - template).reshape(-1)
        step = np.eye(3)
        if affine:
            step[:2] += d.reshape(3, 2).T
        else:
            step[:2, 2] += d
        warp = warp @ np.linalg.inv(step)
        if np.abs(d).max() < 1e-7:
            break
    x, y = warp[0, 0] * xx + warp[0, 1] * yy + warp[0, 2], warp[1, 0] * xx + warp[1, 1] * yy + warp[1, 2]
    return warp[:2], float(np.sqrt(np.mean((sampled(img.astype(float), y, x) - template) ** 2)))


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set pixel to the nearest unset one (or the outside), by lower envelopes per axis."""
    wide = np.pad(mask > 0, 1)
    h, w = wide.shape
    big = float(h + w)
    d = np.where(wide, big, 0.0)
    for i in range(1, h):
        d[i] = np.minimum(d[i], d[i - 1] + 1)
    for i in range(h - 2, -1, -1):
        d[i] = np.minimum(d[i], d[i + 1] + 1)
    j = np.arange(w)
    out = np.sqrt(((d**2)[:, None, :] + ((j[:, None] - j[None]) ** 2)[None]).min(axis=2))
    return out[1:-1, 1:-1]


def medial_axis(mask: np.ndarray) -> np.ndarray:
    """Ridge of the distance transform: set pixels that no 4-neighbour pair along an axis rises past on both sides."""
    d = np.pad(distance_transform(mask), 1)
    c = d[1:-1, 1:-1]
    ridge = np.zeros(mask.shape, bool)
    for a, b in (((0, 1), (2, 1)), ((1, 0), (1, 2)), ((0, 0), (2, 2)), ((0, 2), (2, 0))):
        one = d[a[0] : a[0] + c.shape[0], a[1] : a[1] + c.shape[1]]
        two = d[b[0] : b[0] + c.shape[0], b[1] : b[1] + c.shape[1]]
        ridge |= (c >= one) & (c >= two) & ((c > one) | (c > two))
    return (ridge & (mask > 0)).astype(int)


def curve_corners(curve: np.ndarray, sigma: float = 2.0, factor: float = 1.5) -> list[int]:
    """Positions of corners of a closed curve: maxima of |curvature| at one scale above `factor` times their neighbours' minima."""
    n = len(curve)
    f = np.fft.fftfreq(n) * 2 * np.pi
    z = np.fft.fft(curve[:, 0] + 1j * curve[:, 1]) * np.exp(-0.5 * (sigma * f) ** 2)
    d1, d2 = np.fft.ifft(1j * f * z), np.fft.ifft(-(f**2) * z)
    k = np.abs(d1.real * d2.imag - d1.imag * d2.real) / np.maximum(np.abs(d1) ** 3, 1e-12)
    tops = np.flatnonzero((k > np.roll(k, 1)) & (k >= np.roll(k, -1)))
    out = []
    for t in tops.tolist():
        low = []
        for step in (-1, 1):
            p = t
            for _ in range(n):
                q = (p + step) % n
                if k[q] > k[p]:
                    break
                p = q
            low.append(k[p])
        if k[t] > factor * max(low) and k[t] > np.median(k):
            out.append(t)
    return out
