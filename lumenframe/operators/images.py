"""Image algorithms that are sequential or dense by nature, as numpy on one image at a time.

per_image gathers an image's pixels in one task (an image is bounded, the table of images is not) and runs a
function of 2-D arrays (rows are y).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def to_array(pdf: pd.DataFrame, value: str) -> np.ndarray:
    """The pixels as an array over their bounding box; absent ones are 0."""
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1))
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[value].to_numpy()
    return out


def per_image(df: DataFrame, f: Callable[..., dict[str, np.ndarray]], values: list[str], out: dict[str, str]) -> DataFrame:
    """Rasters in, rasters out: f(array, ...) gives a dict of arrays of the same size; out has their SQL types."""
    schema = "image_id long, x int, y int, " + ", ".join(f"{n} {t}" for n, t in out.items())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        made = f(*[to_array(pdf, v) for v in values])
        return pd.DataFrame({"image_id": pdf["image_id"], "x": x, "y": y, **{n: np.asarray(made[n])[y, x] for n in out}})

    return df.select("image_id", "x", "y", *values).groupBy("image_id").applyInPandas(run, schema)


def per_image_rows(df: DataFrame, f: Callable[..., list[tuple]], values: list[str], out: str) -> DataFrame:
    """Rasters in, rows out: f(array, ...) gives tuples of the columns of `out`."""
    names = [c.split()[0] for c in out.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = f(*[to_array(pdf, v) for v in values])
        return pd.DataFrame([(int(pdf["image_id"].iloc[0]), *r) for r in rows], columns=["image_id", *names])

    return df.select("image_id", "x", "y", *values).groupBy("image_id").applyInPandas(run, "image_id long, " + out)


# Frequency domain --------------------------------------------------------------------------------------------


def frequency_grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Radius and the two frequencies of the unshifted transform."""
    u, v = np.meshgrid(np.fft.fftfreq(w), np.fft.fftfreq(h))
    return np.sqrt(u * u + v * v), u, v


def butterworth(h: int, w: int, cutoff: float, order: int) -> np.ndarray:
    return 1 / (1 + (frequency_grid(h, w)[0] / cutoff) ** (2 * order))


def low_pass(img: np.ndarray, cutoff: float = 0.2, order: int = 3) -> np.ndarray:
    return np.fft.ifft2(np.fft.fft2(img) * butterworth(*img.shape, cutoff, order)).real


def periodic_and_smooth(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The image as a periodic part, whose transform has no cross of edge jumps, and a smooth part."""
    h, w = img.shape
    jump = np.zeros_like(img, dtype=float)
    jump[0] += img[0] - img[-1]
    jump[-1] += img[-1] - img[0]
    jump[:, 0] += img[:, 0] - img[:, -1]
    jump[:, -1] += img[:, -1] - img[:, 0]
    c, r = np.meshgrid(2 * np.pi * np.arange(w) / w, 2 * np.pi * np.arange(h) / h)
    d = 2 * (2 - np.cos(c) - np.cos(r))
    d[0, 0] = 1
    spectrum = np.fft.fft2(jump) / d
    spectrum[0, 0] = 0
    smooth = np.fft.ifft2(spectrum).real
    return img - smooth, smooth


def phase_congruency(img: np.ndarray, scales: int = 4, shortest: float = 3, factor: float = 2.1, sigma: float = 0.55, k: float = 3, cut: float = 0.5, gain: float = 10) -> dict[str, np.ndarray]:
    """Monogenic phase congruency with log-Gabor scales: strength, orientation (0..180) and phase."""
    h, w = img.shape
    radius, u, v = frequency_grid(h, w)
    radius[0, 0] = 1
    riesz = (1j * u - v) / radius
    spectrum = np.fft.fft2(periodic_and_smooth(img)[0])
    edge = butterworth(h, w, 0.45, 15)
    total_even = np.zeros((h, w))
    total_x, total_y, total_a, most = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w))
    noise = 0.0
    for s in range(scales):
        center = 1 / (shortest * factor**s)
        gabor = np.exp(-(np.log(radius / center) ** 2) / (2 * np.log(sigma) ** 2)) * edge
        gabor[0, 0] = 0
        even = np.fft.ifft2(spectrum * gabor).real
        odd = np.fft.ifft2(spectrum * gabor * riesz)
        amplitude = np.sqrt(even**2 + odd.real**2 + odd.imag**2)
        total_even += even
        total_x += odd.real
        total_y += odd.imag
        total_a += amplitude
        most = np.maximum(most, amplitude)
        if s == 0:
            noise = float(np.median(amplitude)) / np.sqrt(np.log(4))
    width = (total_a / (most + 1e-4) - 1) / max(scales - 1, 1)
    weight = 1 / (1 + np.exp(gain * (cut - width)))
    tau = noise * (1 - (1 / factor) ** scales) / (1 - 1 / factor)
    threshold = tau * np.sqrt(np.pi / 2) + k * tau * np.sqrt((4 - np.pi) / 2)
    energy = np.sqrt(total_even**2 + total_x**2 + total_y**2)
    strength = weight * np.maximum(1 - np.arccos(np.clip(energy / (total_a + 1e-4), -1, 1)), 0) * np.maximum(energy - threshold, 0) / (energy + 1e-4)
    orientation = np.degrees(np.arctan2(-total_y, total_x)) % 180
    return {"strength": strength, "orientation": orientation, "phase": np.arctan2(total_even, np.sqrt(total_x**2 + total_y**2))}


# Filters -----------------------------------------------------------------------------------------------------


def reflected(img: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    half = len(kernel) // 2
    pad = [(half, half) if a == axis else (0, 0) for a in (0, 1)]
    wide = np.pad(img.astype(float), pad, mode="symmetric")
    n = img.shape[axis]
    return sum(k * np.take(wide, range(i, i + n), axis) for i, k in enumerate(kernel))


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    from lumenframe.operators.filters import gaussian

    k = np.array(gaussian(sigma))
    return reflected(reflected(img, k, 1), k, 0)


def median_filtered(img: np.ndarray, half: int) -> np.ndarray:
    """Upper median over the window, clipped at the edges."""
    h, w = img.shape
    out = np.empty((h, w))
    for y in range(h):
        for x in range(w):
            part = np.sort(img[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1], axis=None)
            out[y, x] = part[len(part) // 2]
    return out


def multiscale_median(img: np.ndarray, levels: int) -> list[np.ndarray]:
    """Coefficient planes and the last smooth plane; they add up to the image."""
    planes, now, s = [], img.astype(float), 1
    for _ in range(levels):
        smooth = median_filtered(now, s)
        planes.append(now - smooth)
        now, s = smooth, 2 * s
    return [*planes, now]


def bilinear(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Resized by bilinear interpolation between pixel centers, clamped at the edges."""
    y = np.clip((np.arange(h) + 0.5) * img.shape[0] / h - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * img.shape[1] / w - 0.5, 0, img.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def pyramid(img: np.ndarray, factor: float = 2.0, smallest: int = 8) -> list[np.ndarray]:
    """The image and its smoothed reductions, largest first."""
    out = [img.astype(float)]
    while min(out[-1].shape) / factor >= smallest:
        h, w = (int(n / factor) for n in out[-1].shape)
        out.append(bilinear(blurred(out[-1], 0.5 * factor), h, w))
    return out


# Edges -------------------------------------------------------------------------------------------------------


def gradient(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gy, gx = np.gradient(img.astype(float))
    return gx, gy


def thinned_maxima(strength: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Strength where it isn't below both neighbours along the gradient (interpolated), else 0."""
    h, w = strength.shape
    wide = np.pad(strength, 1)
    norm = np.maximum(np.abs(gx), np.abs(gy))
    norm[norm == 0] = 1
    yy, xx = np.mgrid[0:h, 0:w]

    def at(y, x):
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fy, fx = y - y0, x - x0
        get = lambda a, b: wide[np.clip(a + 1, 0, h + 1), np.clip(b + 1, 0, w + 1)]
        return get(y0, x0) * (1 - fy) * (1 - fx) + get(y0, x0 + 1) * (1 - fy) * fx + get(y0 + 1, x0) * fy * (1 - fx) + get(y0 + 1, x0 + 1) * fy * fx

    dy, dx = gy / norm, gx / norm
    return np.where((strength >= at(yy + dy, xx + dx)) & (strength >= at(yy - dy, xx - dx)), strength, 0)


def otsu_level(values: np.ndarray, bins: int = 256) -> float:
    """The first threshold between the classes <= t and > t with the largest variance between them."""
    counts, edges = np.histogram(values, bins)
    w0, total = np.cumsum(counts), counts.sum()
    centers = (edges[:-1] + edges[1:]) / 2
    s0 = np.cumsum(counts * centers)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.nan_to_num((s0[-1] * w0 / total - s0) ** 2 / (w0 * (total - w0)))
    return float(edges[between.argmax() + 1])


def canny(img: np.ndarray, sigma: float = 0.71, factor: float = 0.75) -> np.ndarray:
    """Edges (1): smoothed gradient, thinned; strong pixels are kept, and weak ones (half of it) next to a strong one."""
    gx, gy = gradient(blurred(img, sigma))
    strength = np.hypot(gx, gy)
    peaks = thinned_maxima(strength, gx, gy)
    high = factor * otsu_level(strength)
    strong = peaks >= max(high, 1e-9)
    near = np.pad(strong, 1)
    around = np.any([near[1 + dy : near.shape[0] - 1 + dy, 1 + dx : near.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    return (strong | ((peaks > high / 2) & around)).astype(int)


def zhang_suen(binary: np.ndarray) -> np.ndarray:
    """Thinning to one pixel, two sub-iterations until nothing changes."""
    img = np.pad(binary > 0, 1).astype(np.uint8)
    while True:
        changed = False
        for first in (True, False):
            p = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            n = sum(q.astype(int) for q in p)
            turns = sum(((p[k] == 0) & (p[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            a, b = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if first else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
            gone = (img[1:-1, 1:-1] == 1) & (n >= 2) & (n <= 6) & (turns == 1) & (a == 0) & (b == 0)
            if gone.any():
                img[1:-1, 1:-1][gone] = 0
                changed = True
        if not changed:
            return img[1:-1, 1:-1].astype(int)


def without_spurs(binary: np.ndarray) -> np.ndarray:
    """End pixels with one neighbour next to a junction go."""
    img = np.pad(binary > 0, 1).astype(int)
    n = sum(np.roll(img, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx) * img
    junction = (n >= 3).astype(int)
    near = sum(np.roll(junction, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    img[(n == 1) & (near > 0)] = 0
    return img[1:-1, 1:-1]


# Regions -----------------------------------------------------------------------------------------------------


def components(values: np.ndarray, eight: bool = False) -> np.ndarray:
    """Label of each pixel: the smallest row-major index of its component of equal values."""
    h, w = values.shape
    label = np.arange(h * w).reshape(h, w)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    links = []
    for dy, dx in steps:
        a = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        b = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        same = values[a] == values[b]
        links.append((label[a][same], label[b][same]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    root = np.arange(h * w)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = np.minimum(new, new[new])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root.reshape(h, w)
        root = new


def watershed(img: np.ndarray) -> np.ndarray:
    """Basins of a surface flooded level by level from its minima; ties join the basin reached first (row-major); 1, 2, ..."""
    import heapq

    h, w = img.shape
    flat = components(img)
    label, count, heap, order = np.zeros((h, w), int), 0, [], 0
    lower = np.zeros((h, w), bool)
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        wide = np.pad(img.astype(float), 1, constant_values=np.inf)
        lower |= wide[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] < img
    has_lower = np.zeros(h * w, bool)
    np.logical_or.at(has_lower, flat.reshape(-1), lower.reshape(-1))
    number: dict[int, int] = {}
    for y in range(h):
        for x in range(w):
            f = int(flat[y, x])
            if not has_lower[f]:
                number.setdefault(f, len(number) + 1)
                label[y, x] = number[f]
                heapq.heappush(heap, (img[y, x], order, y, x))
                order += 1
    while heap:
        level, _, y, x = heapq.heappop(heap)
        for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            p, q = y + dy, x + dx
            if 0 <= p < h and 0 <= q < w and not label[p, q]:
                label[p, q] = label[y, x]
                heapq.heappush(heap, (max(level, img[p, q]), order, p, q))
                order += 1
    return label


def slic(channels: list[np.ndarray], k: int, compactness: float = 10, rounds: int = 10) -> np.ndarray:
    """Super-pixels: seeds on a grid moved to the lowest gradient of 3 x 3, then local k-means in colour and place."""
    img = np.stack(channels, axis=2).astype(float)
    h, w, _ = img.shape
    step = max(1, int(np.sqrt(h * w / k)))
    slope = sum(np.hypot(*gradient(c)) for c in channels)
    seeds = []
    for y in range(step // 2, h, step):
        for x in range(step // 2, w, step):
            near = [(slope[p, q], p, q) for p in range(max(0, y - 1), min(h, y + 2)) for q in range(max(0, x - 1), min(w, x + 2))]
            _, p, q = min(near)
            seeds.append([*img[p, q], p, q])
    seeds = np.array(seeds, float)
    yy, xx = np.mgrid[0:h, 0:w]
    for _ in range(rounds):
        best, label = np.full((h, w), np.inf), np.zeros((h, w), int)
        for s, (c0, c1, c2, y, x) in enumerate(seeds):
            a, b = slice(max(0, int(y) - step), int(y) + step + 1), slice(max(0, int(x) - step), int(x) + step + 1)
            d = ((img[a, b] - (c0, c1, c2)) ** 2).sum(axis=2) + ((yy[a, b] - y) ** 2 + (xx[a, b] - x) ** 2) * (compactness / step) ** 2
            closer = d < best[a, b]
            best[a, b][closer] = d[closer]
            label[a, b][closer] = s
        full = np.concatenate([img, yy[..., None], xx[..., None]], axis=2).reshape(-1, 5)
        n = np.bincount(label.reshape(-1), minlength=len(seeds))
        new = np.stack([np.bincount(label.reshape(-1), full[:, j], len(seeds)) for j in range(5)], axis=1)
        moved = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], seeds)
        if np.allclose(moved, seeds):
            break
        seeds = moved
    return label


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """Clockwise (x, y) boundary of the first region of a mask by Moore tracing; it ends when the first step comes again."""
    wide = np.pad(mask > 0, 1)
    inside = np.argwhere(wide)
    if not len(inside):
        return []
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # (y, x), clockwise from the west
    start = (int(inside[0][0]), int(inside[0][1]))
    at, back, out, second = start, 0, [], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            p = (at[0] + around[d][0], at[1] + around[d][1])
            if wide[p]:
                prior = around[(d - 1) % 8]
                break
        else:
            return [(start[1] - 1, start[0] - 1)]
        if at == start:
            if p == second:
                return out
            second = second or p
        out.append((at[1] - 1, at[0] - 1))
        back = around.index((at[0] + prior[0] - p[0], at[1] + prior[1] - p[1]))
        at = p


def stable_regions(img: np.ndarray, delta: int = 2, smallest: float = 1e-3, largest: float = 0.5, variation: float = 0.5) -> list[tuple]:
    """Extremal regions (dark on light) whose area changes least: (level, area, variation, cx, cy, m20, m11, m02).

    Pixels join by rising value in a union-find forest; each region is a component at its level.
    """
    h, w = img.shape
    order = np.argsort(img, axis=None, kind="stable")
    flat = img.reshape(-1)
    parent, area = np.full(h * w, -1), np.zeros(h * w, int)
    sums = np.zeros((h * w, 5))
    history: dict[int, list] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = 0
    while at < len(order):
        level = flat[order[at]]
        touched = set()
        while at < len(order) and flat[order[at]] == level:
            p = int(order[at])
            y, x = divmod(p, w)
            parent[p], area[p] = p, 1
            sums[p] = (x, y, x * x, x * y, y * y)
            for q in (p - w if y else -1, p - 1 if x else -1, p + 1 if x + 1 < w else -1, p + w if y + 1 < h else -1):
                if q >= 0 and parent[q] >= 0:
                    a, b = find(p), find(q)
                    if a != b:
                        if area[a] < area[b]:
                            a, b = b, a
                        parent[b] = a
                        area[a] += area[b]
                        sums[a] += sums[b]
            touched.add(find(p))
            at += 1
        for r in {find(t) for t in touched}:
            history.setdefault(r, []).append((float(level), int(area[r]), *sums[r].tolist()))
    out = []
    for steps in history.values():
        levels = [s[0] for s in steps]
        var = []
        for k, s in enumerate(steps):
            j = k
            while j + 1 < len(steps) and levels[j + 1] <= s[0] + delta:
                j += 1
            var.append((steps[j][1] - s[1]) / s[1])
        for k, s in enumerate(steps):
            lowest = all(var[k] <= var[j] for j in (k - 1, k + 1) if 0 <= j < len(steps))
            if smallest * h * w <= s[1] <= largest * h * w and var[k] <= variation and lowest:
                n = s[1]
                cx, cy = s[2] / n, s[3] / n
                out.append((s[0], n, float(var[k]), cx, cy, s[4] / n - cx * cx, s[5] / n - cx * cy, s[6] / n - cy * cy))
    return sorted(out)


def ellipse(m20: float, m11: float, m02: float) -> tuple[float, float, float]:
    """Half axes and direction (degrees) of the ellipse with these central moments."""
    mean, half = (m20 + m02) / 2, np.sqrt(((m20 - m02) / 2) ** 2 + m11**2)
    return 2 * np.sqrt(mean + half), 2 * np.sqrt(max(mean - half, 0)), float(np.degrees(0.5 * np.arctan2(2 * m11, m20 - m02)))


def normalized_cut(weights: np.ndarray, limit: float = 0.1, smallest: int = 5) -> np.ndarray:
    """Class of each node of a weighted graph: split by the second eigenvector while the cut's cost is below the limit."""
    label = np.zeros(len(weights), int)
    stack, count = [np.arange(len(weights))], 0
    while stack:
        nodes = stack.pop()
        w = weights[np.ix_(nodes, nodes)]
        d = w.sum(axis=1)
        best = None
        if len(nodes) >= smallest and (d > 0).all():
            scale = 1 / np.sqrt(d)
            _, vectors = np.linalg.eigh(np.eye(len(w)) - scale[:, None] * w * scale)
            second = vectors[:, 1] * scale
            for t in np.linspace(second.min(), second.max(), 12)[1:-1]:
                a = second > t
                if a.any() and not a.all():
                    cut = w[a][:, ~a].sum()
                    cost = cut / d[a].sum() + cut / d[~a].sum()
                    if best is None or cost < best[0]:
                        best = (cost, a)
        if best and best[0] < limit:
            stack += [nodes[best[1]], nodes[~best[1]]]
        else:
            label[nodes] = count
            count += 1
    return label


# Features ----------------------------------------------------------------------------------------------------

# The circle of 16 pixels at radius 3 (x, y), clockwise.
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]


def fast_corners(img: np.ndarray, n: int = 9, threshold: float = 0.08) -> np.ndarray:
    """Response where n circle pixels in a row are all brighter or all darker by the threshold (of the value range)."""
    t = threshold * max(float(np.ptp(img)), 1e-9)
    h, w = img.shape
    out = np.zeros((h, w))
    if min(h, w) < 7:
        return out
    c = img[3:-3, 3:-3].astype(float)
    ring = np.stack([img[3 + dy : h - 3 + dy, 3 + dx : w - 3 + dx] - c for dx, dy in CIRCLE])
    for side in (ring > t, ring < -t):
        twice = np.concatenate([side, side[: n - 1]])
        hit = np.any([twice[k : k + n].all(axis=0) for k in range(16)], axis=0)
        out[3:-3, 3:-3] = np.maximum(out[3:-3, 3:-3], np.where(hit, (np.abs(ring) * side).sum(axis=0), 0))
    return out


def pattern(n: int = 256, reach: int = 13, seed: int = 7) -> np.ndarray:
    """Sampling pairs (x1, y1, x2, y2) of binary descriptors, by rule."""
    rng = np.random.default_rng(seed)
    return np.clip(np.rint(rng.normal(0, reach / 2.5, (n, 4))), -reach, reach).astype(int)


def binary_descriptors(img: np.ndarray, most: int = 40, bits: int = 256) -> list[tuple]:
    """Oriented keypoints (x, y, response, angle) and their bits as four signed 64-bit words."""
    response = fast_corners(img)
    smooth = blurred(img, 2.0)
    h, w = img.shape
    pairs = pattern(bits)
    points = [(float(response[y, x]), int(y), int(x)) for y, x in zip(*np.nonzero(response), strict=True)]
    points = [p for p in points if p[0] == response[max(0, p[1] - 1) : p[1] + 2, max(0, p[2] - 1) : p[2] + 2].max()]
    out = []
    for r, y, x in sorted(points, key=lambda p: (-p[0], p[1], p[2]))[:most]:
        a, b = slice(max(0, y - 7), y + 8), slice(max(0, x - 7), x + 8)
        yy, xx = np.mgrid[a.start : min(h, a.stop), b.start : min(w, b.stop)]
        angle = float(np.arctan2((img[a, b] * (yy - y)).sum(), (img[a, b] * (xx - x)).sum()))
        c, s = np.cos(angle), np.sin(angle)
        get = lambda px, py: smooth[np.clip(np.rint(y + s * px + c * py).astype(int), 0, h - 1), np.clip(np.rint(x + c * px - s * py).astype(int), 0, w - 1)]  # noqa: E731,B023
        code = get(pairs[:, 0], pairs[:, 1]) < get(pairs[:, 2], pairs[:, 3])
        words = np.packbits(code).view(">i8")
        out.append((x, y, r, float(np.degrees(angle)), *[int(v) for v in words]))
    return out


def oriented_histograms(img: np.ndarray, cell: int = 4, bins: int = 9) -> list[tuple]:
    """Per cell of pixels, gradient magnitude by orientation (0..180): (cx, cy, bin, weight)."""
    gx, gy = gradient(img)
    size, angle = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    which = np.minimum((angle * bins / 180).astype(int), bins - 1)
    out = []
    for cy in range(0, img.shape[0], cell):
        for cx in range(0, img.shape[1], cell):
            a, b = slice(cy, cy + cell), slice(cx, cx + cell)
            hist = np.bincount(which[a, b].reshape(-1), size[a, b].reshape(-1), bins)
            out += [(cx // cell, cy // cell, k, float(v)) for k, v in enumerate(hist)]
    return out


def multilevel_thresholds(img: np.ndarray, levels: int) -> np.ndarray:
    """Otsu thresholds found one after another: each time the class with the largest spread is split."""
    cuts: list[float] = []
    values = img.reshape(-1)
    for _ in range(levels - 1):
        edges = [-np.inf, *sorted(cuts), np.inf]
        parts = [values[(values > a) & (values <= b)] for a, b in zip(edges, edges[1:], strict=False)]
        worst = max(parts, key=lambda p: p.var() * len(p) if len(p) else -1)
        if len(np.unique(worst)) < 2:
            break
        cuts.append(otsu_level(worst))
    return np.array(sorted(cuts))


def horn_schunck(a: np.ndarray, b: np.ndarray, alpha: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Dense flow u, v from image a to b."""
    a, b = a.astype(float), b.astype(float)
    gy, gx = np.gradient((a + b) / 2)
    gt = b - a
    u, v = np.zeros_like(a), np.zeros_like(a)
    mean = lambda f: sum(np.roll(np.pad(f, 1, mode="edge"), s, ax)[1:-1, 1:-1] for s, ax in ((1, 0), (-1, 0), (1, 1), (-1, 1))) / 4
    for _ in range(rounds):
        mu, mv = mean(u), mean(v)
        t = (gx * mu + gy * mv + gt) / (alpha**2 + gx**2 + gy**2)
        u, v = mu - gx * t, mv - gy * t
    return u, v


def lucas_kanade(a: np.ndarray, b: np.ndarray, patch: int = 7) -> list[tuple]:
    """Flow (x, y, u, v) of patches by least squares; patches without texture are left out."""
    gy, gx = np.gradient(a.astype(float))
    gt = b.astype(float) - a
    out = []
    for y in range(0, a.shape[0] - patch + 1, patch):
        for x in range(0, a.shape[1] - patch + 1, patch):
            s = (slice(y, y + patch), slice(x, x + patch))
            m = np.array([[(gx[s] ** 2).sum(), (gx[s] * gy[s]).sum()], [(gx[s] * gy[s]).sum(), (gy[s] ** 2).sum()]])
            if np.linalg.eigvalsh(m)[0] > 1e-6:
                u, v = np.linalg.solve(m, -np.array([(gx[s] * gt[s]).sum(), (gy[s] * gt[s]).sum()]))
                out.append((x + patch // 2, y + patch // 2, float(u), float(v)))
    return out
