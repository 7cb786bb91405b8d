"""Rotations, cameras, epipolar geometry and robust fits as numpy functions of small dense matrices.

They run inside grouped functions (one group: one pair of images, one scene); points are columns or (n, 2) rows as said.
"""

from __future__ import annotations

import math

import numpy as np

# Rotations ---------------------------------------------------------------------------------------------------


def roll(a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array([[1, 0, 0], [0, c, -s], [0, s, c]])


def pitch(a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array([[c, 0, s], [0, 1, 0], [-s, 0, c]])


def yaw(a: float) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    return np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])


def rotation_zyx(x: float, y: float, z: float) -> np.ndarray:
    return yaw(z) @ pitch(y) @ roll(x)


def rotation_xyz(x: float, y: float, z: float) -> np.ndarray:
    return roll(x) @ pitch(y) @ yaw(z)


def angles_zyx(r: np.ndarray) -> tuple[float, float, float]:
    return math.atan2(r[2, 1], r[2, 2]), math.atan2(-r[2, 0], math.hypot(r[2, 1], r[2, 2])), math.atan2(r[1, 0], r[0, 0])


def angles_xyz(r: np.ndarray) -> tuple[float, float, float]:
    return math.atan2(-r[1, 2], r[2, 2]), math.atan2(r[0, 2], math.hypot(r[0, 0], r[0, 1])), math.atan2(-r[0, 1], r[0, 0])


def skew(v: np.ndarray) -> np.ndarray:
    return np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])


def rodrigues(v: np.ndarray) -> np.ndarray:
    """Rotation about v by its length."""
    angle = float(np.linalg.norm(v))
    if angle < 1e-12:
        return np.eye(3) + skew(v)
    k = skew(np.asarray(v) / angle)
    return np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k


def rotation_vector(r: np.ndarray) -> np.ndarray:
    angle = math.acos(min(1.0, max(-1.0, (np.trace(r) - 1) / 2)))
    if angle < 1e-9:
        return np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) / 2
    if math.pi - angle < 1e-6:  # the axis is the column of R + I with the largest diagonal
        m = (r + np.eye(3)) / 2
        k = int(np.argmax(np.diag(m)))
        return angle * m[:, k] / np.linalg.norm(m[:, k])
    return angle / (2 * math.sin(angle)) * np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])


def orthonormal(m: np.ndarray) -> np.ndarray:
    """The nearest rotation."""
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def cayley(v: np.ndarray) -> np.ndarray:
    """Rotation from skew parameters: (I - S)^-1 (I + S)."""
    s = skew(v)
    return np.linalg.solve(np.eye(3) - s, np.eye(3) + s)


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation R that best takes the columns of a to those of b."""
    u, _, vt = np.linalg.svd(b @ a.T)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest rotation from direction a to direction b."""
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    c = float(a @ b)
    if c < -1 + 1e-12:
        axis = np.cross(a, np.eye(3)[int(np.argmin(np.abs(a)))])
        return rodrigues(math.pi * axis / np.linalg.norm(axis))
    k = skew(np.cross(a, b))
    return np.eye(3) + k + k @ k / (1 + c)


def quaternion(v: np.ndarray) -> np.ndarray:
    """Unit quaternion (scalar first) of a rotation vector."""
    angle = float(np.linalg.norm(v))
    axis = np.asarray(v) / angle if angle else np.zeros(3)
    return np.array([math.cos(angle / 2), *(math.sin(angle / 2) * axis)])


def multiply(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.array([p[0] * q[0] - p[1:] @ q[1:], *(p[0] * q[1:] + q[0] * p[1:] + np.cross(p[1:], q[1:]))])


def conjugate(q: np.ndarray) -> np.ndarray:
    return np.array([q[0], *-q[1:]])


def scalar_last(q: np.ndarray) -> np.ndarray:
    return np.roll(q, -1)


def scalar_first(q: np.ndarray) -> np.ndarray:
    return np.roll(q, 1)


def quaternion_rotation(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    return multiply(multiply(q, np.array([0, *v])), conjugate(q))[1:]


def slerp(p: np.ndarray, q: np.ndarray, share: float) -> np.ndarray:
    c = float(p @ q)
    q, c = (-q, -c) if c < 0 else (q, c)
    angle = math.acos(min(1.0, c))
    if angle < 1e-9:
        return p
    return (math.sin((1 - share) * angle) * p + math.sin(share * angle) * q) / math.sin(angle)


def geodesic(p: np.ndarray, q: np.ndarray) -> float:
    """Angle of the rotation between two unit quaternions."""
    return 2 * math.acos(min(1.0, abs(float(p @ q))))


def angular_rate_matrix(x: float, y: float, z: float) -> np.ndarray:
    """Angular velocity from the rates of the x, y, z angles of rotation_xyz."""
    cy, sy, cz, sz = math.cos(y), math.sin(y), math.cos(z), math.sin(z)
    return np.array([[cy * cz, sz, 0], [-cy * sz, cz, 0], [sy, 0, 1]])


# Cameras -----------------------------------------------------------------------------------------------------


def intrinsic(f: float, cx: float, cy: float, aspect: float = 1.0, skewness: float = 0.0) -> np.ndarray:
    return np.array([[f, skewness, cx], [0, f * aspect, cy], [0, 0, 1.0]])


def camera(k: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return k @ np.column_stack([r, t])


def project(k: np.ndarray, r: np.ndarray, t: np.ndarray, world: np.ndarray, radial: tuple[float, float] = (0, 0)) -> np.ndarray:
    """(n, 2) pixels of (n, 3) world points, with radial distortion."""
    c = world @ r.T + t
    xy = c[:, :2] / c[:, 2:]
    r2 = (xy**2).sum(axis=1, keepdims=True)
    xy = xy * (1 + radial[0] * r2 + radial[1] * r2 * r2)
    return (np.column_stack([xy, np.ones(len(xy))]) @ k.T)[:, :2]


def to_camera(k: np.ndarray, pixels: np.ndarray, radial: tuple[float, float] = (0, 0), rounds: int = 30) -> np.ndarray:
    """(n, 2) normalised coordinates without distortion, by fixed-point rounds."""
    d = (np.column_stack([pixels, np.ones(len(pixels))]) @ np.linalg.inv(k).T)[:, :2]
    out = d.copy()
    for _ in range(rounds):
        r2 = (out**2).sum(axis=1, keepdims=True)
        out = d / (1 + radial[0] * r2 + radial[1] * r2 * r2)
    return out


def null_vector(a: np.ndarray, block: int = 4096) -> np.ndarray:
    """The unit vector x with the least |a x|: the triangle of a by blocks of rows, then the triangle's last singular vector.

    A full decomposition of all rows at once would have a square matrix of as many rows and columns as a has rows.
    """
    r = np.zeros((0, a.shape[1]))
    for k in range(0, len(a), block):
        r = np.linalg.qr(np.concatenate([r, a[k : k + block]]), mode="r")
    return np.linalg.svd(r)[2][-1]


def interleaved(rows: list[list[np.ndarray]]) -> np.ndarray:
    """The equations of n points as a matrix, a point's next to each other; each entry of `rows` is an array of n."""
    return np.array(rows).transpose(2, 0, 1).reshape(-1, len(rows[0]))


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """H with b ~ H a from (n, 2) points, n >= 4, by normalised direct linear transformation."""
    ta, tb = standardising(a), standardising(b)
    (x, y), (u, v) = apply(ta, a).T, apply(tb, b).T
    one, none = np.ones(len(x)), np.zeros(len(x))
    rows = [[-x, -y, -one, none, none, none, u * x, u * y, u], [none, none, none, -x, -y, -one, v * x, v * y, v]]
    h = np.linalg.inv(tb) @ null_vector(interleaved(rows)).reshape(3, 3) @ ta
    return h / h[2, 2]


def apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / q[:, 2:]


def planar_calibration(homographies: list[np.ndarray]) -> np.ndarray:
    """Intrinsic matrix from three or more homographies of a plane."""
    v = lambda h, i, j: np.array([h[0, i] * h[0, j], h[0, i] * h[1, j] + h[1, i] * h[0, j], h[1, i] * h[1, j], h[2, i] * h[0, j] + h[0, i] * h[2, j], h[2, i] * h[1, j] + h[1, i] * h[2, j], h[2, i] * h[2, j]])
    rows = [x for h in homographies for x in (v(h, 0, 1), v(h, 0, 0) - v(h, 1, 1))]
    b11, b12, b22, b13, b23, b33 = np.linalg.svd(np.array(rows))[2][-1]
    cy = (b12 * b13 - b11 * b23) / (b11 * b22 - b12 * b12)
    scale = b33 - (b13 * b13 + cy * (b12 * b13 - b11 * b23)) / b11
    fx = math.sqrt(scale / b11)
    fy = math.sqrt(scale * b11 / (b11 * b22 - b12 * b12))
    s = -b12 * fx * fx * fy / scale
    return np.array([[fx, s, s * cy / fy - b13 * fx * fx / scale], [0, fy, cy], [0, 0, 1]])


def planar_pose(k: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and t of a plane's homography."""
    m = np.linalg.inv(k) @ h
    scale = 1 / np.linalg.norm(m[:, 0])
    scale = -scale if m[2, 2] < 0 else scale
    r1, r2, t = (scale * m[:, i] for i in range(3))
    return orthonormal(np.column_stack([r1, r2, np.cross(r1, r2)])), t


def resection(world: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """The 3 x 4 camera of 6 or more points, by direct linear transformation."""
    u, v = pixels.T
    p = [*world.T, np.ones(len(world))]
    none = [np.zeros(len(world))] * 4
    rows = [[*p, *none, *[-u * c for c in p]], [*none, *p, *[-v * c for c in p]]]
    return null_vector(interleaved(rows)).reshape(3, 4)


def decomposed(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K, R, t of a camera matrix."""
    m = p[:, :3] * np.sign(np.linalg.det(p[:, :3]))
    q, r = np.linalg.qr(np.linalg.inv(m))
    k, rot = np.linalg.inv(r), q.T
    d = np.diag(np.sign(np.diag(k)))
    k, rot = k @ d, d @ rot
    scale = k[2, 2]
    return k / scale, rot, np.linalg.solve(k, p[:, 3] * np.sign(np.linalg.det(p[:, :3])))


def triangulate(cameras: list[np.ndarray], pixels: list[np.ndarray]) -> np.ndarray:
    """The world point seen at these pixels, linear least squares."""
    rows = [row for p, (x, y) in zip(cameras, pixels, strict=True) for row in (x * p[2] - p[0], y * p[2] - p[1])]
    w = np.linalg.svd(np.array(rows))[2][-1]
    return w[:3] / w[3]


def triangulate_all(cameras: list[np.ndarray], pixels: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """triangulate for many points: pixels holds (n, 2) of each camera; (n, 3), some thousand points at a time."""
    out = np.empty((len(pixels[0]), 3))
    for k in range(0, len(out), block):
        rows = [xy[k : k + block, [c]] * p[2] - p[c] for p, xy in zip(cameras, pixels, strict=True) for c in (0, 1)]
        w = np.linalg.svd(np.stack(rows, axis=1))[2][:, -1]
        out[k : k + block] = w[:, :3] / w[:, 3:]
    return out


# Two views ---------------------------------------------------------------------------------------------------


def standardising(p: np.ndarray) -> np.ndarray:
    """3 x 3 transform to mean 0 and sample deviation 1 per coordinate; a deviation of 0 only shifts."""
    m, s = p.mean(axis=0), p.std(axis=0, ddof=1)
    s[s == 0] = 1
    return np.array([[1 / s[0], 0, -m[0] / s[0]], [0, 1 / s[1], -m[1] / s[1]], [0, 0, 1]])


def design(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows b (x) a of b^T F a = 0."""
    ha, hb = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, np.ones(len(b))])
    return (hb[:, :, None] * ha[:, None, :]).reshape(len(a), 9)


def fundamental_8(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """F of 8 or more matches, normalised, of rank 2 and unit norm."""
    ta, tb = standardising(a), standardising(b)
    f = null_vector(design(apply(ta, a), apply(tb, b))).reshape(3, 3)
    u, s, vt = np.linalg.svd(f)
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ vt) @ ta
    return f / np.linalg.norm(f)


def fundamental_7(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The one or three F of 7 matches."""
    ta, tb = standardising(a), standardising(b)
    vt = np.linalg.svd(design(apply(ta, a), apply(tb, b)))[2]
    f1, f2 = vt[-1].reshape(3, 3), vt[-2].reshape(3, 3)
    xs = np.array([0.0, 1.0, -1.0, 2.0])
    cubic = np.polyfit(xs, [np.linalg.det(x * f1 + (1 - x) * f2) for x in xs], 3)
    out = []
    for root in np.roots(cubic):
        if abs(root.imag) < 1e-8:
            f = tb.T @ (root.real * f1 + (1 - root.real) * f2) @ ta
            out.append(f / np.linalg.norm(f))
    return out


def essential(f: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return k2.T @ f @ k1


def epipoles(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, _, vt = np.linalg.svd(f)
    return vt[-1], u[:, -1]


def sampson(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Sampson distances of matches."""
    ha, hb = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, np.ones(len(b))])
    la, lb = ha @ f.T, hb @ f
    return (hb * la).sum(axis=1) ** 2 / np.maximum(la[:, 0] ** 2 + la[:, 1] ** 2 + lb[:, 0] ** 2 + lb[:, 1] ** 2, 1e-300)


def pose_from_essential(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and unit t with the most points before both cameras; a and b in normalised coordinates."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    best = None
    for r in (u @ w @ vt, u @ w.T @ vt):
        for t in (u[:, 2], -u[:, 2]):
            p1, p2 = np.eye(3, 4), np.column_stack([r, t])
            x = triangulate_all([p1, p2], [a, b])
            n = int(((x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)).sum())
            if best is None or n > best[0]:
                best = (n, r, t)
    return best[1], best[2]


def trials(inliers: float, sample: int, certainty: float = 0.95) -> int:
    """Samples until one without outliers is this certain."""
    if inliers >= 1:
        return 1
    return math.ceil(math.log(1 - certainty) / math.log(1 - inliers**sample))


def ransac_fundamental(a: np.ndarray, b: np.ndarray, tolerance: float, seed: int = 1, most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """F and the inliers (Sampson distance within the tolerance), seeded: the same matches give the same result."""
    rng, best, need, k = np.random.default_rng(seed), None, most, 0
    while k < need:
        pick = rng.choice(len(a), 7, replace=False)
        for f in fundamental_7(a[pick], b[pick]):
            error = sampson(f, a, b)
            good = error <= tolerance**2
            score = (int(good.sum()), -float(error[good].sum()))
            if best is None or score > best[0]:
                best = (score, good)
                need = min(most, trials(score[0] / len(a), 7, 0.99))
        k += 1
    return fundamental_8(a[best[1]], b[best[1]]) if best[1].sum() >= 8 else fundamental_7(a[best[1]], b[best[1]])[0], best[1]


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Scale, rotation (radians) and translation with b = scale * R a + t, least squares."""
    ma, mb = a.mean(axis=0), b.mean(axis=0)
    z = complex(((a - ma) * (b - mb)).sum(), ((a - ma)[:, 0] * (b - mb)[:, 1] - (a - ma)[:, 1] * (b - mb)[:, 0]).sum()) / max(((a - ma) ** 2).sum(), 1e-300)
    r = np.array([[z.real, -z.imag], [z.imag, z.real]])
    return abs(z), math.atan2(z.imag, z.real), mb - r @ ma


def ransac_similarity(a: np.ndarray, b: np.ndarray, tolerance: float, seed: int = 1, most: int = 500) -> tuple[tuple, np.ndarray]:
    rng, best = np.random.default_rng(seed), None
    for _ in range(most):
        pick = rng.choice(len(a), 2, replace=False)
        if np.array_equal(a[pick[0]], a[pick[1]]):
            continue
        s, t, d = similarity(a[pick], b[pick])
        r = s * np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
        good = np.linalg.norm(a @ r.T + d - b, axis=1) <= tolerance
        if best is None or good.sum() > best.sum():
            best = good
    return similarity(a[best], b[best]), best


def rectify(f: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Homographies that send both epipoles to infinity along x (of the second image first, the first by its rotation)."""

    def one(e: np.ndarray) -> np.ndarray:
        t = np.array([[1, 0, -w / 2], [0, 1, -h / 2], [0, 0, 1.0]])
        p = t @ e
        a = math.atan2(p[1], p[0])
        r = np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]])
        p = r @ p
        g = np.eye(3)
        g[2, 0] = -p[2] / p[0] if p[0] else 0
        return np.linalg.inv(t) @ g @ r @ t

    e1, e2 = epipoles(f)
    return one(e1), one(e2)


#: Points of a block of bundle adjustment.
BLOCK = 4096


def bundle_adjust(k: np.ndarray, poses: np.ndarray, world: np.ndarray, seen: list[tuple[int, int, float, float]], rounds: int = 20) -> tuple[np.ndarray, np.ndarray, float]:
    """Levenberg-Marquardt over camera poses (n, 6: rotation vector, t) and points, by the Schur complement of the points,
    summed by blocks of these.

    seen: (camera, point, x, y). The first camera stays. Returns poses, points and the root mean square error.
    """
    poses, world, damp = poses.astype(float).copy(), world.astype(float).copy(), 1e-3
    cams, pts = np.array([s[0] for s in seen]), np.array([s[1] for s in seen])
    xy = np.array([s[2:] for s in seen], float)

    def residual(ps: np.ndarray, ws: np.ndarray) -> np.ndarray:
        out = np.empty((len(seen), 2))
        for c in range(len(ps)):
            m = cams == c
            out[m] = xy[m] - project(k, rodrigues(ps[c, :3]), ps[c, 3:], ws[pts[m]])
        return out

    order = np.argsort(pts, kind="stable")
    starts = range(0, len(world), BLOCK)
    blocks = [(slice(lo, min(lo + BLOCK, len(world))), order[slice(*np.searchsorted(pts[order], [lo, lo + BLOCK]))]) for lo in starts]

    def crossed(part: slice, own: np.ndarray) -> np.ndarray:
        """Products of a block's derivatives by camera and by point: (camera, point, 6, 3)."""
        out = np.zeros((len(poses), part.stop - part.start, 6, 3))
        np.add.at(out, (cams[own], pts[own] - part.start), np.einsum("nri,nrj->nij", jc[own], jp[own]))
        return out

    now = residual(poses, world)
    for _ in range(rounds):
        jc, jp = np.empty((len(seen), 2, 6)), np.empty((len(seen), 2, 3))
        for i in range(6):
            step = poses.copy()
            step[:, i] += 1e-6
            jc[:, :, i] = (residual(step, world) - now) / 1e-6
        for i in range(3):
            step = world.copy()
            step[:, i] += 1e-6
            jp[:, :, i] = (residual(poses, step) - now) / 1e-6
        nc, np_ = len(poses), len(world)
        u, v, gc, gp = np.zeros((nc, 6, 6)), np.zeros((np_, 3, 3)), np.zeros((nc, 6)), np.zeros((np_, 3))
        for c in range(nc):
            mine = jc[cams == c].reshape(-1, 6)
            u[c], gc[c] = mine.T @ mine, -mine.T @ now[cams == c].reshape(-1)
        np.add.at(v, pts, np.einsum("nri,nrj->nij", jp, jp))
        np.add.at(gp, pts, -np.einsum("nri,nr->ni", jp, now))
        u += damp * np.eye(6) * np.maximum(np.einsum("nii->ni", u), 1e-9)[:, None]
        v += damp * np.eye(3) * np.maximum(np.einsum("nii->ni", v), 1e-9)[:, None]
        vi = np.linalg.inv(v)
        s, r = np.zeros((nc * 6, nc * 6)), gc.reshape(-1).copy()
        for c in range(nc):
            s[c * 6 : c * 6 + 6, c * 6 : c * 6 + 6] = u[c]
        for part, own in blocks:
            w = crossed(part, own)
            y = w @ vi[part]
            r -= np.einsum("cnij,nj->ci", y, gp[part]).reshape(-1)
            s -= np.einsum("cnij,dnkj->cidk", y, w, optimize=True).reshape(s.shape)
        s[:6], s[:, :6], s[:6, :6], r[:6] = 0, 0, np.eye(6), 0
        dc = np.linalg.solve(s, r).reshape(nc, 6)
        back = gp.copy()
        for part, own in blocks:
            back[part] -= np.einsum("cnij,ci->nj", crossed(part, own), dc)
        dp = np.einsum("pij,pj->pi", vi, back)
        new = residual(poses + dc, world + dp)
        if (new**2).sum() < (now**2).sum():
            done = (now**2).sum() - (new**2).sum() < 1e-12
            poses, world, now, damp = poses + dc, world + dp, new, damp / 10
            if done:
                break
        else:
            damp *= 10
    return poses, world, float(np.sqrt((now**2).mean()))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, each used once; the shorter side is used up."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = 1 + int(np.where(used[1:], np.inf, least[1:]).argmin())
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[1:][~used[1:]] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sorted((int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j])


def cubic_roots(a: float, b: float, c: float, d: float) -> list[float]:
    """Real roots of a x^3 + b x^2 + c x + d, rising."""
    return sorted(float(r.real) for r in np.roots([a, b, c, d]) if abs(r.imag) < 1e-9)


# Shapes ------------------------------------------------------------------------------------------------------


def resampled(curve: np.ndarray, n: int) -> np.ndarray:
    """n points at equal arc lengths of a closed curve."""
    closed = np.vstack([curve, curve[:1]]).astype(float)
    at = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(closed, axis=0), axis=1))])
    to = np.arange(n) * at[-1] / n
    return np.column_stack([np.interp(to, at, closed[:, i]) for i in (0, 1)])


def chord_angles_of(curves: np.ndarray) -> np.ndarray:
    """(curves, n, n) of curves (curves, n, 2): angles at j between the chords to i and to the point before j: row i relative to
    each j, 0..pi."""
    d = curves[:, :, None] - curves[:, None]
    ray = np.arctan2(d[..., 1], d[..., 0])  # from j to i
    back = np.roll(curves, 1, axis=1) - curves
    angle = np.abs(ray - np.arctan2(back[..., 1], back[..., 0])[:, None])
    angle = np.where(angle > np.pi, 2 * np.pi - angle, angle)
    angle[:, np.arange(curves.shape[1]), np.arange(curves.shape[1])] = 0
    return angle


def chord_angles(curve: np.ndarray) -> np.ndarray:
    """chord_angles_of one curve."""
    return chord_angles_of(curve[None])[0]


def partial_match(a: np.ndarray, b: np.ndarray, least: int) -> tuple[float, int, int, int]:
    """The best block match of two chord-angle matrices of one size: (mean difference, start in a, rotation of b, length).

    For each rotation of b the squared differences are summed over all square blocks on the diagonal by a summed-area
    table; blocks compare by mean difference plus the share of the curve left out.
    """
    cost, start, turn, length = (x[0] for x in partial_matches(a[None], b[None], least))
    return float(cost), int(start), int(turn), int(length)


def partial_matches(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """partial_match of many pairs of matrices, (m, n, n) each, at a time: arrays of costs, starts, rotations and lengths."""
    m, n = a.shape[:2]
    cost, at = np.full(m, np.inf), np.zeros((3, m), np.int64)
    table = np.zeros((m, n + 1, n + 1))
    for turn in range(n):
        d = (a - np.roll(b, (-turn, -turn), (1, 2))) ** 2
        table[:, 1:, 1:] = d.cumsum(axis=1).cumsum(axis=2)
        for length in range(least, n + 1):
            i = np.arange(n - length + 1)
            total = table[:, i + length, i + length] - table[:, i, i + length] - table[:, i + length, i] + table[:, i, i]
            mean = np.sqrt(np.maximum(total, 0)) / length
            k = mean.argmin(axis=1)
            value = np.hypot(mean[np.arange(m), k], 1 - length / n)
            better = value < cost - 1e-12
            cost = np.where(better, value, cost)
            at[:, better] = np.stack([k, np.full(m, turn), np.full(m, length)])[:, better]
    return cost, *at


def crossings(curves: np.ndarray, sigma: float) -> np.ndarray:
    """(curves, n): where the curvature of closed curves (curves, n, 2), smoothed by sigma, crosses zero."""
    f = np.fft.fftfreq(curves.shape[1]) * 2 * np.pi
    g = np.fft.fft(curves[..., 0] + 1j * curves[..., 1], axis=1) * np.exp(-0.5 * (sigma * f) ** 2)
    d1, d2 = np.fft.ifft(1j * f * g, axis=1), np.fft.ifft(-(f**2) * g, axis=1)
    k = d1.real * d2.imag - d1.imag * d2.real
    k = np.where(np.abs(k) < 1e-12 * np.abs(k).max(axis=1, keepdims=True, initial=1e-300), 0, k)
    return np.sign(k) * np.sign(np.roll(k, -1, axis=1)) < 0


def inflections(curve: np.ndarray, sigmas: list[float]) -> list[tuple[float, int]]:
    """(sigma, position) of the curvature's zero crossings of a closed curve as it is smoothed more and more."""
    return [(float(s), int(i)) for s in sigmas for i in np.flatnonzero(crossings(np.asarray(curve)[None], s)[0])]


def cameras_of_fundamental(f: np.ndarray) -> np.ndarray:
    """The second camera [[e]x F | e] up to a homography of the scene, the first one being [I | 0]; e is the second epipole."""
    e = np.linalg.svd(f)[0][:, 2]
    return np.column_stack([np.cross(np.eye(3), e).T @ f, e])


def plane_of(points: np.ndarray) -> np.ndarray:
    """The plane (a, b, c, d) of length 1 nearest to homogeneous points (rows of 4)."""
    p = np.asarray(points, float)
    return null_vector(p / p[:, 3:])
