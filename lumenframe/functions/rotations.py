"""Rotations, cameras and epipolar lines as named expressions, for Catalyst and other SQL engines alike.

Angles are a, b, c about x, y, z; vectors are three names; matrices are nine names, rows first.
"""

from __future__ import annotations

from lumenframe.functions.steps import Steps


def elementary() -> Steps:
    """The entries that aren't 0 or 1 of the rotations about each axis."""
    return [
        ("roll11", "cos(a)"), ("roll12", "-sin(a)"), ("roll21", "sin(a)"), ("pitch00", "cos(b)"), ("pitch02", "sin(b)"), ("pitch20", "-sin(b)"),
        ("yaw00", "cos(c)"), ("yaw01", "-sin(c)"), ("yaw10", "sin(c)"),
    ]


def xyz() -> Steps:
    """m: about z first, then y, then x; and the angles again."""
    return [
        ("m00", "cos(b) * cos(c)"), ("m01", "-cos(b) * sin(c)"), ("m02", "sin(b)"),
        ("m10", "cos(a) * sin(c) + sin(a) * sin(b) * cos(c)"), ("m11", "cos(a) * cos(c) - sin(a) * sin(b) * sin(c)"), ("m12", "-sin(a) * cos(b)"),
        ("m20", "sin(a) * sin(c) - cos(a) * sin(b) * cos(c)"), ("m21", "sin(a) * cos(c) + cos(a) * sin(b) * sin(c)"), ("m22", "cos(a) * cos(b)"),
        ("xa", "atan2(-m12, m22)"), ("xb", "atan2(m02, sqrt(m00 * m00 + m01 * m01))"), ("xc", "atan2(-m01, m00)"),
    ]


def rodrigues(vx: str = "vx", vy: str = "vy", vz: str = "vz", m: str = "m") -> Steps:
    """m: the rotation about a vector (not 0) by its length."""
    t = f"{m}_angle"
    k = {"x": f"({vx}) / {t}", "y": f"({vy}) / {t}", "z": f"({vz}) / {t}"}
    out = [(t, f"sqrt(({vx}) * ({vx}) + ({vy}) * ({vy}) + ({vz}) * ({vz}))"), *[(f"{m}_{c}", e) for c, e in k.items()], (f"{m}_c", f"1 - cos({t})"), (f"{m}_s", f"sin({t})")]
    axes, turn = "xyz", {(0, 1): "-z", (0, 2): "+y", (1, 0): "+z", (1, 2): "-x", (2, 0): "-y", (2, 1): "+x"}
    for i in range(3):
        for j in range(3):
            e = f"{m}_c * {m}_{axes[i]} * {m}_{axes[j]}"
            e += f" + cos({t})" if i == j else f" {turn[i, j][0]} {m}_s * {m}_{turn[i, j][1]}"
            out.append((f"{m}{i}{j}", e))
    return out


def rotation_vector(m: str = "m") -> Steps:
    """wx, wy, wz: the vector of a rotation by less than half a turn and more than none."""
    return [
        ("w_angle", f"acos(greatest(-1e0, least(1e0, ({m}00 + {m}11 + {m}22 - 1) / 2)))"), ("w_scale", "w_angle / (2 * sin(w_angle))"),
        ("wx", f"w_scale * ({m}21 - {m}12)"), ("wy", f"w_scale * ({m}02 - {m}20)"), ("wz", f"w_scale * ({m}10 - {m}01)"),
    ]


def quaternion(vx: str, vy: str, vz: str, q: str = "q") -> Steps:
    """q: the unit quaternion, scalar first, of a rotation vector (not 0)."""
    t = f"{q}_angle"
    part = f"sin({t} / 2) / {t}"
    return [(t, f"sqrt(({vx}) * ({vx}) + ({vy}) * ({vy}) + ({vz}) * ({vz}))"), (f"{q}w", f"cos({t} / 2)"), *[(f"{q}{c}", f"({v}) * {part}") for c, v in zip("xyz", (vx, vy, vz), strict=True)]]


def quaternion_matrix(q: str = "q", m: str = "n") -> Steps:
    w, x, y, z = (f"{q}{c}" for c in "wxyz")
    return [
        (f"{m}00", f"1 - 2 * ({y} * {y} + {z} * {z})"), (f"{m}01", f"2 * ({x} * {y} - {w} * {z})"), (f"{m}02", f"2 * ({x} * {z} + {w} * {y})"),
        (f"{m}10", f"2 * ({x} * {y} + {w} * {z})"), (f"{m}11", f"1 - 2 * ({x} * {x} + {z} * {z})"), (f"{m}12", f"2 * ({y} * {z} - {w} * {x})"),
        (f"{m}20", f"2 * ({x} * {z} - {w} * {y})"), (f"{m}21", f"2 * ({y} * {z} + {w} * {x})"), (f"{m}22", f"1 - 2 * ({x} * {x} + {y} * {y})"),
    ]


def turned(m: str, x: str, y: str, z: str, out: str) -> Steps:
    """A vector turned by a matrix."""
    return [(f"{out}{c}", f"{m}{i}0 * ({x}) + {m}{i}1 * ({y}) + {m}{i}2 * ({z})") for i, c in enumerate("xyz")]


def compound(q: str = "q") -> Steps:
    """Rows of the matrices by which a quaternion (w, x, y, z) multiplies another from the left (l) and from the right (r)."""
    w, x, y, z = (f"{q}{c}" for c in "wxyz")
    left = [[w, f"-{x}", f"-{y}", f"-{z}"], [x, w, f"-{z}", y], [y, z, w, f"-{x}"], [z, f"-{y}", x, w]]
    right = [[w, f"-{x}", f"-{y}", f"-{z}"], [x, w, z, f"-{y}"], [y, f"-{z}", w, x], [z, y, f"-{x}", w]]
    return [(f"{n}{i}{j}", e) for n, rows in (("l", left), ("r", right)) for i, row in enumerate(rows) for j, e in enumerate(row)]


def slerp(p: str = "p", q: str = "q", share: str = "share") -> Steps:
    """s: between two unit quaternions (different ones), the shorter way; and the angle between them."""
    return [
        ("pq", " + ".join(f"{p}{c} * {q}{c}" for c in "wxyz")), ("pq_sign", "CASE WHEN pq < 0 THEN -1e0 ELSE 1e0 END"), ("pq_angle", "acos(least(1e0, abs(pq)))"),
        *[(f"s{c}", f"CASE WHEN pq_angle < 1e-9 THEN {p}{c} ELSE (sin((1 - {share}) * pq_angle) * {p}{c} + sin({share} * pq_angle) * pq_sign * {q}{c}) / sin(pq_angle) END") for c in "wxyz"],
        ("geodesic", "2 * pq_angle"),
    ]


def cayley() -> Steps:
    """y: the rotation (I - S)^-1 (I + S) of skew parameters vx, vy, vz."""
    v, turn = ("vx", "vy", "vz"), {(0, 1): "- vz", (0, 2): "+ vy", (1, 0): "+ vz", (1, 2): "- vx", (2, 0): "- vy", (2, 1): "+ vx"}
    n = "(vx * vx + vy * vy + vz * vz)"
    return [(f"y{i}{j}", f"((1 - {n}) + 2 * {v[i]} * {v[i]}) / (1 + {n})" if i == j else f"2 * ({v[i]} * {v[j]} {turn[i, j]}) / (1 + {n})") for i in range(3) for j in range(3)]


def angular_rates() -> Steps:
    """j: angular velocity from the rates of the angles a, b, c of xyz()."""
    return [("j00", "cos(b) * cos(c)"), ("j01", "sin(c)"), ("j10", "-cos(b) * sin(c)"), ("j11", "cos(c)"), ("j20", "sin(b)"), ("j22", "1e0")]


def between() -> Steps:
    """d: the smallest rotation from direction (ux, uy, uz) to (vx, vy, vz), which aren't opposite."""
    out = [("un", "sqrt(ux * ux + uy * uy + uz * uz)"), ("vn", "sqrt(vx * vx + vy * vy + vz * vz)"), ("uv", "(ux * vx + uy * vy + uz * vz) / (un * vn)")]
    out += [("kx", "(uy * vz - uz * vy) / (un * vn)"), ("ky", "(uz * vx - ux * vz) / (un * vn)"), ("kz", "(ux * vy - uy * vx) / (un * vn)")]
    k, turn = ("kx", "ky", "kz"), {(0, 1): "- kz", (0, 2): "+ ky", (1, 0): "+ kz", (1, 2): "- kx", (2, 0): "- ky", (2, 1): "+ kx"}
    return out + [(f"d{i}{j}", f"uv + {k[i]} * {k[i]} / (1 + uv)" if i == j else f"{k[i]} * {k[j]} / (1 + uv) {turn[i, j]}") for i in range(3) for j in range(3)]


def intrinsics() -> Steps:
    """Inverse of the intrinsic matrix (fx, skewness, ox; 0, fy, oy; 0, 0, 1), and a pixel (u, v) in camera coordinates."""
    return [
        ("i00", "1 / fx"), ("i01", "-skewness / (fx * fy)"), ("i02", "(skewness * oy - ox * fy) / (fx * fy)"), ("i11", "1 / fy"), ("i12", "-oy / fy"),
        ("cu", "i00 * u + i01 * v + i02"), ("cv", "i11 * v + i12"),
    ]


def undistorted(rounds: int = 6) -> Steps:
    """nu, nv: camera coordinates (cu, cv) without the radial distortion k1, k2, by fixed-point rounds."""
    out = [("n0u", "cu"), ("n0v", "cv")]
    for k in range(rounds):
        out += [(f"g{k}", f"n{k}u * n{k}u + n{k}v * n{k}v"), (f"n{k + 1}u", f"cu / (1 + k1 * g{k} + k2 * g{k} * g{k})"), (f"n{k + 1}v", f"cv / (1 + k1 * g{k} + k2 * g{k} * g{k})")]
    return [*out, ("nu", f"n{rounds}u"), ("nv", f"n{rounds}v")]


def epipolar_lines() -> Steps:
    """Lines of (x1, y1) in the second and of (x2, y2) in the first image by f, and the distances of the points from them."""
    second = [(f"s{i}", f"f{i}0 * x1 + f{i}1 * y1 + f{i}2") for i in range(3)]
    first = [(f"t{j}", f"f0{j} * x2 + f1{j} * y2 + f2{j}") for j in range(3)]
    return [*second, *first, ("second_distance", "abs(s0 * x2 + s1 * y2 + s2) / sqrt(s0 * s0 + s1 * s1)"), ("first_distance", "abs(t0 * x1 + t1 * y1 + t2) / sqrt(t0 * t0 + t1 * t1)")]


def essential() -> Steps:
    """e: the essential matrix K^T F K of one camera (fx, fy, ox, oy, no skewness); and b: F from it again."""
    k, inverse = [["fx", "0e0", "ox"], ["0e0", "fy", "oy"], ["0e0", "0e0", "1e0"]], [["1 / fx", "0e0", "-ox / fx"], ["0e0", "1 / fy", "-oy / fy"], ["0e0", "0e0", "1e0"]]

    def sandwich(out: str, m: str, k: list) -> Steps:
        return [(f"{out}{i}{j}", " + ".join(f"({k[a][i]}) * {m}{a}{b} * ({k[b][j]})" for a in range(3) for b in range(3))) for i in range(3) for j in range(3)]

    return sandwich("e", "f", k) + sandwich("b", "e", inverse)
