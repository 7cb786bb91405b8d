"""Number functions as SQL text for Catalyst: magnitudes, combinatorics, bits, complex numbers, low-discrepancy points."""

from __future__ import annotations

from lumenframe.functions.steps import Steps


def power_of_ten(x: str) -> str:
    """Exponent of the largest power of 10 at or below |x|; 0 for 0."""
    return f"CASE WHEN {x} = 0 THEN 0 ELSE CAST(floor(log10(abs({x} * 1e0)) + 1e-12) AS INTEGER) END"


def round_down_by_power(x: str) -> str:
    return f"floor({x} / pow(10e0, {power_of_ten(x)})) * pow(10e0, {power_of_ten(x)})"


def round_up_by_power(x: str) -> str:
    return f"(floor({x} / pow(10e0, {power_of_ten(x)})) + 1) * pow(10e0, {power_of_ten(x)})"


def real_cube_root(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -pow(-({x} * 1e0), 1e0 / 3e0) ELSE pow({x} * 1e0, 1e0 / 3e0) END"


def interpolated(x: str, x0: str, y0: str, x1: str, y1: str) -> str:
    """Linear interpolation; y0 where the ends coincide."""
    return f"CASE WHEN {x1} = {x0} THEN {y0} * 1e0 ELSE {y0} + ({x} - {x0}) * ({y1} - {y0}) * 1e0 / ({x1} - {x0}) END"


def polar_degrees(x: str, y: str) -> str:
    return f"CASE WHEN atan2({y} * 1e0, {x} * 1e0) < 0 THEN degrees(atan2({y} * 1e0, {x} * 1e0)) + 360 ELSE degrees(atan2({y} * 1e0, {x} * 1e0)) END"


def complex_product() -> Steps:
    """re, im of (ar + i ai)(br + i bi)."""
    return [("re", "ar * br - ai * bi"), ("im", "ar * bi + ai * br")]


def complex_quotient() -> Steps:
    """re, im of (ar + i ai) / (br + i bi); null for a zero divisor."""
    d = "nullif(br * br + bi * bi, 0e0)"
    return [("re", f"(ar * br + ai * bi) / {d}"), ("im", f"(ai * br - ar * bi) / {d}")]


def complex_functions() -> Steps:
    """Modulus, phase, square sum, exponential, sine and cosine, reciprocal of ar + i ai."""
    cosh, sinh = "(exp(ai) + exp(-ai)) / 2e0", "(exp(ai) - exp(-ai)) / 2e0"
    return [
        ("modulus", "sqrt(ar * ar + ai * ai)"), ("phase", "atan2(ai, ar)"), ("square_sum", "ar * ar + ai * ai"),
        ("exp_re", "exp(ar) * cos(ai)"), ("exp_im", "exp(ar) * sin(ai)"),
        ("sin_re", f"sin(ar) * {cosh}"), ("sin_im", f"cos(ar) * {sinh}"), ("cos_re", f"cos(ar) * {cosh}"), ("cos_im", f"-sin(ar) * {sinh}"),
        ("inv_re", "ar / nullif(ar * ar + ai * ai, 0e0)"), ("inv_im", "-ai / nullif(ar * ar + ai * ai, 0e0)"),
    ]


def quaternion_product() -> Steps:
    """Hamilton product of (pw, px, py, pz) and (qw, qx, qy, qz)."""
    return [
        ("mw", "pw * qw - px * qx - py * qy - pz * qz"), ("mx", "pw * qx + px * qw + py * qz - pz * qy"),
        ("my", "pw * qy - px * qz + py * qw + pz * qx"), ("mz", "pw * qz + px * qy - py * qx + pz * qw"),
    ]


def rotation_zyx() -> Steps:
    """The nine cells of Rz(c) Ry(b) Rx(a), angles in radians."""
    return [
        ("r00", "cos(c) * cos(b)"), ("r01", "cos(c) * sin(b) * sin(a) - sin(c) * cos(a)"), ("r02", "cos(c) * sin(b) * cos(a) + sin(c) * sin(a)"),
        ("r10", "sin(c) * cos(b)"), ("r11", "sin(c) * sin(b) * sin(a) + cos(c) * cos(a)"), ("r12", "sin(c) * sin(b) * cos(a) - cos(c) * sin(a)"),
        ("r20", "-sin(b)"), ("r21", "cos(b) * sin(a)"), ("r22", "cos(b) * cos(a)"),
    ]


def euler_from_zyx() -> Steps:
    """The angles back from the nine cells."""
    return [("ea", "atan2(r21, r22)"), ("eb", "atan2(-r20, sqrt(r21 * r21 + r22 * r22))"), ("ec", "atan2(r10, r00)")]


def ransac_trials(inliers: str, sample: int, certainty: float = 0.95) -> str:
    """ceil(ln(1 - certainty) / ln(1 - inliers^sample)); 1 where all are inliers, null where none is."""
    import math

    return f"CASE WHEN {inliers} >= 1 THEN 1 WHEN {inliers} <= 0 THEN NULL ELSE CAST(ceil({math.log(1 - certainty)!r} / ln(1e0 - pow({inliers}, {sample}))) AS BIGINT) END"


def radical_inverse(i: str, base: int, digits: int = 24) -> str:
    """Van der Corput point of a non-negative integer: its digits mirrored at the point."""
    return "(" + " + ".join(f"(floor({i} / {float(base) ** k!r}e0) - {base} * floor({i} / {float(base) ** (k + 1)!r}e0)) * {float(base) ** -(k + 1)!r}e0" for k in range(digits) if base ** (k + 1) < 1e9).replace("e-05e0", "e-05").replace("e-06e0", "e-06").replace("e-07e0", "e-07").replace("e-08e0", "e-08").replace("e-09e0", "e-09").replace("e-10e0", "e-10") + ")"


def sampson() -> Steps:
    """Sampson distance squared of (x1, y1) and (x2, y2) under the fundamental matrix f00..f22."""
    return [
        ("l0", "f00 * x1 + f01 * y1 + f02"), ("l1_", "f10 * x1 + f11 * y1 + f12"), ("l2_", "f20 * x1 + f21 * y1 + f22"),
        ("m0", "f00 * x2 + f10 * y2 + f20"), ("m1", "f01 * x2 + f11 * y2 + f21"),
        ("algebraic", "x2 * l0 + y2 * l1_ + l2_"), ("sampson", "algebraic * algebraic / nullif(l0 * l0 + l1_ * l1_ + m0 * m0 + m1 * m1, 0e0)"),
        ("epipolar_distance", "abs(algebraic) / nullif(sqrt(l0 * l0 + l1_ * l1_), 0e0)"),
    ]


def projection() -> Steps:
    """World point (wx, wy, wz) to pixels: R X + t, radial distortion k1, k2, then focal length and center."""
    return [
        ("zc", "r20 * wx + r21 * wy + r22 * wz + t2"), ("xn", "(r00 * wx + r01 * wy + r02 * wz + t0) / nullif(zc, 0e0)"), ("yn", "(r10 * wx + r11 * wy + r12 * wz + t1) / nullif(zc, 0e0)"),
        ("rr", "xn * xn + yn * yn"), ("ud", "1e0 + k1 * rr + k2 * rr * rr"), ("px_", "fx * xn * ud + ox"), ("py_", "fy * yn * ud + oy"),
    ]
