"""Colour spaces and colour differences as steps of native expressions; r, g, b are 0..255."""

from __future__ import annotations

from lumenframe.functions.steps import Steps, num, renamed

# CIE 1931 matrix and its divisor, sRGB matrix, white point D65, CIE constants.
CIE_1931 = ((0.49, 0.31, 0.20), (0.17697, 0.81240, 0.01063), (0.0, 0.01, 0.99))
CIE_1931_DIVISOR = 0.17697
SRGB = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
D65 = (95.047, 100.0, 108.883)
EPSILON, KAPPA_7 = 0.008856, 7.787


def xyz_1931() -> Steps:
    """cx, cy, cz: linear RGB in 0..1 through the CIE 1931 matrix."""
    rows = ["+".join(f"{num(m / CIE_1931_DIVISOR)} * {c} / 255e0" for m, c in zip(row, "rgb", strict=True)) for row in CIE_1931]
    return [("cx", rows[0]), ("cy", rows[1]), ("cz", rows[2])]


def chromaticity() -> Steps:
    """chx, chy: CIE xy of the 1931 tristimulus values; black has none (null)."""
    total = "nullif(cx + cy + cz, 0e0)"
    return [*xyz_1931(), ("chx", f"cx / {total}"), ("chy", f"cy / {total}")]


def xyz_srgb(standard: bool = True) -> Steps:
    """px, py, pz in 0..100 from gamma-encoded RGB. standard=False keeps the variant that adds the offset after dividing."""
    steps: Steps = []
    for c in "rgb":
        inner = f"({c} / 255e0 + 0.055e0) / 1.055e0" if standard else f"{c} / 255e0 + 0.055e0 / 1.055e0"
        steps.append((f"lin_{c}", f"CASE WHEN {c} / 255e0 > 0.04045e0 THEN pow({inner}, 2.4e0) ELSE {c} / 255e0 / 12.92e0 END"))
    for name, row in zip(("px", "py", "pz"), SRGB, strict=True):
        steps.append((name, "+".join(f"{num(100 * m)} * lin_{c}" for m, c in zip(row, "rgb", strict=True))))
    return steps


def lab(standard: bool = True) -> Steps:
    """lab_l, lab_a, lab_b under D65."""
    steps = xyz_srgb(standard)
    for name, white in zip("xyz", D65, strict=True):
        t = f"(p{name} / {num(white)})"
        steps.append((f"f{name}", f"CASE WHEN {t} > {num(EPSILON)} THEN pow({t}, 1e0 / 3e0) ELSE {num(KAPPA_7)} * {t} + 16e0 / 116e0 END"))
    return [*steps, ("lab_l", "116e0 * fy - 16e0"), ("lab_a", "500e0 * (fx - fy)"), ("lab_b", "200e0 * (fy - fz)")]


def luv() -> Steps:
    """luv_l, luv_u, luv_v under D65; black is 0."""
    wx, wy, wz = D65
    un, vn = 4 * wx / (wx + 15 * wy + 3 * wz), 9 * wy / (wx + 15 * wy + 3 * wz)
    base = "nullif(px + 15e0 * py + 3e0 * pz, 0e0)"
    return [
        *xyz_srgb(),
        ("yr", f"py / {num(wy)}"),
        ("luv_l", f"CASE WHEN yr > {num(EPSILON)} THEN 116e0 * pow(yr, 1e0 / 3e0) - 16e0 ELSE 903.3e0 * yr END"),
        ("luv_u", f"coalesce(13e0 * luv_l * (4e0 * px / {base} - {num(un)}), 0e0)"),
        ("luv_v", f"coalesce(13e0 * luv_l * (9e0 * py / {base} - {num(vn)}), 0e0)"),
    ]


def polar(a: str, b: str, prefix: str) -> Steps:
    """Magnitude and angle (degrees, 0 <= h < 360) of a colour plane."""
    return [
        (f"{prefix}_c", f"sqrt({a} * {a} + {b} * {b})"),
        (f"{prefix}_h", f"CASE WHEN {a} = 0e0 AND {b} = 0e0 THEN 0e0 WHEN atan2({b}, {a}) < 0e0 THEN degrees(atan2({b}, {a})) + 360e0 ELSE degrees(atan2({b}, {a})) END"),
    ]


def lch_lab() -> Steps:
    return [*lab(), *polar("lab_a", "lab_b", "lch")]


def lch_luv() -> Steps:
    return [*luv(), *polar("luv_u", "luv_v", "lchuv")]


def hsv() -> Steps:
    """hue in 0..1, saturation, brightness."""
    return [
        ("cmax", "greatest(r, g, b)"),
        ("cmin", "least(r, g, b)"),
        ("bright", "cmax / 255e0"),
        ("sat", "CASE WHEN cmax = 0 THEN 0e0 ELSE (cmax - cmin) / (cmax * 1e0) END"),
        ("hue6", "CASE WHEN cmax = cmin THEN 0e0 WHEN r = cmax THEN (g - b) / ((cmax - cmin) * 1e0) WHEN g = cmax THEN 2e0 + (b - r) / ((cmax - cmin) * 1e0) ELSE 4e0 + (r - g) / ((cmax - cmin) * 1e0) END"),
        ("hue", "CASE WHEN hue6 < 0e0 THEN hue6 / 6e0 + 1e0 ELSE hue6 / 6e0 END"),
    ]


def grey_modes() -> Steps:
    """Grey values: mean of the channels, luma (rounded), and each band."""
    return [
        ("grey_mean", "CAST(floor((r + g + b) / 3e0) AS INTEGER)"),
        ("grey_luma", "CAST(floor(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b + 0.5e0) AS INTEGER)"),
        ("luma", "0.299e0 * r + 0.587e0 * g + 0.114e0 * b"),
        ("bin01", "CASE WHEN r + g + b = 0 THEN 0 ELSE 1 END"),
    ]


def polar_theta(a: str, b: str, most: int = 255) -> Steps:
    """Hue angle scaled to 0..most and rounded."""
    return [*polar(a, b, "pt"), ("theta", f"CAST(floor(pt_h * {num(most)} / 360e0 + 0.5e0) AS INTEGER)")]


def delta_e_76() -> Steps:
    return [("de76", "sqrt(pow(l1 - l2, 2) + pow(a1 - a2, 2) + pow(b1 - b2, 2))")]


def delta_e_94(kl: float = 1, k1: float = 0.045, k2: float = 0.015) -> Steps:
    """Graphic-arts CIE94 of (l1, a1, b1) and (l2, a2, b2)."""
    return [
        ("e_c1", "sqrt(a1 * a1 + b1 * b1)"),
        ("e_dc", "e_c1 - sqrt(a2 * a2 + b2 * b2)"),
        ("e_dh2", "greatest(pow(a1 - a2, 2) + pow(b1 - b2, 2) - e_dc * e_dc, 0e0)"),
        ("de94", f"sqrt(pow((l1 - l2) / {num(kl)}, 2) + pow(e_dc / (1e0 + {num(k1)} * e_c1), 2) + e_dh2 / pow(1e0 + {num(k2)} * e_c1, 2))"),
    ]


def delta_e_2000() -> Steps:
    """CIEDE2000 of (l1, a1, b1) and (l2, a2, b2)."""
    angle = lambda b, a: f"CASE WHEN {a} = 0e0 AND {b} = 0e0 THEN 0e0 WHEN atan2({b}, {a}) < 0e0 THEN degrees(atan2({b}, {a})) + 360e0 ELSE degrees(atan2({b}, {a})) END"
    return [
        ("q_c7", "pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2e0, 7)"),
        ("q_g", "0.5e0 * (1e0 - sqrt(q_c7 / (q_c7 + pow(25e0, 7))))"),
        ("q_a1", "(1e0 + q_g) * a1"),
        ("q_a2", "(1e0 + q_g) * a2"),
        ("q_c1", "sqrt(q_a1 * q_a1 + b1 * b1)"),
        ("q_c2", "sqrt(q_a2 * q_a2 + b2 * b2)"),
        ("q_h1", angle("b1", "q_a1")),
        ("q_h2", angle("b2", "q_a2")),
        ("q_dh", "CASE WHEN q_c1 * q_c2 = 0e0 THEN 0e0 WHEN q_h2 - q_h1 > 180e0 THEN q_h2 - q_h1 - 360e0 WHEN q_h2 - q_h1 < -180e0 THEN q_h2 - q_h1 + 360e0 ELSE q_h2 - q_h1 END"),
        ("q_bigh", "2e0 * sqrt(q_c1 * q_c2) * sin(radians(q_dh / 2e0))"),
        ("q_lm", "(l1 + l2) / 2e0"),
        ("q_cm", "(q_c1 + q_c2) / 2e0"),
        ("q_hm", "CASE WHEN q_c1 * q_c2 = 0e0 THEN q_h1 + q_h2 WHEN abs(q_h1 - q_h2) <= 180e0 THEN (q_h1 + q_h2) / 2e0 WHEN q_h1 + q_h2 < 360e0 THEN (q_h1 + q_h2 + 360e0) / 2e0 ELSE (q_h1 + q_h2 - 360e0) / 2e0 END"),
        ("q_t", "1e0 - 0.17e0 * cos(radians(q_hm - 30e0)) + 0.24e0 * cos(radians(2e0 * q_hm)) + 0.32e0 * cos(radians(3e0 * q_hm + 6e0)) - 0.20e0 * cos(radians(4e0 * q_hm - 63e0))"),
        ("q_rc", "2e0 * sqrt(pow(q_cm, 7) / (pow(q_cm, 7) + pow(25e0, 7)))"),
        ("q_rt", "-sin(radians(60e0 * exp(-pow((q_hm - 275e0) / 25e0, 2)))) * q_rc"),
        ("q_sl", "1e0 + 0.015e0 * pow(q_lm - 50e0, 2) / sqrt(20e0 + pow(q_lm - 50e0, 2))"),
        ("q_sc", "1e0 + 0.045e0 * q_cm"),
        ("q_sh", "1e0 + 0.015e0 * q_cm * q_t"),
        ("de2000", "sqrt(pow((l2 - l1) / q_sl, 2) + pow((q_c2 - q_c1) / q_sc, 2) + pow(q_bigh / q_sh, 2) + q_rt * ((q_c2 - q_c1) / q_sc) * (q_bigh / q_sh))"),
    ]


def xyz_to_rgb() -> Steps:
    """or_, og_, ob_ (0..255, rounded and clipped) from px, py, pz in 0..100: the inverse of xyz_srgb."""
    import numpy as np

    inverse = np.linalg.inv(np.array(SRGB))
    steps: Steps = []
    for c, row in zip("rgb", inverse.tolist(), strict=True):
        steps.append((f"i_{c}", "+".join(f"{num(m / 100)} * {p}" for m, p in zip(row, ("px", "py", "pz"), strict=True))))
        encoded = f"CASE WHEN i_{c} > 0.0031308e0 THEN 1.055e0 * pow(i_{c}, 1e0 / 2.4e0) - 0.055e0 ELSE 12.92e0 * i_{c} END"
        steps.append((f"o{c}_", f"CAST(least(255e0, greatest(0e0, floor(({encoded}) * 255e0 + 0.5e0))) AS INTEGER)"))
    return steps


def normalised_difference(of: str, ranges: tuple[float, float, float]) -> Steps:
    """Mean of the three channel differences, each as a share of its range; of names the columns l, a, b of both sides."""
    parts = [f"abs({c}1 - {c}2) / {num(r)}" for c, r in zip("lab", ranges, strict=True)]
    return [(of, f"({' + '.join(parts)}) / 3e0")]


def colour_mode() -> Steps:
    """'white' where all channel means are 150 or more, 'black' where all are 55 or less, else 'other'."""
    return [("mode", "CASE WHEN mr >= 150 AND mg >= 150 AND mb >= 150 THEN 'white' WHEN mr <= 55 AND mg <= 55 AND mb <= 55 THEN 'black' ELSE 'other' END")]


def second(steps: Steps, suffix: str, names: list[str]) -> Steps:
    """The same steps over columns with a suffix, as for the other colour of a pair."""
    own = {n: n + suffix for n in [*names, *[n for n, _ in steps]]}
    return renamed(steps, own)
