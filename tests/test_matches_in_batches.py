"""Matches of outlines, many pairs at a time, against one pair after another."""

import numpy as np

from lumenframe.functions import geometry
from lumenframe.plans import imaging


def plain_match(a, b, least):
    n, best = len(a), (np.inf, 0, 0, 0)
    for turn in range(n):
        d = (a - np.roll(b, (-turn, -turn), (0, 1))) ** 2
        for length in range(least, n + 1):
            mean = [np.sqrt(d[i : i + length, i : i + length].sum()) / length for i in range(n - length + 1)]
            value = float(np.hypot(min(mean), 1 - length / n))
            if value < best[0] - 1e-12:
                best = (value, int(np.argmin(mean)), turn, length)
    return best


def outline(v):
    t = 2 * np.pi * np.arange(len(v)) / len(v)
    r = 1 + np.array(v) / 500
    return geometry.chord_angles(geometry.resampled(np.column_stack([r * np.cos(t), r * np.sin(t)]), 24))


def test_many_pairs_at_a_time():
    draw = np.random.default_rng(3)
    made = np.array([outline(draw.normal(0, 80, draw.integers(1, 60))) for _ in range(9)])
    cost, *at = geometry.partial_matches(made[:-1], made[1:], 8)
    for k in range(8):
        want = plain_match(made[k], made[k + 1], 8)
        assert abs(cost[k] - want[0]) < 1e-9 and tuple(int(x[k]) for x in at) == want[1:]
        assert geometry.partial_match(made[k], made[k + 1], 8) == (cost[k], *(x[k] for x in at))


def test_outlines_of_a_table(spark, tmp_path, monkeypatch):
    """Gaps between curves, curves of one point, events of nobody and null values; pairs in several batches."""
    monkeypatch.setattr(imaging, "_PAIRS", 2)
    draw = np.random.default_rng(5)
    values = {k: draw.normal(0, 80, n).tolist() for k, n in ((1, 30), (2, 41), (3, 1), (4, 25), (5, 60), (7, 33), (9, 20), (10, 50))}
    rows = [(k * 1000 + i, k, v) for k, x in values.items() for i, v in enumerate(x)] + [(90_000 + i, None, 1.0) for i in range(5)] + [(99_999, 11, None)]
    draw.shuffle(rows)
    spark.createDataFrame([(int(e), None if u is None else int(u), None if v is None else float(v)) for e, u, v in rows], "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.a, r.b): r for r in imaging.shape_match(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(1, 2), (2, 3), (3, 4), (4, 5), (9, 10), (10, 11)]
    for a, b in sorted(got)[:-1]:
        want = geometry.partial_match(outline(values[a]), outline(values[b]), 8)
        assert abs(got[a, b].cost - want[0]) < 1e-12 and (got[a, b].start, got[a, b].turn, got[a, b].length) == want[1:]
    assert got[10, 11].cost == np.inf  # nothing matches a curve without a place
