"""Points that share places, and transformations that are equal: brute force, and how little is paired."""

import re

import numpy as np

from lumenframe.operators import points



def crowd(spark, n, places, seed=1, sets=3):
    """n points of each set at a few places, some of them alone; an id may be at two places."""
    rng = np.random.default_rng(seed)
    rows = [(f"s{s}", int(i), int(p % 7) * 3, int(p // 7) * 4) for s in range(sets) for i, p in enumerate(rng.integers(0, places, n))]
    rows += [(f"s{s}", n + k, 100 * k + 200, 50) for s in range(sets) for k in range(3)] + [("s0", 1, 333, 50), ("apart", 1, 0, 0), ("apart", 2, 60, 0), ("one", 1, 0, 0)]
    return spark.createDataFrame(rows, "set_id string, point_id long, x int, y int"), rows


def recorded(monkeypatch):
    """The most rows that the joins by distance get from here on."""
    seen, join = [0], points.radius_join

    def counted(a, b, *rest):
        seen[0] = max(seen[0], a.count(), b.count())
        return join(a, b, *rest)

    monkeypatch.setattr(points, "radius_join", counted)
    return seen


def gaps(rows):
    """set, id, id, squared distance of all pairs of different ids."""
    return [(s, i, j, float((x - u) ** 2 + (y - v) ** 2)) for s, i, x, y in rows for t, j, u, v in rows if s == t and i != j]



def test_alike_transformations_are_counted_by_class(spark):
    rng = np.random.default_rng(2)
    rows = [("a", int(i), 1 + int(s) * 0.02, int(t) * 6 % 360) for i, s, t in zip(range(300), rng.integers(0, 9, 300), rng.integers(0, 12, 300))]
    rows += [("a", 5, 1.1, 354), ("a", 5, 1.1, 0), ("b", 1, 1.0, 0)]
    found = points.similar_transformations(spark.createDataFrame(rows, "set_id string, point_id long, scale double, turn int"), "scale", "turn")
    want = {(g, k): 0 for g, k, _, _ in rows}
    for g, k, s, t in rows:
        for h, m, u, v in rows:
            gap = abs(t - v)
            want[g, k] += g == h and k != m and round(abs(s - u) - 0.1 * (s + u), 9) <= 0 and min(gap, 360 - gap) <= 20
    assert {(r.set_id, r.point_id): r.likes for r in found.collect()} == want
    assert re.search(r"Aggregate \[set_id#\d+, scale#\d+, turn#\d+\]", found._jdf.queryExecution().optimizedPlan().toString())


def test_closest_pair_needs_no_search_where_points_share_a_place(spark, monkeypatch):
    df, rows = crowd(spark, 200, 20)
    seen = recorded(monkeypatch)
    want = {}
    for s, i, j, d in gaps(rows):
        if i < j:
            want[s] = min(want.get(s, (d, i, j)), (d, i, j))
    assert {r.set_id: (r.d2, r.id1, r.id2) for r in points.closest_pair(df, 5).collect()} == want
    assert seen[0] == 2


def test_mutual_matches_pair_places(spark, monkeypatch):
    df, rows = crowd(spark, 200, 20)
    rows = [(s, i, x, y + i % 2) for s, i, x, y in rows]  # so that not all match at distance 0
    df = df.selectExpr("set_id", "point_id", "x", "CAST(y + point_id % 2 AS INT) AS y")
    seen = recorded(monkeypatch)
    pairs = [p for p in gaps(rows) if p[1] % 2 == 0 and p[2] % 2 == 1 and p[3] <= 100]
    forth, back = {}, {}
    for s, i, j, d in pairs:
        forth[s, i] = min(forth.get((s, i), (d, j)), (d, j))
        back[s, j] = min(back.get((s, j), (d, i)), (d, i))
    want = {(s, i, j, d) for (s, i), (d, j) in forth.items() if back[s, j] == (d, i)}
    found = points.mutual_matches(df.where("point_id % 2 = 0"), df.where("point_id % 2 = 1"), 10)
    assert found.columns == ["set_id", "id1", "id2", "d2"] and sorted(map(tuple, found.collect())) == sorted(want) and want
    assert seen[0] < 100  # of 300 points a side


def test_nearest_points_are_sought_by_places(spark, monkeypatch):
    df, rows = crowd(spark, 200, 20)
    seen = recorded(monkeypatch)
    want = {}
    for s, i, j, d in gaps(rows):
        want[s, i] = min(want.get((s, i), (d, j)), (d, j))
    found = points.nearest(df, 5)
    assert {(r.set_id, r.id1): (r.d2, r.id2) for r in found.collect()} == want and found.count() == len(want)
    assert seen[0] < 200  # of 617 points


def test_join_by_distance_broadcasts_no_side(spark):
    df, rows = crowd(spark, 30, 20)
    found = points.radius_join(df, df, 5)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    same = [(s, i, i, float((x - u) ** 2 + (y - v) ** 2)) for s, i, x, y in rows for t, j, u, v in rows if s == t and i == j]
    assert sorted(map(tuple, found.collect())) == sorted(p for p in [*gaps(rows), *same] if p[3] <= 25)


def test_join_by_distance_compares_places(spark, monkeypatch):
    """Of many points at two places near each other lists are shuffled, in shares; nulls, equal ids and a place by itself too."""
    monkeypatch.setattr(points, "SHARE", 7)
    rows = [("a", i, i % 2, 0) for i in range(60)] + [("a", 3, 1, 0), ("a", None, 1, 0), ("b", 1, 1, 0), ("b", 2, None, 0), (None, 3, 1, 0)]
    df = spark.createDataFrame(rows, "set_id string, point_id long, x int, y int")
    found = points.radius_join(df, df, 1).cache()
    place = [r for r in rows if r[0] and r[2] is not None]
    want = [(s, i, j, float((x - u) ** 2)) for s, i, x, _ in place for t, j, u, _ in place if s == t and abs(x - u) <= 1]
    key = lambda p: tuple((v is None, v) for v in p)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    met, near = [], points._near
    monkeypatch.setattr(points, "_near", lambda a, b, *rest: met.append((a.count(), b.count())) or near(a, b, *rest))
    points.radius_join(df, df, 1)
    assert met == [(13, 13)]
