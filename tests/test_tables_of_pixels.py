"""Curves traced by pointer doubling, watersheds, packing, spanning forests and objects: planted shapes and plain versions."""

import hashlib
import itertools
import random

import pytest

from lumenframe.operators import chains, merging, objects, packing, watershed

SHIFT = 1 << 20


def table_of(spark, points, columns="image_id long, x int, y int"):
    return spark.createDataFrame(points, columns).repartition(3)


# Curves ------------------------------------------------------------------------------------------------------

SPIRAL = [(x, 0) for x in range(12)] + [(11, y) for y in range(1, 12)] + [(x, 11) for x in range(10, 1, -1)] + [(2, y) for y in range(10, 2, -1)] + [(x, 3) for x in range(3, 8)]
RING = [(40, 40), (41, 39), (42, 39), (43, 40), (43, 41), (42, 42), (41, 42), (40, 41)]


def test_curves_rings_junctions_and_single_pixels(spark):
    cross = [(60, 5), (61, 5), (62, 5), (62, 4), (62, 6), (63, 5), (64, 5)]
    rows = [(7, *p) for p in SPIRAL + RING + cross + [(80, 80)]] + [(8, *p) for p in RING]
    got = {}
    for r in chains.trace(table_of(spark, rows)).collect():
        got.setdefault((r.image_id, r.curve, r.closed), {})[r.pos] = (r.x, r.y)
    curves = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    assert curves.pop((7, 0, False)) == SPIRAL
    for image in (7, 8):
        ring = curves.pop((image, 39 * SHIFT + 41, True))
        assert ring[0] == (41, 39) and ring[1] == (42, 39) and sorted(ring) == sorted(RING)
        assert all(max(abs(a - c), abs(b - d)) == 1 for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))
    assert curves.pop((7, 80 * SHIFT + 80, False)) == [(80, 80)]
    assert sorted(map(tuple, curves.values())) == sorted([((60, 5), (61, 5)), ((62, 4),), ((62, 6),), ((63, 5), (64, 5))])
    found = chains.junctions(table_of(spark, rows)).collect()
    assert [(r.image_id, r.x, r.y, r.degree) for r in found] == [(7, 62, 5, 4)]


def test_closed_curves_by_gap(spark):
    almost = RING[:-1]  # one pixel is missing
    rows = [(1, *p) for p in almost] + [(2, *p) for p in SPIRAL] + [(3, *p) for p in RING]
    got = {r.image_id: r for r in chains.closing(chains.trace(table_of(spark, rows))).collect()}
    assert got[1].closed and got[1].fills == 0 or got[1].fills == 1
    assert not got[2].closed and got[3].closed and got[3].n == 8


def test_tables_without_pixels(spark):
    empty = table_of(spark, [(1, 1, 1)]).where("false")
    assert chains.trace(empty).collect() == []
    assert watershed.watershed(spark.createDataFrame([(1, 1, 1, 5)], "image_id long, x int, y int, v int").where("false")).collect() == []
    assert packing.packed(spark.createDataFrame([(1, 1, 1, 5)], "image_id long, id long, x int, y int").where("false"), 3).collect() == []


# Watershed ---------------------------------------------------------------------------------------------------


def plain_watershed(points):
    """labels by spreading every minimum upwards; points: (x, y) -> v."""
    near = lambda p: [q for d in chains.AROUND if (q := (p[0] + d[0], p[1] + d[1])) in points]
    dist = {p: 1 for p in points if any(points[q] < points[p] for q in near(p))}
    front = list(dist)
    while front:
        new = []
        for p in front:
            for q in near(p):
                if points[q] == points[p] and q not in dist:
                    dist[q] = dist[p] + 1
                    new.append(q)
        front = new
    reach = {p: set() for p in points}
    for p in points:
        if p not in dist:
            flat, todo = {p}, [p]
            while todo:
                for q in near(todo.pop()):
                    if q not in flat and points[q] == points[p]:
                        flat.add(q)
                        todo.append(q)
            reach[p] = {min(y * SHIFT + x for x, y in flat)}
    for p in sorted(points, key=lambda p: (points[p], dist.get(p, 0))):
        if p in dist:
            below = [q for q in near(p) if (points[q], dist.get(q, 0)) < (points[p], dist[p])]
            reach[p] = set().union(*(reach[q] for q in below))
    return {p: (dist.get(p, 0), 0 if len(r) > 1 else min(r), len(r) > 1) for p, r in reach.items()}


def test_watershed_against_spreading(spark):
    draw = random.Random(3)
    images = {k: {(x, y): draw.randint(0, 3) for x in range(14) for y in range(11) if draw.random() < 0.85} for k in range(3)}
    images[9] = {(x, y): abs(x - 10) // 3 for x in range(21) for y in range(4)}  # plateaus down to one valley
    images[10] = {(x, 0): v for x, v in enumerate([1, 2, 3, 2, 0])}
    rows = [(k, x, y, v) for k, points in images.items() for (x, y), v in points.items()]
    got = watershed.watershed(table_of(spark, rows, "image_id long, x int, y int, v int")).collect()
    assert len(got) == len(rows)
    want = {(k, *p): w for k, points in images.items() for p, w in plain_watershed(points).items()}
    assert {(r.image_id, r.x, r.y): (r.dist, r.label, r.ridge) for r in got} == want
    assert [want[10, x, 0][2] for x in range(5)] == [False, False, True, False, False]


# Packing -----------------------------------------------------------------------------------------------------


def test_packing_is_maximal_and_greedy(spark):
    draw = random.Random(8)
    points = [(s, k, draw.randint(0, 40), draw.randint(0, 40)) for s in (1, 2) for k in range(300)]
    got = packing.packed(table_of(spark, points, "image_id long, id long, x int, y int"), 5).collect()
    for s in (1, 2):
        mine = {k: (x, y) for i, k, x, y in points if i == s}
        near = lambda a, b: (mine[a][0] - mine[b][0]) ** 2 + (mine[a][1] - mine[b][1]) ** 2 < 25  # noqa: B023, E731
        chosen = []
        for k in sorted(mine, key=lambda k: (hashlib.md5(f"{s}:{k}".encode()).hexdigest(), k)):  # noqa: B023
            if not any(near(k, c) for c in chosen):
                chosen.append(k)
        assert sorted(r.id for r in got if r.image_id == s) == sorted(chosen)


# Merging -----------------------------------------------------------------------------------------------------


def test_spanning_forest_and_cut(spark):
    draw = random.Random(2)
    edges = [(i, a, b, float(draw.randint(1, 9))) for i in (1, 2) for a, b in itertools.combinations(range(30), 2) if draw.random() < (0.12 if i == 1 else 0.04)]
    forest, found = merging.spanning_forest(spark.createDataFrame(edges, "image_id long, a int, b int, weight double"))
    got, root = {(r.image_id, r.a, r.b) for r in forest.collect()}, {(r.image_id, r.label): r.merged for r in found.collect()}
    for i in (1, 2):
        name, want = list(range(30)), set()
        for _, a, b in sorted((w, a, b) for j, a, b, w in edges if j == i):
            if name[a] != name[b]:
                want.add((i, a, b))
                name = [min(name[a], name[b]) if x in (name[a], name[b]) else x for x in name]
        assert {e for e in got if e[0] == i} == want
        assert all(root[i, k] == min(j for j in range(30) if name[j] == name[k]) for k in range(30) if (i, k) in root)
    nodes = spark.createDataFrame([(1, k) for k in range(31)], "image_id long, label int")
    alone = {r.label: r.merged for r in merging.merged(nodes, spark.createDataFrame([(1, 3, 9, 1.0), (1, 9, 12, 7.0)], "image_id long, a int, b int, weight double"), 5.0).collect()}
    assert alone[9] == 3 and alone[12] == 12 and alone[30] == 30


# Objects -----------------------------------------------------------------------------------------------------


def turned(x, y, q):
    for _ in range(q):
        x, y = -y, x
    return x, y


@pytest.mark.parametrize("turn", range(4))
def test_planted_object_is_located(spark, turn):
    draw = random.Random(turn)
    template = {(x, y): draw.randint(0, 255) for x in range(30) for y in range(30)}
    scene = {(x, y): draw.randint(0, 255) for x in range(70) for y in range(60)}
    at = (50, 45) if turn == 2 else (50, 8) if turn == 1 else (9, 45) if turn == 3 else (9, 8)
    for (x, y), v in template.items():
        dx, dy = turned(x, y, turn)
        scene[dx + at[0], dy + at[1]] = v
    of = lambda i, image: spark.createDataFrame([(i, x, y, v) for (x, y), v in image.items() if x >= 0 and y >= 0], "image_id long, x int, y int, v int")
    t = objects.features(of(5, template)).selectExpr("*", "0 AS level")
    found = objects.matches(t, objects.features(of(9, scene)))
    (r,) = objects.located(found).collect()
    assert (r.template, r.scene, r.turn, r.dx, r.dy) == (5, 9, turn, *at) and r.inliers >= 10
    other = objects.located(objects.matches(t, objects.features(of(9, {p: draw.randint(0, 255) for p in scene})))).collect()
    assert other == []
    rows = lambda f: [(r.image_id, r.x, r.y, r.side, r.code) for r in f.collect()]
    a, b = rows(objects.features(of(5, template))), rows(objects.features(of(9, scene)))
    want = sum((x[4] ^ y[4]).bit_count() <= objects.MOST for x in a for y in b)
    assert found.count() == want


def test_watershed_broadcasts_nothing(spark, monkeypatch):
    """Tables of a round's pixels aren't gathered in the driver, however few they are."""
    plans, cut = [], watershed.cut_lineage

    def recorded(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(watershed, "cut_lineage", recorded)
    rows = [(k, x, y, (x * 7 + y * 5 + k) % 4) for k in range(2) for x in range(6) for y in range(6)]
    made = watershed.watershed(table_of(spark, rows, "image_id long, x int, y int, v int"))
    made.collect()
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not [p for p in plans if "BroadcastExchange" in p]


def test_packing_keeps_each_pair_once(spark, monkeypatch):
    kept = []
    real = packing.cut_lineage
    monkeypatch.setattr(packing, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    packing.packed(table_of(spark, [(1, k, k, 0) for k in range(12)], "image_id long, id long, x int, y int"), 3)
    pairs = [{(r.p, r.q) for r in df.collect()} for df in kept if {"p", "q"} <= set(df.columns)]
    assert pairs[0] and all((q, p) not in found for found in pairs for p, q in found)
