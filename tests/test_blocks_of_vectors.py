"""Nearest vectors by blocks that meet as matrices: brute force, odd vectors, and how little is paired."""

import math

import numpy as np
import pytest

from lumenframe.operators import descriptors, vector_index


def plain(rows, queries, k, measure):
    """The k nearest by sums in order; pairs that can't be compared come first, those that aren't numbers last."""
    out = []
    for q, w in queries:
        listed = []
        for b, v in rows:
            if b == q:
                continue
            whole = v is not None and w is not None and len(v) == len(w) and None not in v and None not in w
            d = None
            if whole and measure == "l2":
                d = sum(float(x - y) * float(x - y) for x, y in zip(v, w))
            elif whole:
                dot = lambda s, t: sum(x * y for x, y in zip(s, t))
                size = math.sqrt(dot(v, v)) * math.sqrt(dot(w, w))
                d = -dot(v, w) / size if size else None
            listed.append((0 if d is None else 2 if math.isnan(d) else 1, 0 if d is None or math.isnan(d) else d, b))
        out += [(q, b, n + 1) for n, (_, _, b) in enumerate(sorted(listed)[:k])]
    return sorted(out)


@pytest.mark.parametrize("measure", ["l2", "cosine"])
@pytest.mark.parametrize("size", [(4096, 512), (7, 3)])
def test_blocks_against_brute_force(spark, monkeypatch, measure, size):
    monkeypatch.setattr(descriptors, "BASE_BLOCK", size[0])
    monkeypatch.setattr(descriptors, "QUERY_BLOCK", size[1])
    draw = np.random.default_rng(3)
    rows = [(k, draw.integers(-3, 4, 5).astype(float).tolist()) for k in range(200)]  # many ties
    rows += [(300 + k, [float(x) for x in draw.normal(0, 1, 5)]) for k in range(100)]
    odd = [(500, [1.0, None, 0.0, 0.0, 1.0]), (510, [1.0, 2.0]), (520, None), (530, [0.0] * 5), (540, [math.inf, 0.0, 0.0, 0.0, 1.0]), (550, [])]
    for given in (rows, rows + odd):
        df = spark.createDataFrame(given, "bid long, bv array<double>").repartition(3)
        asked = [r for r in given if r[0] % 10 == 0]
        got = descriptors.block_neighbours(df.where("bid % 10 = 0").selectExpr("bid AS qid", "bv AS qv"), df, 4, measure)
        assert sorted((r.qid, r.bid, r.k) for r in got.collect()) == plain(given, asked, 4, measure)


def test_searches_pair_blocks_not_rows(spark, monkeypatch):
    """4,000 rows and 400 queries make 1.6 million pairs of rows."""
    seen, meet = [0], descriptors.met

    def counted(pairs, *rest):
        seen[0] += pairs.count()
        return meet(pairs, *rest)

    for module in (descriptors, vector_index):
        monkeypatch.setattr(module, "met", counted)
    draw = np.random.default_rng(5)
    rows = [(k, k, v.tolist()) for k, v in enumerate(draw.normal(0, 1, (4000, 8)))]
    df = spark.createDataFrame(rows, "id long, grp long, vector array<double>").repartition(2)
    asked = df.where("id % 10 = 0")
    near = descriptors.block_neighbours(asked.selectExpr("id AS qid", "vector AS qv"), df.selectExpr("id AS bid", "vector AS bv"), 3)
    flat = sorted((r.qid, r.bid, r.d) for r in near.collect())
    assert 0 < seen[0] < 100
    seen[0] = 0
    index = vector_index.build(df, vector_index.fit(df, cells=16))
    assert sorted((r.qid, r.id, r.d2) for r in vector_index.nearest(index, asked, 3).collect()) == flat
    assert 0 < seen[0] < 300


def test_index_ties_of_struct_ids_and_groups_without_a_name(spark):
    rows = [((k % 5, k // 5), None if k % 3 == 0 else k % 3, [float(k % 2), 1.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "id struct<a:long, b:int>, grp long, vector array<double>").repartition(3)
    index = vector_index.build(df, vector_index.fit(df), share=4)
    got = [(tuple(r.qid), r.k, tuple(r.id), r.d2) for r in vector_index.nearest(index, df, 6).collect()]
    want = []
    for i, g, v in rows:
        near = sorted(((v[0] - w[0]) ** 2, j) for j, h, w in rows if h != g)[:6]
        want += [(i, n + 1, j, d) for n, (d, j) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_queries_are_not_written_once_a_cell(spark, monkeypatch):
    """Beyond the nearest cells a block of queries says which cells its queries want; rows near a border of cells are found."""
    rng = np.random.default_rng(9)
    rows = [(i, i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))]
    df = spark.createDataFrame(rows, "id long, grp long, vector array<double>")
    made, blocks = [], vector_index.blocks
    monkeypatch.setattr(vector_index, "blocks", lambda d, keys, columns, *rest: made.append((columns, d)) or blocks(d, keys, columns, *rest))
    quick, whole = vector_index.searched(vector_index.build(df, vector_index.fit(df, cells=16)), df.where("id < 40"), 5, 2)
    vectors = np.array([v for *_, v in rows])
    order = lambda i: sorted((float(((vectors[i] - w) ** 2).sum()), j) for j, w in enumerate(vectors) if j != i)[:5]
    assert {(r.qid, r.k, r.id) for r in whole.collect()} == {(i, n + 1, j) for i in range(40) for n, (_, j) in enumerate(order(i))}
    assert quick.count() <= 200
    asked = [d.count() for columns, d in made if "wants" in columns]
    assert len(asked) == 1 and 0 < asked[0] <= 40
