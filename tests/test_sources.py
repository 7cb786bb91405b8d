import numpy as np

from lumenframe.sources import images


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (5, 7, 3))
    rows = [(1, x, y, *map(int, a[y, x])) for y in range(5) for x in range(7)]
    df = spark.createDataFrame(rows, images.PIXEL_SCHEMA)
    made = images.to_png(df).first()
    (tmp_path / "one.png").write_bytes(made.png)
    (tmp_path / "bad.png").write_bytes(b"no image")
    back = images.to_pixels(images.read_images(spark, str(tmp_path))).collect()
    assert {(r.x, r.y, r.r, r.g, r.b) for r in back} == {r[1:] for r in rows}
    grey = {(r.x, r.y): r.v for r in images.grey(df, "mean").collect()}
    assert all(grey[x, y] == int(a[y, x].sum()) // 3 for y in range(5) for x in range(7))


def test_drawing(spark):
    base = spark.createDataFrame([(1, x, y, 9, 9, 9) for x in range(6) for y in range(6)], images.PIXEL_SCHEMA)
    seg = spark.createDataFrame([(1, 3, 0, 0, 4, 2)], "image_id long, line_id int, x0 int, y0 int, x1 int, y1 int")
    line = images.lines(seg)
    assert {(r.x, r.y) for r in line.collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)}
    marks = line.select("image_id", "x", "y", *images.palette("line_id"))
    out = {(r.x, r.y): (r.r, r.g, r.b) for r in images.overlay(base, marks).collect()}
    assert out[2, 1] == (255, 255, 0) and out[5, 5] == (9, 9, 9) and len(out) == 36


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1.5,2\n3,4\n")
    assert [(r.x, r.y) for r in images.read_curves(spark, str(tmp_path / "c.csv")).collect()] == [(1.5, 2), (3, 4)]
    (tmp_path / "s.seg").write_text("width 4\nheight 2\ndata\n0 0 0 1\n1 0 2 3\n")
    assert [tuple(r)[1:] for r in images.read_segments(spark, str(tmp_path / "s.seg")).collect()] == [(0, 0, 0, 1), (1, 0, 2, 3)]
