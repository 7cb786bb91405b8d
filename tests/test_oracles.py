"""Some registered queries against their SQL; the driver holds all of them."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["hist_equalize", "threshold_otsu", "color_delta_e2000", "window_box_mean", "morph_opening", "filter_gaussian_blur", "corner_harris", "series_running_median", "join_radius", "knn_l2", "graph_connected_8", "camera_projection"]
NAMES += ["io_png_round_trip", "io_curve_lines", "io_dashed_lines", "rotation_slerp", "epipolar_essential", "view_planar_calibration", "view_essential_pose", "matrix_gram", "join_closest_pair"]
NAMES += ["threshold_otsu_2d", "gradient_delta_e2000", "wavelet_median_pyramid", "region_holes", "matrix_multiply", "transform_similar_groups"]

NAMES += ["knn_index", "edge_curves", "edge_closed_curves", "watershed_of_points", "object_locations", "corner_scale_tracks", "fit_robust_parabola", "packing_of_intersection", "label_merge_least_gradient"]
NAMES += ["matrix_eigen_values", "cluster_vectors_round", "region_block_histograms", "reconstruct_affine_views", "graph_connected_values", "bits_reversed", "kernel_tables", "trig_tables"]


def canonical(rows):
    return sorted(tuple(f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("orders", "events", "part", "embeddings", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert canonical(got.select(*columns).collect()) == canonical(want)
