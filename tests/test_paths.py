"""Paths, schedules and captures: properties that hold for any input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import paths
from spindrift.sources.datasets import open_capture


def test_monotone_cubic_never_overshoots():
    x = np.array([0.0, 1.0, 1.5, 4.0, 5.0])
    y = np.array([0.0, 1.0, 1.0, 7.0, 6.0])
    at = np.linspace(0, 5, 501)
    v = paths.hermite(x, y, paths.monotone_slopes(x, y), at)
    assert np.allclose(paths.hermite(x, y, paths.monotone_slopes(x, y), x), y)
    assert (np.diff(v[at <= 4]) >= -1e-12).all() and v.max() <= 7 + 1e-12


def test_path_meets_its_key_frames(spark):
    rows = [("p", i, 1.0, [float(i), float(i * i), 0.0], [1.0, 0.2 * i, 0.0, 0.0], 0.5 + i) for i in range(4)] + [("q", 0, 1.0, [1.0, 2.0, 3.0], [1.0, 0.0, 0.0, 0.0], 0.7)]
    k = spark.createDataFrame(rows, "path string, idx int, seconds double, position array<double>, wxyz array<double>, fov double")
    out = {(r.path, r.frame): r for r in paths.interpolate_path(k, 2.0).collect()}
    for i in range(3):
        r = out["p", 2 * i]
        assert r.position == pytest.approx([i, i * i, 0]) and r.fov == pytest.approx(0.5 + i)
        assert np.linalg.norm(r.wxyz) == pytest.approx(1)
    assert out["q", 0].position == [1, 2, 3] and len([1 for p, _ in out if p == "q"]) == 1


def test_random_quaternions_are_units(spark):
    q = paths.random_unit_quaternions(spark.range(500), "id", 3)
    norms = q.select(F.aggregate("wxyz", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms) and q.select("wxyz").distinct().count() == 500


def test_resolution_ladder():
    assert paths.resolution_ladder(512, 1024) == [(256, 512), (360, 728), (512, 1024)]
    assert paths.resolution_ladder(100, 100) == [(104, 104)] * 3


def test_camera_axes_find_the_plane(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(200, 3)) * [5, 2, 0]
    r = paths.camera_axes(spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double"), ["x", "y", "z"]).first()
    axes = np.reshape(r.axes, (3, 3))
    assert np.linalg.det(axes) == pytest.approx(1) and abs(axes[2, 2]) == pytest.approx(1) and axes[0, 0] > 0.9


def test_capture_lifts_its_tracks(spark, tmp_path):
    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    cams = [("s", f, 10.0, 10.0, 1.0, 1.0, [float(v) for v in eye], [float(v) for v in eye]) for f in range(1, 4)]
    spark.createDataFrame(cams, "seq string, frame int, fx double, fy double, cx double, cy double, w2c array<double>, c2w array<double>").write.parquet(f"{tmp_path}/camera")
    frames = [("s", f, 3, 3, [2.0] * 9, [1.0] * 8 + [0.0]) for f in range(1, 4)]
    spark.createDataFrame(frames, "seq string, frame int, h int, w int, depth array<double>, mask array<double>").write.parquet(f"{tmp_path}/frame")
    obs = [("s", 1, t, p, float(p), 1.0, -9.0, -9.0) for t in range(1, 4) for p in range(2)]
    spark.createDataFrame(obs, "seq string, query_t int, target_t int, point_id long, x double, y double, occ_logit double, dist_logit double").write.parquet(f"{tmp_path}/track2d")
    c = open_capture(spark, "parquet", str(tmp_path), start=1)
    got = {(r.point_id, r.target_t): (r.x, r.y, r.z, r.visible) for r in c.tracks_3d().collect()}
    assert got[0, 2] == pytest.approx((-0.2, 0.0, 2.0, True)) and got[1, 0] == pytest.approx((0.0, 0.0, 2.0, True)) and c.length == 3
    assert [(r.frame, r.point_id) for r in c.background(5).where("frame = 0").collect()] == [(0, 8)]
    assert c.keypoints().count() == 0 and c.normaliser().first().scale == pytest.approx(0.1)
    with pytest.raises(ValueError):
        open_capture(spark, "tape", str(tmp_path))


def test_background_that_earlier_frames_cover_is_left_out(spark):
    from spindrift.operators.scene import uncovered_background

    eye = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    moved = [1.0, 0, 0, -8, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    frames = spark.createDataFrame([("s", f, 16, 16, [2.0] * 256, [-1.0] * 256) for f in range(3)], "seq string, frame int, h int, w int, depth array<double>, mask array<double>")
    cams = spark.createDataFrame([("s", 0, 10.0, 10.0, 8.0, 8.0, [float(v) for v in eye]), ("s", 1, 10.0, 10.0, 8.0, 8.0, [float(v) for v in eye]), ("s", 2, 10.0, 10.0, 8.0, 8.0, [float(v) for v in moved])], "seq string, frame int, fx double, fy double, cx double, cy double, w2c array<double>")
    counts = {r.frame: r["count"] for r in uncovered_background(frames, cams, least=64, by=2).groupBy("frame").count().collect()}
    assert counts == {0: 128, 2: 128}  # frame 1 sees what frame 0 saw; frame 2 looks elsewhere


def test_camera_axes_are_principal(spark):
    """Against numpy on the same rows: the mean, and axes of falling spread that are orthonormal."""
    from spindrift.operators.paths import camera_axes

    rng = np.random.default_rng(4)
    points = rng.normal(size=(80, 3)) @ np.diag([5.0, 2.0, 0.5]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + [1.0, 2.0, 3.0]
    r = camera_axes(spark.createDataFrame(points.tolist(), "x double, y double, z double"), ["x", "y", "z"]).first()
    axes = np.reshape(r.axes, (3, 3))
    assert np.allclose(r["mean"], points.mean(0)) and np.allclose(axes @ axes.T, np.eye(3)) and np.linalg.det(axes) > 0
    _, _, vt = np.linalg.svd(points - points.mean(0))
    assert np.allclose(np.abs((axes * vt).sum(1)), 1)


def test_clusters_and_colours_follow_their_rules(spark):
    """Every row is nearest to its own cluster's mean; colours are scaled projections on the first principal directions."""
    from spindrift.operators.fits import kmeans, principal_colours

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(30, 5)) + c for c in (0.0, 9.0, -9.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    label = np.array([r.label for r in sorted(kmeans(df, "id", "f", 3).collect())])
    centres = np.stack([x[label == k].mean(0) for k in range(3)])
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == label).all()
    got = np.array([r.colour for r in sorted(principal_colours(df, "id", "f").collect())])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    p = (x - x.mean(0)) @ vt[:3].T
    p = (p - p.min(0)) / (p.max(0) - p.min(0))
    for i in range(3):
        assert np.allclose(got[:, i], p[:, i], atol=1e-6) or np.allclose(got[:, i], 1 - p[:, i], atol=1e-6)
