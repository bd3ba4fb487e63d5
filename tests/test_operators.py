"""Hand-computed cases, and properties that hold for any input."""

import math
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import geometry as g
from spindrift.functions import images, stats
from spindrift.functions.raster import bilinear
from spindrift.operators import fits, losses, memory, metrics, quantiles, rasters, robust, sampling, scene, tracks
from spindrift.sources import colmap, datasets, files, sinks


def one(df):
    return df.first()


def test_visibility(spark):
    df = spark.createDataFrame([(-4.0, -4.0), (4.0, -4.0), (0.0, 0.0)], "o double, d double")
    got = [(r.visible, r.invisible, round(r.confidence, 4)) for r in tracks.decode_visibility(df, F.col("o"), F.col("d")).collect()]
    assert got == [(True, False, 0.982), (False, True, 0.982), (False, False, 0.0)]


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    r = one(df.agg(stats.quantile(F.col("x"), 0.95).alias("q"), stats.lower_median("x").alias("low"), stats.median(F.col("x")).alias("mid")))
    assert (round(r.q, 10), r.low, r.mid) == (3.85, 2.0, 2.5)
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [1e9, -1e9]])
    big = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    for q in (0.0, 0.31, 0.5, 0.999, 1.0):
        assert robust.exact_quantile(big, "x", q) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert robust.exact_quantile(big.limit(0), "x", 0.5) is None


def test_losses(spark):
    df = spark.createDataFrame([(float(i), 0.0, m) for i, m in zip((1, 2, 3, 4), (1.0, 1.0, 0.0, 0.0), strict=True)], "p double, t double, m double")
    assert one(losses.masked_l1(df, "p", "t")).loss == 2.0  # the comparison is strict: the largest goes
    assert one(losses.masked_l1(df, "p", "t", F.col("m"))).loss == pytest.approx(3 / (2 + 1e-8))
    same = df.withColumn("p", F.lit(1.0))
    assert one(losses.masked_l1(same, "p", "t", None, 0.9)).loss is None
    h = spark.createDataFrame([(0.5, 0.0), (3.0, 0.0)], "p double, t double")
    assert one(losses.masked_huber(h, "p", "t", 1.0, F.lit(1.0))).loss == pytest.approx((0.125 + 2.5) / (2 + 1e-8))


def test_acceleration_and_interpolation(spark):
    df = spark.createDataFrame([(1, t, float(t * t), t in (0, 3)) for t in range(4)], "track_id int, t int, x double, visible boolean")
    assert one(tracks.accel_loss(df, ["x"], ["track_id"])).loss == 2.0
    v = spark.createDataFrame([(1, t, x, s) for t, (x, s) in enumerate([(10.0, True), (0.0, False), (0.0, False), (40.0, True), (0.0, False)])] + [(2, 0, 5.0, False)], "track_id int, t int, x double, visible boolean")
    out = {(r.track_id, r.t): r.filled for r in tracks.interpolate_masked(v, "x", "visible").collect()}
    assert [out[1, t] for t in range(5)] == [10, 20, 30, 40, 40] and out[2, 0] is None


def test_pinhole_round_trip(spark):
    eye = g.rigid([F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)], [F.lit(0.0)] * 3)
    k = [F.lit(x) for x in (100.0, 100.0, 50.0, 50.0)]
    px = g.project([F.lit(1.0), F.lit(2.0), F.lit(4.0)], eye, k)
    back = g.unproject(px[0], px[1], px[2], eye, k)
    r = one(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate([*px, *back]))))
    assert tuple(r) == (75.0, 100.0, 4.0, 1.0, 2.0, 4.0)


def test_rotations(spark):
    r = one(spark.range(1).select(g.pack(g.rot6_to_matrix([F.lit(float(x)) for x in (2, 0, 0, 1, 3, 0)])).alias("m")))
    assert r.m == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    df = spark.createDataFrame([tuple(float(x) for x in q) for q in np.random.default_rng(1).normal(size=(50, 4))] + [(0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0)], "w double, x double, y double, z double")
    df, q = g.hold(df, "q", g.unit([F.col(c) for c in "wxyz"]))
    df, m = g.hold(df, "m", g.quat_to_matrix(q))
    df, b = g.hold(df, "b", g.matrix_to_quat(m))
    df, c = g.hold(df, "c", g.quat_product(q, [q[0], -q[1], -q[2], -q[3]]))
    for r in df.select(F.abs(g.dot(q, b)).alias("same"), g.dot(m[:3], m[3:6]).alias("off"), g.pack(c).alias("unit")).collect():
        assert r.same == pytest.approx(1) and r.off == pytest.approx(0, abs=1e-12) and r.unit == pytest.approx([1, 0, 0, 0])


def test_bilinear(spark):
    df = spark.range(1).select(F.array(*(F.lit(float(x)) for x in range(4))).alias("r"))
    at = lambda x, y, o=None: bilinear(F.col("r"), F.lit(x), F.lit(y), F.lit(2), F.lit(2), o)
    assert tuple(one(df.select(at(0.5, 0.5), at(9.0, 9.0), at(1.5, 1.0, 0.0)))) == (1.5, 3.0, 1.5)


def test_median_filter_mirrors(spark):
    frame = spark.createDataFrame([(1, 3, 3, [float(x) for x in range(9)])], "frame int, h int, w int, v array<double>")
    padded = np.pad(np.arange(9.0).reshape(3, 3), 1, "reflect")
    want = [float(np.sort(padded[y : y + 3, x : x + 3].reshape(-1))[4]) for y in range(3) for x in range(3)]
    assert one(rasters.median_filter(frame, "v", 3)).filtered == want


def test_psnr_and_jaccard(spark):
    px = spark.createDataFrame([(1, 0.1)], "image int, e double")
    assert one(metrics.psnr(px, ["image"], [F.col("e")] * 3, F.lit(1.0))).psnr == pytest.approx(20)
    pts = spark.createDataFrame([(0.0, True, True), (99.0 * 99, True, True), (0.0, True, False), (0.0, False, True)], "sq double, v boolean, p boolean").withColumn("ok", F.lit(True))
    r = one(metrics.jaccard(pts, "sq", "v", "p", "ok", (4.0,)))
    assert (r.jaccard, r.occlusion_accuracy) == (0.2, 0.5)


def test_ssim_of_equal_images_is_one(spark):
    v = [float(x % 7) / 7 for x in range(144)]
    df = spark.createDataFrame([(1, 12, 12, v, v, [1.0] * 144), (2, 3, 3, v[:9], v[:9], [1.0] * 9)], "frame long, h int, w int, pred array<double>, target array<double>, mask array<double>")
    got = {r.frame: r.ssim for r in metrics.ssim(df).collect()}
    assert got[1] == pytest.approx(1) and (got[2] is None or math.isnan(got[2]))


def test_sampling(spark):
    df = spark.createDataFrame([(f, f * 100 + i) for f in range(3) for i in range(20)], "frame int, id int")
    sizes = {r.frame: r["count"] for r in sampling.quota_sample(df, "frame", "id", 10).groupBy("frame").count().collect()}
    assert sizes == {0: 3, 1: 3, 2: 4}
    rows = spark.createDataFrame([(i, 0.0, i < 3, 3 <= i < 5) for i in range(10)], "id int, s double, split boolean, dup boolean")
    out = sampling.densify(rows, F.col("split"), F.col("dup"), ["s"])
    assert out.count() == 15 and {round(r.s, 6) for r in out.where("copy >= 2").collect()} == {round(-math.log(1.6), 6)}
    with pytest.raises(Exception, match="no match"):
        sampling.require_matches(rows, rows.where("id > 3").select("id"), ["id"]).collect()


def test_memory(spark):
    m = spark.createDataFrame([("a", i, u, 1.0) for i, u in enumerate((1.0, 1.0, 1.0, 5.0))], "grp string, elem int, use double, life double")
    assert [r.elem for r in memory.evict_least_used(m, "grp", "use", "life", 3).collect()] == [3]  # ties go together
    assert memory.evict_least_used(m, "grp", "use", "life", 4).count() == 4
    assert sorted(r.elem for r in memory.sieve(m, "grp", "elem", 1, 0).collect()) == [0]


def test_procrustes_finds_the_motion(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rot = q * np.sign(np.linalg.det(q))
    x = rng.normal(size=(30, 3))
    y = 1.7 * (x @ rot.T + np.array([1.0, -2.0, 3.0]))
    df = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(x, y, strict=True)], "k int, x double, y double, z double, tx double, ty double, tz double")
    fit = fits.procrustes(df, ["k"])
    r = one(fit)
    assert r.scale == pytest.approx(1.7) and np.allclose(np.reshape(r.rot, (3, 3)), rot) and np.allclose(r.transl, [1, -2, 3])
    assert one(fits.aligned(df, fit, ["k"]).agg(F.max("residual"))).__getitem__(0) < 1e-9


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(3, 2)) + 50])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double")
    got = {(r.id, r["rank"]): r.distance for r in fits.nearest_neighbours(df, "id", ["x", "y"], 3, 0.3).collect()}
    for i in range(len(p)):
        want = np.sort(np.linalg.norm(p - p[i], axis=1))[1:4]
        assert [got[i, k] for k in (1, 2, 3)] == pytest.approx(want.tolist())


def _brute(ids, p, k):
    """id -> its k nearest (distance, id), NaN being the farthest."""
    out = {}
    for i, x in zip(ids.tolist(), p, strict=True):
        with np.errstate(invalid="ignore", over="ignore"):
            gap = x - p
            d = np.sqrt(np.square(gap).T.cumsum(axis=0)[-1])
        other = ids != i
        sort = np.lexsort((ids[other], d[other]))[:k]
        out[i] = list(zip(d[other][sort].tolist(), ids[other][sort].tolist(), strict=True))
    return out


def _nearest(spark, ids, p, k):
    df = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(ids, p, strict=True)], ["id", *"xyz"[: p.shape[1]]])
    out = {}
    for r in sorted(fits.nearest_neighbours(df, "id", list("xyz"[: p.shape[1]]), k, 0.3).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.id, []).append((r.distance, r.neighbour))
    return out


def test_neighbours_over_many_boxes(spark, monkeypatch):
    monkeypatch.setattr("spindrift.operators.neighbours.BOX", 40)
    rng = np.random.default_rng(5)
    hot = rng.normal(size=(300, 2))
    hot[:200] = 0
    far = np.concatenate([rng.normal(size=(300, 1)), [[1e9], [-1e200]]])
    odd = rng.normal(size=(300, 3))
    odd[3], odd[4, 1], odd[5, 1], odd[6, 2] = np.nan, np.inf, np.inf, -np.inf
    for p in (rng.integers(0, 5, size=(300, 3)) * 1.0, np.repeat(rng.normal(size=(12, 3)), 25, axis=0), hot, far, odd, odd[:5], rng.normal(size=(3, 2))):
        ids = rng.permutation(len(p))
        got, want = _nearest(spark, ids, p, 3), _brute(ids, p, 3)
        assert {i: repr(v) for i, v in got.items()} == {i: repr(v) for i, v in want.items()}


def test_neighbours_in_a_dense_cell(spark):
    """All points lie in a few cells of the grid that was asked for: comparing all pairs of them takes minutes."""
    p = np.random.default_rng(6).normal(size=(30_000, 3)) / 20
    began = time.monotonic()
    got = _nearest(spark, np.arange(len(p)), p, 3)
    assert time.monotonic() - began < 45 and len(got) == len(p)
    for i in range(0, len(p), 999):
        assert [d for d, _ in got[i]] == pytest.approx(np.sort(np.linalg.norm(p - p[i], axis=1))[1:4].tolist())


def test_neighbours_shuffle_in_proportion(spark):
    """A dense cell's pairs are never exchanged: by grid cells 2,000 points wrote over 600 bytes each."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    p = np.random.default_rng(6).normal(size=(2_000, 3)) / 20
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], ["id", *"xyz"])
    before = written()
    assert fits.neighbour_scale(df, "id", list("xyz"), 0.05).where("mean_distance > 0").count() == len(p)
    assert 0 < written() - before < 300 * len(p)


def test_motion_carries_over_weak_frames(spark):
    pts = np.random.default_rng(4).normal(size=(12, 3))
    rows = [(n, t, *(float(v) for v in p + [t, 0, 0]), 0.0 if t == 3 else 1.0) for n, p in enumerate(pts) for t in range(5)]
    obs = spark.createDataFrame(rows, "track_id int, t int, x double, y double, z double, confidence double")
    labels = spark.createDataFrame([(n, 0) for n in range(12)], "track_id int, label int")
    out = {r.t: r.transl for r in fits.motion_bases(obs, labels, 1, 5).collect()}
    assert [round(out[t][0], 6) for t in range(5)] == [-1, 0, 1, 1, 3]


def test_trajectories_look_at_the_target(spark):
    for kind in ("arc", "lemniscate", "spiral", "wander"):
        t = scene.trajectory(spark, kind, 7, (1.0, 0.5, -4.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0))
        x, y, z = g.apply_rigid(g.unpack(F.col("w2c"), 16), [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
        for r in t.select(x.alias("x"), y.alias("y"), z.alias("z")).collect():
            assert abs(r.x) < 1e-9 and abs(r.y) < 1e-9 and r.z > 0


def test_colmap_binary_and_text_agree(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 500, 510, 320, 240) + struct.pack("<iiQQ3d", 2, 0, 64, 48, 50, 32, 24))
    image = struct.pack("<i7di", 7, 1, 0, 0, 0, 1, 2, 3, 1) + b"a.png\0" + struct.pack("<Q", 2) + struct.pack("<ddqddq", 1.5, 2.5, 9, 3.5, 4.5, -1)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 1) + image)
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<QdddBBBdQii", 9, 1, 2, 3, 10, 20, 30, 0.5, 1, 7, 0))
    (tmp_path / "cameras.txt").write_text("# cameras\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_PINHOLE 64 48 50 32 24\n")
    (tmp_path / "images.txt").write_text("# images\n7 1 0 0 0 1 2 3 1 a.png\n1.5 2.5 9 3.5 4.5 -1\n")
    (tmp_path / "points3D.txt").write_text("# points\n9 1 2 3 10 20 30 0.5 7 0\n")
    long = {"bin": "binary", "txt": "text"}.get
    read = lambda kind: [f(spark, f"{tmp_path}/{n}.{kind}") for f, n in ((getattr(colmap, f"read_cameras_{long(kind)}"), "cameras"), (getattr(colmap, f"read_images_{long(kind)}"), "images"), (getattr(colmap, f"read_points_{long(kind)}"), "points3D"))]
    long = {"bin": "binary", "txt": "text"}.get
    binary, text = read("bin"), read("txt")
    for a, b in zip(binary, text, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    cam = one(colmap.camera_params(binary[1], binary[0]))
    assert (cam.fx, cam.fy, cam.cx, cam.cy, cam.w2c[3], cam.w2c[7], cam.w2c[11]) == (500, 510, 320, 240, 1, 2, 3)
    assert [(r.px, r.x) for r in colmap.visible_points(binary[1], binary[2]).collect()] == [(1.5, 1.0)]


def test_capture_files(spark, tmp_path):
    (tmp_path / "split.json").write_text('{"frame_names": ["a", "b", "c"], "time_ids": [3, 4, 5]}')
    assert sorted((r.frame_name, r.t) for r in files.read_split(spark, f"{tmp_path}/split.json", 4).collect()) == [("b", 0), ("c", 1)]
    (tmp_path / "cam.json").write_text('{"focal_length": 100, "principal_point": [50, 40], "orientation": [[1,0,0],[0,1,0],[0,0,1]], "position": [1, 2, 3]}')
    cam = one(files.read_json_cameras(spark, f"{tmp_path}/cam.json", 2.0))
    assert (cam.name, cam.fx, cam.cx, cam.w2c[3], cam.c2w[11]) == ("cam", 50, 25, -1, 3)
    (tmp_path / "traj.txt").write_text("0 1 0 0 0 0 0 1\n1 2 0 0 0 0 0 1\n2 4 0 0 0 0 0 1\n")
    assert [r.c2w[3] for r in files.read_trajectory(spark, f"{tmp_path}/traj.txt").orderBy("frame").collect()] == [-1, 0, 2]
    np.save(tmp_path / "d.npy", np.arange(12.0).reshape(3, 2, 2))
    rows = files.split_leading(files.read_arrays(spark, f"{tmp_path}/d.npy")).orderBy("frame").collect()
    assert [r["values"] for r in rows] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    np.savez(tmp_path / "k.npz", K=np.array([[[0.5, 0, 0.5], [0, 0.6, 0.5], [0, 0, 1]]]))
    k = one(files.intrinsics_vector(files.read_arrays(spark, f"{tmp_path}/k.npz", files.INTRINSIC_KEYS), 100, 50))
    assert tuple(k) == (50, 30, 50, 25)
    (tmp_path / "0_00012.json").write_text("[[1, 2, 1], [3, 4, 0]]")
    assert [tuple(r) for r in files.read_keypoints(spark, f"{tmp_path}/0_00012.json").orderBy("kp_id").collect()] == [(12, 0, 2, 4, True), (12, 1, 6, 8, False)]
    (tmp_path / "i.ppm").write_bytes(b"P5\n# c\n2 1\n255\n\x00\xff")
    assert one(files.read_images(spark, f"{tmp_path}/i.ppm", files.decode_pnm)).pixels == [0, 1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "query_t int, target_t int, x double")
    sinks.write_tracks(df, f"{tmp_path}/t")
    assert [r.x for r in sinks.read_tracks(spark, f"{tmp_path}/t", 0, [1]).collect()] == [2.0]
    sinks.save_checkpoint(spark, f"{tmp_path}/c", 5, {"a": df})
    step, tables = sinks.load_checkpoint(spark, f"{tmp_path}/c", ("a",))
    assert step == 5 and tables["a"].count() == 2
    with pytest.raises(KeyError):
        sinks.load_checkpoint(spark, f"{tmp_path}/c", ("b",))
    sinks.write_new(df, f"{tmp_path}/n", ["query_t"])
    sinks.write_new(df, f"{tmp_path}/n", ["query_t"])
    assert spark.read.parquet(f"{tmp_path}/n").count() == 2


def test_streams(spark, tmp_path):
    from spindrift.streaming.windows import time_windows

    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:00", "a", 1.0) for i in range(9)], "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = time_windows(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    out = []
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    q.awaitTermination()
    assert [r.n for r in out] == [3]  # the watermark, an hour before the last event, closes the first day alone


def test_bounded_memory(spark, tmp_path):
    from spindrift.streaming.windows import remember

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([(v, f, [float(f), 1.0]) for v in (1, 2) for f in range(12)], "video long, frame long, key array<double>")
    rows.write.parquet(f"{tmp_path}/in")
    out = []
    stream = remember(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), most=2, write_every=3)
    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    q.awaitTermination()
    assert len(out) == 24 and max(r.size for r in out) == 2 and min(r.size for r in out) == 1


def test_quantiles_by_key(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), float(v) ** 2) for k, n in ((None, 7), ("a", 1), ("b", 3000), ("c", 40)) for v in rng.normal(size=n)] + [("d", None, None), ("c", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = quantiles.quantile_values(df, {"lo": (F.col("x"), 0.05), "hi": (F.col("y"), 0.9)}, ["k"])
    low = quantiles.quantile_values(df, {"m": (F.col("x"), 0.5)}, ["k"], lower=True)
    for k in (None, "a", "b", "c"):
        x = np.array([r[1] for r in rows if r[0] == k and r[1] == r[1]])
        y = np.array([r[2] for r in rows if r[0] == k])
        assert got[(k,)]["lo"] == pytest.approx(np.quantile(x, 0.05)) and got[(k,)]["hi"] == pytest.approx(np.quantile(y, 0.9))
        assert low[(k,)]["m"] == np.sort(x)[(len(x) - 1) // 2]
    assert got[("d",)] == {"lo": None, "hi": None} and quantiles.quantile_values(df.limit(0), {"x": (F.col("x"), 0.5)}) == {}
    assert quantiles.quantile_table(df.limit(0), {"x": (F.col("x"), 0.5)}).first().x is None
    placed = {r.k: (r.n, r.value) for r in quantiles.ranked_values(df, F.col("x"), ["k"], lambda n: n - 3).collect()}
    assert placed["a"] == (1, None) and placed["c"][1] == sorted(r[1] for r in rows if r[0] == "c" and r[1] == r[1])[-3]


def test_similarity_of_noisy_points(spark):
    """Scale by the ratio of spreads, rotation by the decomposition, wherever the points are."""
    rng = np.random.default_rng(3)
    for shift in (0.0, 1e8):
        a = rng.normal(size=(200, 3))
        b = 1.7 * a @ np.linalg.qr(rng.normal(size=(3, 3)))[0].T + rng.normal(size=(200, 3)) * 0.8
        w = rng.random(200)
        rows = [(*map(float, p + shift), *map(float, t - shift), float(v)) for p, t, v in zip(a, b, w, strict=True)]
        got = one(fits.procrustes(spark.createDataFrame(rows, "x double, y double, z double, tx double, ty double, tz double, w double"), [], F.col("w")))
        v = w[:, None] / w.sum()
        x, y = a - (a * v).sum(0), b - (b * v).sum(0)
        u, _, vt = np.linalg.svd((v * y).T @ x)
        rot = u @ np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))]) @ vt
        assert got.scale == pytest.approx(np.sqrt((v * y * y).sum() / (v * x * x).sum()), rel=1e-5)
        assert np.allclose(np.reshape(got.rot, (3, 3)), rot, atol=1e-5)


def test_masked_similarity_is_the_formula(spark):
    """Window by window, in loops."""
    rng = np.random.default_rng(5)
    p, t, m = rng.random((9, 7)), rng.random((9, 7)), (rng.random((9, 7)) > 0.5).astype(float)
    k = np.exp(-0.5 * ((np.arange(3) - 1) / 1.5) ** 2)
    k /= k.sum()

    def blur(z):
        across = np.zeros((9, 5))
        known = np.zeros((9, 5))
        for y in range(9):
            for x in range(5):
                seen = m[y, x : x + 3].sum()
                across[y, x] = (z[y, x : x + 3] * m[y, x : x + 3] * k).sum() * 3 / seen if seen else 0
                known[y, x] = seen > 0
        out = np.zeros((7, 5))
        for y in range(7):
            for x in range(5):
                seen = known[y : y + 3, x].sum()
                out[y, x] = (across[y : y + 3, x] * k).sum() * 3 / seen if seen else 0
        return out

    a, b = blur(p), blur(t)
    va, vb = np.maximum(blur(p * p) - a * a, 0), np.maximum(blur(t * t) - b * b, 0)
    c = blur(p * t) - a * b
    c = np.sign(c) * np.minimum(np.abs(c), np.sqrt(va * vb))
    want = ((2 * a * b + 1e-4) * (2 * c + 9e-4) / ((a * a + b * b + 1e-4) * (va + vb + 9e-4))).mean()
    row = lambda i, h, w: (i, h, w, *(v[:h, :w].reshape(-1).tolist() for v in (p, t, m)))
    images = spark.createDataFrame([row(1, 9, 7), row(2, 2, 7)], "frame long, h int, w int, pred array<double>, target array<double>, mask array<double>")
    got = {r.frame: r.ssim for r in metrics.ssim(images, 3).collect()}
    assert got[1] == pytest.approx(want, rel=1e-9) and got[2] is None


def test_png_round_trip():
    rng = np.random.default_rng(6)
    for shape, kind in (((5, 7), np.uint8), ((3, 4, 3), np.uint8), ((6, 2, 4), np.uint16), ((1, 1, 2), np.uint8)):
        image = rng.integers(0, np.iinfo(kind).max, shape, endpoint=True).astype(kind)
        assert np.array_equal(images.decode_png(images.encode_png(image)), image.reshape(*shape[:2], -1))
    # every filter, undone by its definition
    line, above = rng.integers(0, 256, 12).astype(np.uint8), rng.integers(0, 256, 12).astype(np.uint8)
    for kind in range(5):
        out = []
        for i in range(12):
            a, b, c = (out[i - 3] if i > 2 else 0), int(above[i]), (int(above[i - 3]) if i > 2 else 0)
            guess = [0, a, b, (a + b) // 2, min([(abs(a + b - c - v), j, v) for j, v in enumerate((a, b, c))])[2]][kind]
            out.append((int(line[i]) + guess) % 256)
        assert images._undone(kind, line, above, 3).tolist() == out
    with pytest.raises(ValueError):
        images.decode_png(b"no image")


def test_weights_follow_visibility(spark):
    df = spark.createDataFrame([("a", float(i), i % 2) for i in range(20)], "label string, x double, seen int")
    plain = {r.x: r.weight for r in robust.centre_weights(df, "label", ["x"]).collect()}
    for r in robust.centre_weights(df, "label", ["x"], "seen").collect():
        assert r.weight == pytest.approx(plain[r.x] * (r.seen + 1e-6))


def test_sources_say_what_is_missing(spark, tmp_path):
    with pytest.raises(ValueError):
        datasets.open_capture(spark, "unknown", str(tmp_path))
    assert set(datasets.KINDS) == {"parquet", "phone", "multiview", "casual"}
    left = spark.createDataFrame([("a/x.png",), ("a/y.png",)], "path string")
    with pytest.raises(Exception, match="no match for"):
        sampling.paired_by_stem(left, left.where("path = 'a/x.png'")).collect()
