"""Readers and writers over folders that each query writes from the driver tables below the shared folder."""

from __future__ import annotations

import json
import struct
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import sampling
from ..sources import colmap, datasets, files, sinks
from .bind import TRACKS_SQL, query, rounded, table, track_table


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spindrift-")
    return f"{base.rstrip('/')}/source-{uuid.uuid4().hex}"


def _put(spark, folder: str, **contents) -> str:
    """Files of a folder, `__` standing for the name's dot and `/` kept."""
    rows = [(name, content if isinstance(content, bytes) else content.encode()) for name, content in contents.items()]
    return _put_rows(spark, folder, rows)


def _put_rows(spark, folder: str, rows: list) -> str:
    sinks.write_files(spark.createDataFrame(rows, "name string, content binary"), folder)
    return folder


def _nations(spark, sf_dir) -> list[int]:
    return [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]


def _split(keys) -> str:
    return json.dumps({"frame_names": [f"f{n}" for n in keys], "time_ids": list(keys)})


@query("SELECT 'f' || n_nationkey AS frame_name, n_nationkey AS time_id, n_nationkey - 3 AS t FROM nation WHERE n_nationkey BETWEEN 3 AND 19")
def read_split(spark, sf_dir):
    folder = _put_rows(spark, _folder(spark), [("train.json", _split(_nations(spark, sf_dir)).encode())])
    return files.read_split(spark, f"{folder}/train.json", 3, 20)


def _camera_json(n: int) -> str:
    import math

    c, s = math.cos(n * 0.1), math.sin(n * 0.1)
    return json.dumps({"focal_length": 500.0 + n, "principal_point": [320.0 + n, 240.0], "orientation": [[c, 0, s], [0, 1, 0], [-s, 0, c]], "position": [float(n), 1.0, 2.0]})


_CAMERA_SQL = "SELECT n_nationkey AS n, cos(n_nationkey * 0.1) AS c, sin(n_nationkey * 0.1) AS s FROM nation"


@query(f"WITH k AS ({_CAMERA_SQL}) SELECT 'f' || n AS name, (500.0 + n) / 2 AS fx, (320.0 + n) / 2 AS cx, 120.0::DOUBLE AS cy, round(-(c * n + s * 2), 5) AS t0, round(s * n - c * 2, 5) AS t2, round(s, 5) AS r02, n::DOUBLE AS position FROM k")
def read_json_cameras(spark, sf_dir):
    folder = _put_rows(spark, _folder(spark), [(f"f{n}.json", _camera_json(n).encode()) for n in _nations(spark, sf_dir)])
    c = files.read_json_cameras(spark, folder, 2.0)
    at = lambda m, i: F.get(m, F.lit(i))
    return rounded(c.select("name", "fx", "cx", "cy", at("w2c", 3).alias("t0"), at("w2c", 11).alias("t2"), at("w2c", 2).alias("r02"), at("c2w", 3).alias("position")))


@query("""WITH k AS (SELECT n_nationkey AS n, count(*) OVER () // 2 AS mid FROM nation)
SELECT n AS frame, n * 0.5 AS time, round(cos(-mid * 0.1) * (n - mid) + sin(-mid * 0.1) * 0.5 * (n - mid), 5) + 0.0 AS x, round(cos(mid * 0.1) * 0.5 * (n - mid) + sin(mid * 0.1) * (n - mid), 5) + 0.0 AS z, round(cos((n - mid) * 0.1), 5) AS r00 FROM k""")
def read_trajectory(spark, sf_dir):
    """Poses turned about y, so the middle frame's inverse turns the way between two positions back."""
    import math

    lines = [f"{n * 0.5} {float(n)} 1.0 {n * 0.5} 0.0 {math.sin(n * 0.05)!r} 0.0 {math.cos(n * 0.05)!r}" for n in _nations(spark, sf_dir)]
    folder = _put_rows(spark, _folder(spark), [("traj.txt", "\n".join(lines).encode())])
    t = files.read_trajectory(spark, f"{folder}/traj.txt")
    at = lambda i: F.get("c2w", F.lit(i))
    return t.select("frame", "time", (F.round(at(3), 5) + 0.0).alias("x"), (F.round(at(11), 5) + 0.0).alias("z"), F.round(at(0), 5).alias("r00"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@query("SELECT label AS file, count(*) AS rows, 64::BIGINT AS width, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) AS total FROM embeddings GROUP BY label")
def read_arrays(spark, sf_dir):
    """Every label's vectors as one array file, read back as one row for each index of the first dimension."""
    folder = _folder(spark)
    held = _vectors(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"])).alias("values"))
    sinks.write_arrays(held.select(F.col("label").cast("string").alias("file"), F.lit("").alias("name"), F.array("n", F.lit(64).cast("long")).alias("shape"), "values"), folder)
    rows = files.split_leading(files.read_arrays(spark, folder)).withColumn("file", files.stem(F.col("path")).cast("int"))
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("values")).cast("long").alias("width"), F.sum(total).alias("total")), 4)


@query("SELECT count(*) AS frames, round(median(500.0 + n_nationkey), 5) AS fx, round(median(320.0 + n_nationkey), 5) AS cx, 240.0::DOUBLE AS cy FROM nation")
def read_intrinsics(spark, sf_dir):
    """Intrinsics under one of their names in an archive of several arrays."""
    folder, n = _folder(spark), table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("n"))
    k = F.array(500 + F.col("n"), F.lit(0.0), 320 + F.col("n"), F.lit(0.0), 500 + F.col("n"), F.lit(240.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    held = n.agg(F.count(F.lit(1)).alias("frames"), F.flatten(F.collect_list(k)).alias("values"))
    arrays = held.select(F.lit("cams").alias("file"), F.lit("intrinsics").alias("name"), F.array("frames", F.lit(3).cast("long"), F.lit(3).cast("long")).alias("shape"), "values")
    other = held.select(F.lit("cams").alias("file"), F.lit("depths").alias("name"), F.array("frames").alias("shape"), F.transform(F.sequence(F.lit(1).cast("long"), "frames"), lambda x: x.cast("double")).alias("values"))
    sinks.write_arrays(arrays.unionByName(other), folder)
    found = files.read_arrays(spark, folder, files.INTRINSIC_KEYS)
    size = found.select(F.get("shape", F.lit(0)).alias("frames"))
    return rounded(files.intrinsics_vector(found, 640.0, 480.0).select("fx", "cx", "cy").crossJoin(size).select("frames", "fx", "cx", "cy"))


def _model(spark, sf_dir) -> tuple[list, list, list]:
    """A camera, an image and two points for each nation; the second point of an image is unknown."""
    keys = _nations(spark, sf_dir)
    cameras = [(n, 1 if n % 2 else 0, 640, 480, [500.0 + n, 400.0 + n, 320.0, 240.0] if n % 2 else [500.0 + n, 320.0, 240.0]) for n in keys]
    images = [(n, (1.0, 0.0, 0.0, 0.0), (float(n), 1.0, 2.0), n, f"f{n}.png", [(n * 2.0, n * 3.0, n), (1.0, 1.0, -1)]) for n in keys]
    points = [(n, n * 1.0, n * 2.0, n * 4.0, n, 2, 3, 0.5, [(n, 0)]) for n in keys]
    return cameras, images, points


_MODEL_SQL = """SELECT 'f' || n_nationkey || '.png' AS name, 500.0::DOUBLE + n_nationkey AS fx, CASE WHEN n_nationkey % 2 = 1 THEN 400.0 + n_nationkey ELSE 500.0 + n_nationkey END::DOUBLE AS fy,
  n_nationkey::DOUBLE AS t0, n_nationkey * 2.0::DOUBLE AS px, n_nationkey * 4.0::DOUBLE AS z FROM nation"""


def _model_rows(images, cameras, points):
    """Each image's camera, position and known point."""
    seen = colmap.visible_points(images, points).join(images.select("image_id", "name"), "image_id").select("name", "px", "z")
    named = images.select("name")
    c = colmap.camera_params(images, cameras, named).select("name", "fx", "fy", F.get("w2c", F.lit(3)).alias("t0"))
    return c.join(seen, "name")


@query(_MODEL_SQL)
def read_model_binary(spark, sf_dir):
    cameras, images, points = _model(spark, sf_dir)
    c = struct.pack("<Q", len(cameras)) + b"".join(struct.pack(f"<iiQQ{len(p)}d", i, m, w, h, *p) for i, m, w, h, p in cameras)
    v = struct.pack("<Q", len(images)) + b"".join(struct.pack("<i7di", i, *q, *t, k) + name.encode() + b"\0" + struct.pack("<Q", len(p)) + b"".join(struct.pack("<ddq", *x) for x in p) for i, q, t, k, name, p in images)
    p = struct.pack("<Q", len(points)) + b"".join(struct.pack("<QdddBBBdQ", *x[:8], len(x[8])) + b"".join(struct.pack("<ii", *y) for y in x[8]) for x in points)
    folder = _put_rows(spark, _folder(spark), [("cameras.bin", c), ("images.bin", v), ("points3D.bin", p)])
    return _model_rows(colmap.read_images_binary(spark, f"{folder}/images.bin"), colmap.read_cameras_binary(spark, f"{folder}/cameras.bin"), colmap.read_points_binary(spark, f"{folder}/points3D.bin"))


@query(_MODEL_SQL)
def read_model_text(spark, sf_dir):
    cameras, images, points = _model(spark, sf_dir)
    words = lambda *x: " ".join(map(str, x))
    c = ["# cameras", *(words(i, "PINHOLE" if m else "SIMPLE_PINHOLE", w, h, *p) for i, m, w, h, p in cameras)]
    v = ["# images", *(line for i, q, t, k, name, p in images for line in (words(i, *q, *t, k, name), words(*(y for x in p for y in x))))]
    p = ["# points", *(words(*x[:8], *(y for z in x[8] for y in z)) for x in points)]
    folder = _put_rows(spark, _folder(spark), [(f"{n}.txt", "\n".join(t).encode()) for n, t in (("cameras", c), ("images", v), ("points3D", p))])
    return _model_rows(colmap.read_images_text(spark, f"{folder}/images.txt"), colmap.read_cameras_text(spark, f"{folder}/cameras.txt"), colmap.read_points_text(spark, f"{folder}/points3D.txt"))


@query(f"WITH {TRACKS_SQL} SELECT t, (row_number() OVER (PARTITION BY t ORDER BY track_id) - 1)::INT AS kp_id, round(x, 5) AS x, round(y, 5) AS y, visible FROM tracks")
def read_keypoints(spark, sf_dir):
    """A file for each time, its number in the name."""
    rows = track_table(spark, sf_dir).groupBy("t").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("track_id", F.array("x", "y", F.col("visible").cast("double")).alias("p")))), lambda s: s["p"])).alias("content"))
    folder = _folder(spark)
    sinks.write_files(rows.select(F.concat(F.lit("0_"), F.lpad(F.col("t").cast("string"), 5, "0"), F.lit(".json")).alias("name"), F.encode("content", "utf-8").alias("content")), folder)
    return rounded(files.read_keypoints(spark, folder, 2.0).withColumn("t", F.col("t").cast("long")))


_RASTER_SQL = "SELECT vec_id::VARCHAR AS name, 8 AS h, 8 AS w, list_sum(list_transform(embedding, lambda v: round(least(greatest(v::DOUBLE + 0.5, 0), 1) * {top}) / {top})) AS total FROM embeddings WHERE label < 3"


@query(f"SELECT name, h, w, round(total, 6) AS total FROM ({_RASTER_SQL.format(top='255.0')})")
def image_round_trip(spark, sf_dir):
    """Rasters of three labels as PNG files, listed and read again."""
    return _images(spark, sf_dir, 8)


@query(f"SELECT name, h, w, round(total, 6) AS total FROM ({_RASTER_SQL.format(top='65535.0')})")
def disparity_round_trip(spark, sf_dir):
    """The same in 16 bits."""
    return _images(spark, sf_dir, 16)


def _images(spark, sf_dir, bits):
    e = _vectors(spark, sf_dir).where("label < 3").select(F.col("vec_id").cast("string").alias("name"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("v", lambda v: v + 0.5).alias("v"))
    folder = _folder(spark)
    sinks.write_images(e, folder, "name", "v", bits)
    found = files.read_png(spark, folder).join(files.list_images(spark, folder).select("name"), "name")
    return rounded(found.select("name", "h", "w", F.aggregate(F.get("channels", F.lit(0)), F.lit(0.0), lambda a, x: a + x).alias("total")), 6)


@query(f"WITH {TRACKS_SQL} SELECT track_id AS point_id, t % 5 AS target_t, round(x, 5) AS x FROM tracks WHERE track_id % 10 = 3 AND t % 5 IN (1, 4)")
def track_files(spark, sf_dir):
    """Tracks written by query frame, of which one frame's folder is opened again."""
    path = _folder(spark)
    t = track_table(spark, sf_dir)
    sinks.write_tracks(t.select((F.col("track_id") % 10).alias("query_t"), (F.col("t") % 5).alias("target_t"), F.col("track_id").alias("point_id"), "x"), path)
    return rounded(sinks.read_tracks(spark, path, 3, [1, 4]).select("point_id", F.col("target_t").cast("long").alias("target_t"), "x"))


@query("SELECT q, t, (q * 5 + t) % 7 > 0 AS written FROM (SELECT unnest(range(5)) AS q), (SELECT unnest(range(5)) AS t)")
def track_pairs(spark, sf_dir):
    """The whole grid of query and target frames, and which pairs already have tracks."""
    frames = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("q"))
    grid = frames.crossJoin(F.broadcast(frames.select(F.col("q").alias("t"))))
    done = grid.where((F.col("q") * 5 + F.col("t")) % 7 > 0)
    left = sampling.missing_work(grid, done, ["q", "t"])
    return done.withColumn("written", F.lit(True)).unionByName(left.withColumn("written", F.lit(False)))


@query("SELECT 'part' AS name, 700::BIGINT AS step, count(*) AS rows, round(sum(p_retailprice), 2) AS total FROM part UNION ALL SELECT 'supplier', 700, count(*), round(sum(s_acctbal), 2) FROM supplier")
def checkpoint_round_trip(spark, sf_dir):
    path = _folder(spark)
    sinks.save_checkpoint(spark, path, 700, {"part": table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("v")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("v"))})
    step, tables = sinks.load_checkpoint(spark, path, ("part", "supplier"))
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.sum("v").alias("total")).select(F.lit(n).alias("name"), F.lit(step).cast("long").alias("step"), "rows", "total") for n, df in tables.items()]
    return rounded(parts[0].unionAll(parts[1]), 2)


@query("SELECT 'run' AS run, event_id AS step, 'loss/' || event_type AS name, value FROM events")
def metrics_log(spark, sf_dir):
    """Two appends to one log."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events").select(F.lit("run").alias("run"), F.col("event_id").alias("step"), F.concat(F.lit("loss/"), "event_type").alias("name"), "value")
    sinks.log_metrics(e.where("step % 2 = 0"), path)
    sinks.log_metrics(e.where("step % 2 = 1"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey AS idx, n_nationkey * 0.5 AS seconds FROM nation")
def camera_path_file(spark, sf_dir):
    path = _folder(spark)
    sinks.write_camera_path(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), (F.col("n_nationkey") * 0.5).alias("seconds")), path)
    return spark.read.schema("idx int, seconds double").json(path)


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM part")
def repeated_run(spark, sf_dir):
    """A run that broke off after a third of its rows, and the one after it."""
    path, p = _folder(spark), table(spark, sf_dir, "part").select("p_partkey")
    sinks.write_new(p.where("p_partkey % 3 = 0").withColumn("run", F.lit("first")), path, ["p_partkey"])
    sinks.write_new(p.withColumn("run", F.lit("second")), path, ["p_partkey"])
    return spark.read.parquet(path)


@query(f"WITH {TRACKS_SQL} SELECT (track_id % 4) AS src_t, t AS dst_t, track_id AS kp_id, round(x, 5) AS x, round(z, 5) AS z FROM tracks")
def keypoint_predictions(spark, sf_dir):
    path = _folder(spark)
    t = track_table(spark, sf_dir)
    sinks.write_keypoints(t.select((F.col("track_id") % 4).alias("src_t"), F.col("t").alias("dst_t"), F.col("track_id").alias("kp_id"), "x", "y", "z"), path)
    return rounded(spark.read.parquet(path).select(F.col("src_t").cast("long").alias("src_t"), F.col("dst_t").cast("long").alias("dst_t"), "kp_id", "x", "z"))


@query("SELECT (n_nationkey)::BIGINT AS frame, n_nationkey::DOUBLE AS x, 500.0::DOUBLE AS fx FROM nation")
def reconstruction_round_trip(spark, sf_dir):
    folder = _folder(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame"))
    one = lambda i: F.lit(1.0 if i % 5 == 0 else 0.0)
    poses = n.select("frame", F.array(*(F.col("frame").cast("double") if i == 3 else one(i) for i in range(16))).alias("c2w"))
    sinks.write_reconstruction(poses, spark.range(1).select(F.lit(500.0).alias("fx"), F.lit(400.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy")), folder)
    found = files.split_leading(files.read_arrays(spark, folder, files.POSE_KEYS))
    k = files.read_arrays(spark, folder, files.INTRINSIC_KEYS).select(F.get("values", F.lit(0)).alias("fx"))
    return found.select("frame", F.get("values", F.lit(3)).alias("x")).crossJoin(F.broadcast(k))


@query("SELECT 'lr' AS name, '0.01' AS value UNION ALL SELECT 'steps', '5000'")
def config_file(spark, sf_dir):
    folder = _folder(spark)
    sinks.write_config(spark, {"lr": 0.01, "steps": 5000}, folder)
    return spark.createDataFrame([(k, str(v)) for k, v in sinks.read_config(spark, folder).items()], "name string, value string")


@query("SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
def cached_table(spark, sf_dir):
    """Made once, then read: the second making would fail."""
    path = f"{_folder(spark)}/cache"
    made = lambda: table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    files.read_through(spark, path, made)
    return files.read_through(spark, path, lambda: 1 / 0)


@query("SELECT 0::BIGINT AS missing, count(*) AS present FROM region")
def absent_table(spark, sf_dir):
    missing = files.read_or_empty(spark, f"{_folder(spark)}/nothing", "a int").agg(F.count(F.lit(1)).alias("missing"))
    return missing.crossJoin(table(spark, sf_dir, "region").agg(F.count(F.lit(1)).alias("present")))


# --- captures ----------------------------------------------------------------------


def _capture(spark, sf_dir, folder: str, big: int = 1) -> None:
    """Frames of 8 x 8 for the nations: images, masks, depths, cameras, tracks between pairs of frames, keypoints."""
    import numpy as np

    from ..functions.images import encode_png

    keys = _nations(spark, sf_dir)
    y, x = np.mgrid[:8, :8]
    rows, arrays = [], []
    rows.append(("splits/train.json", _split(keys).encode()))
    for n in keys:
        alpha = np.where(x == n % 8, 0, 255)
        image = np.stack([x * 20 + n, y * 20, x * 0 + n, alpha], -1).astype(np.uint8)
        rows.append((f"rgb/2x/f{n}.png", encode_png(image)))
        rows.append((f"rgb/1x/f{n}.png", encode_png(np.repeat(np.repeat(image, big, 0), big, 1))))
        rows.append((f"flow3d_preprocessed/track_anything/2x/f{n}.png", encode_png(np.stack([np.where(y > n % 5, 255, 0), y * 0, y * 0], -1).astype(np.uint8))))
        rows.append((f"camera/f{n}.json", _camera_json(n).encode()))
        rows.append((f"keypoint/2x/train/0_{n:05d}.json", json.dumps([[1.0 + n, 2.0, 1.0], [3.0, 4.0, 0.0]]).encode()))
        arrays.append((f"depth/2x/f{n}", "", [8, 8], (1.0 + n + x + y * 0.0).reshape(-1).tolist()))
        m = (n + 1) % len(keys)
        arrays.append((f"flow3d_preprocessed/2d_tracks/2x/f{n}_f{m}", "", [3, 4], [v for p in range(3) for v in (p + 1.0, 6.0, -4.0, -4.0)]))
    _put_rows(spark, folder, rows)
    sinks.write_arrays(spark.createDataFrame(arrays, "file string, name string, shape array<long>, values array<double>"), folder)


@query("""WITH n AS (SELECT n_nationkey AS n, n_nationkey - 2 AS t FROM nation WHERE n_nationkey BETWEEN 2 AND 19), l AS (SELECT quantile_disc(8.0 + n, 0.5) * 2.5 AS lim FROM n)
SELECT t::INT AS frame, (SELECT sum(least(1.0 + n + x, lim)) * 8 FROM range(8) r(x))::DOUBLE AS depth, (7 - n % 5) * 8.0 AS mask, 56.0::DOUBLE AS valid, (500.0 + n) / 2 AS fx, (320.0 + n) / 2 AS cx FROM n, l""")
def phone_capture(spark, sf_dir):
    folder = _folder(spark)
    _capture(spark, sf_dir, folder)
    c = datasets.open_capture(spark, "phone", folder, start=2, end=20, factor=2)
    total = lambda col: F.aggregate(col, F.lit(0.0), lambda a, v: a + v).alias(col)
    return c.frames().select("frame", total("depth"), total("mask"), total("valid")).join(c.cameras().select("frame", "fx", "cx"), "frame")


@query("""SELECT query_t, target_t, p AS point_id, p + 1.0 AS x, kp FROM (SELECT n_nationkey AS query_t, (n_nationkey + 1) % 25 AS target_t, n_nationkey + 1.0 AS kp FROM nation), (SELECT unnest(range(3)) AS p)""")
def capture_tracks(spark, sf_dir):
    """2-D tracks between pairs of frames, with the query frame's first keypoint."""
    folder = _folder(spark)
    _capture(spark, sf_dir, folder)
    c = datasets.open_capture(spark, "phone", folder, factor=2)
    kp = c.keypoints().where("kp_id = 0 AND visible").select(F.col("t").alias("query_t"), F.col("x").alias("kp"))
    return c.tracks_2d().select("query_t", "target_t", "point_id", "x").join(kp, "query_t")


@query("""SELECT n_nationkey AS frame, (500.0 + n_nationkey) / 2 AS fx, 120.0::DOUBLE AS cy, (7 - n_nationkey % 5) * 8.0 AS mask FROM nation""")
def multiview_capture(spark, sf_dir):
    """Intrinsics scaled by the measured size of the images, twice as large in the first folder."""
    folder = _folder(spark)
    _capture(spark, sf_dir, folder, big=2)
    c = datasets.open_capture(spark, "multiview", folder)
    m = c.masks().select(F.col("t").alias("frame"), F.aggregate("mask", F.lit(0.0), lambda a, v: a + v).alias("mask"))
    return c.cameras().select("frame", "fx", "cy").join(m, "frame")


@query("""WITH n AS (SELECT n_nationkey AS n, n_nationkey - 2 AS t FROM nation WHERE n_nationkey >= 2) SELECT t AS frame, n::DOUBLE AS x, 500.0::DOUBLE AS fx, round(1 / (1.0 + n), 6) AS nearest FROM n""")
def casual_capture(spark, sf_dir):
    """Frames by file name, depths of disparities, cameras of one archive."""
    folder = _folder(spark)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame"))
    name = F.lpad(F.col("frame").cast("string"), 3, "0")
    sinks.write_images(n.select(name.alias("name"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.array_repeat(F.lit(0.5), 64).alias("v")), f"{folder}/images/480p", "name", "v")
    disparity = n.select(F.concat(F.lit("aligned_depth_anything/480p/"), name).alias("file"), F.lit("").alias("name"), F.array(F.lit(8), F.lit(8)).cast("array<long>").alias("shape"), F.array_repeat(1.0 + F.col("frame"), 64).alias("values"))
    sinks.write_arrays(disparity, folder)
    one = lambda i: F.lit(1.0 if i % 5 == 0 else 0.0)
    poses = n.select("frame", F.array(*(F.col("frame").cast("double") if i == 3 else one(i) for i in range(16))).alias("c2w"))
    sinks.write_reconstruction(poses, spark.range(1).select(F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(4.0).alias("cx"), F.lit(4.0).alias("cy")), folder, "cameras")
    c = datasets.open_capture(spark, "casual", folder, start=2, median=3)
    d = c.depths().select(F.col("t").alias("frame"), F.round(F.array_min("depth"), 6).alias("nearest"))
    return c.cameras().select("frame", F.get("c2w", F.lit(3)).alias("x"), "fx").join(d, "frame")
