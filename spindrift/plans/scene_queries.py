"""Geometry, raster and lifting queries over the driver tables; an embedding of 64 values doubles as an 8 x 8 raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.raster import bilinear, normalised_coordinate, resized_coordinate
from ..operators import rasters, scene
from .bind import TRACKS_SQL, embedding_dims, embedding_sql, query, rounded, table, track_table


def _cameras(spark, sf_dir):
    """A camera for each nation: turned about the y axis, moved along x."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cam"))
    a = F.col("cam") * 0.1
    w2c = g.rigid([F.cos(a), F.lit(0.0), F.sin(a), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(a), F.lit(0.0), F.cos(a)], [F.col("cam") * 0.2, F.lit(0.5), F.lit(3.0)])
    return n.select("cam", F.lit(500.0).alias("fx"), F.lit(480.0).alias("fy"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"), g.pack(w2c).alias("w2c"), g.pack(g.invert_rigid(w2c)).alias("c2w"))


def _points(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 25).cast("int").alias("cam"), (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10 + 1).alias("z"))


_POINTS = "p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 25 AS cam, l_quantity / 10 AS x, l_discount * 10 AS y, l_tax * 10 + 1 AS z, cos((l_suppkey % 25) * 0.1) AS c, sin((l_suppkey % 25) * 0.1) AS s FROM lineitem)"
_CAM = "q AS (SELECT *, c * x + s * z + cam * 0.2 AS a, y + 0.5 AS b, c * z - s * x + 3.0 AS d FROM p)"


@query(f"WITH {_POINTS}, {_CAM} SELECT l_orderkey, l_linenumber, l_partkey, round(500 * a / greatest(d, 1e-5) + 320, 3) AS px, round(480 * b / greatest(d, 1e-5) + 240, 3) AS py, round(d, 3) AS depth FROM q WHERE abs(d) > 0.01")
def pinhole_project(spark, sf_dir):
    out = scene.project_points(_points(spark, sf_dir), _cameras(spark, sf_dir), ["cam"], ["x", "y", "z"]).where(F.abs("depth") > 0.01)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "px", "py", "depth"), 3)


@query(f"""WITH {_POINTS}, u AS (SELECT *, (x * 100 - 320) / 500 * z - cam * 0.2 AS a, (y * 40 - 240) / 480 * z - 0.5 AS b, z - 3.0 AS d FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round(c * a - s * d, 4) AS x, round(b, 4) AS y, round(s * a + c * d, 4) AS z FROM u""")
def unproject(spark, sf_dir):
    p = _points(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "cam", (F.col("x") * 100).alias("px"), (F.col("y") * 40).alias("py"), F.col("z").alias("depth"))
    return rounded(scene.unproject_points(p, _cameras(spark, sf_dir), ["cam"]).select("l_orderkey", "l_linenumber", "l_partkey", "x", "y", "z"), 4)


_E6 = f"e AS (SELECT vec_id, {embedding_sql(6)} FROM embeddings)"


@query(f"""WITH {_E6}, x AS (SELECT *, e0/sqrt(e0*e0+e1*e1+e2*e2) AS x0, e1/sqrt(e0*e0+e1*e1+e2*e2) AS x1, e2/sqrt(e0*e0+e1*e1+e2*e2) AS x2 FROM e),
b AS (SELECT *, e3 - (x0*e3+x1*e4+x2*e5)*x0 AS b0, e4 - (x0*e3+x1*e4+x2*e5)*x1 AS b1, e5 - (x0*e3+x1*e4+x2*e5)*x2 AS b2 FROM x),
y AS (SELECT *, b0/sqrt(b0*b0+b1*b1+b2*b2) AS y0, b1/sqrt(b0*b0+b1*b1+b2*b2) AS y1, b2/sqrt(b0*b0+b1*b1+b2*b2) AS y2 FROM b)
SELECT vec_id, round(x0,5) AS m00, round(y0,5) AS m01, round(x1*y2-x2*y1,5) AS m02, round(x1,5) AS m10, round(y1,5) AS m11, round(x2*y0-x0*y2,5) AS m12, round(x2,5) AS m20, round(y2,5) AS m21, round(x0*y1-x1*y0,5) AS m22 FROM y""")
def rot6d_to_matrix(spark, sf_dir):
    m = g.rot6_to_matrix(g.unpack(F.col("embedding"), 6))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(f"m{i // 3}{i % 3}") for i, c in enumerate(m))))


@query(f"""WITH r AS (SELECT vec_id, {embedding_sql(4)} FROM embeddings), q AS (SELECT vec_id, e0/n AS w, e1/n AS x, e2/n AS y, e3/n AS z FROM (SELECT *, sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS n FROM r))
SELECT vec_id, round(1-2*(y*y+z*z),5) AS m00, round(2*(x*y-w*z),5) AS m01, round(2*(x*z+w*y),5) AS m02, round(2*(x*y+w*z),5) AS m10, round(1-2*(x*x+z*z),5) AS m11, round(2*(y*z-w*x),5) AS m12, round(2*(x*z-w*y),5) AS m20, round(2*(y*z+w*x),5) AS m21, round(1-2*(x*x+y*y),5) AS m22 FROM q""")
def quat_to_matrix(spark, sf_dir):
    m = g.quat_to_matrix(g.unpack(F.col("embedding"), 4))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", *(c.alias(f"m{i // 3}{i % 3}") for i, c in enumerate(m))))


@query(f"""WITH r AS (SELECT vec_id, {embedding_sql(8)} FROM embeddings), q AS (SELECT vec_id, e0/n AS a, e1/n AS b, e2/n AS c, e3/n AS d, e4/m AS e, e5/m AS f, e6/m AS g, e7/m AS h FROM (SELECT *, sqrt(e0*e0+e1*e1+e2*e2+e3*e3) AS n, sqrt(e4*e4+e5*e5+e6*e6+e7*e7) AS m FROM r)),
p AS (SELECT vec_id, a*e-b*f-c*g-d*h AS w, a*f+b*e+c*h-d*g AS x, a*g-b*h+c*e+d*f AS y, a*h+b*g-c*f+d*e AS z FROM q)
SELECT vec_id, round(w * sign(w), 5) AS w, round(x * sign(w), 5) AS x, round(y * sign(w), 5) AS y, round(z * sign(w), 5) AS z FROM p""")
def quat_compose(spark, sf_dir):
    """Two rotations as matrices, multiplied and turned back to a quaternion."""
    e = table(spark, sf_dir, "embeddings")
    e, a = g.hold(e, "a", g.quat_to_matrix(g.unpack(F.col("embedding"), 4)))
    e, b = g.hold(e, "b", g.quat_to_matrix(g.unpack(F.col("embedding"), 4, 4)))
    e, m = g.hold(e, "m", g.matmul(a, b, 3))
    return rounded(e.select("vec_id", *(c.alias(n) for n, c in zip("wxyz", g.matrix_to_quat(m), strict=True))))


@query(f"WITH {_POINTS}, {_CAM} SELECT l_orderkey, l_linenumber, l_partkey, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM q")
def rigid_round_trip(spark, sf_dir):
    """A pose applied, then its inverse composed with the identity: the points come back."""
    j = _points(spark, sf_dir).join(_cameras(spark, sf_dir).select("cam", "w2c"), "cam")
    m = g.unpack(F.col("w2c"), 16)
    inv = g.matmul(g.invert_rigid(m), g.rigid([F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)], [F.lit(0.0)] * 3), 4)
    back = g.apply_rigid(inv, g.apply_rigid(m, [F.col("x"), F.col("y"), F.col("z")]))
    return rounded(j.select("l_orderkey", "l_linenumber", "l_partkey", *(c.alias(n) for n, c in zip("xyz", back, strict=True))), 4)


_BASES = "SELECT k, t, 1 + 0.1 * k AS r0, 0.2 * t AS r1, 0.1 AS r2, 0.3 AS r3, 1 + 0.05 * t AS r4, 0.1 * k AS r5, k * 1.0 AS t0, t * 1.0 AS t1, k * t * 0.1 AS t2 FROM range(4) a(k), range(3) b(t)"


@query(f"""WITH b AS ({_BASES}), e AS (SELECT vec_id, {embedding_sql(4)} FROM embeddings), c AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS k, unnest([exp(e0), exp(e1), exp(e2), exp(e3)]) / (exp(e0) + exp(e1) + exp(e2) + exp(e3)) AS c FROM e),
s AS (SELECT vec_id, t, {', '.join(f'sum(c * {n}) AS {n}' for n in ('r0', 'r1', 'r2', 'r3', 'r4', 'r5', 't0', 't1', 't2'))} FROM c JOIN b USING (k) GROUP BY ALL),
x AS (SELECT *, r0/sqrt(r0*r0+r1*r1+r2*r2) AS x0, r1/sqrt(r0*r0+r1*r1+r2*r2) AS x1, r2/sqrt(r0*r0+r1*r1+r2*r2) AS x2 FROM s),
y AS (SELECT *, r3 - (x0*r3+x1*r4+x2*r5)*x0 AS b0, r4 - (x0*r3+x1*r4+x2*r5)*x1 AS b1, r5 - (x0*r3+x1*r4+x2*r5)*x2 AS b2 FROM x)
SELECT vec_id, t, round(x0, 5) AS m00, round(b0/sqrt(b0*b0+b1*b1+b2*b2), 5) AS m01, round(t0, 5) AS t0, round(t1, 5) AS t1, round(t2, 5) AS t2 FROM y""")
def motion_basis_blend(spark, sf_dir):
    from ..functions.stats import softmax

    k, t = F.col("k"), F.col("t")
    grid = spark.range(4).select(F.col("id").alias("k")).crossJoin(spark.range(3).select(F.col("id").alias("t")))
    bases = grid.select("k", "t", F.array(1 + 0.1 * k, 0.2 * t, F.lit(0.1), F.lit(0.3), 1 + 0.05 * t, 0.1 * k).alias("rot6"), F.array(k * 1.0, t * 1.0, k * t * 0.1).alias("transl"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", softmax(F.array(*embedding_dims(4))).alias("c"))
    out = scene.blend_bases(e, bases, "c", "vec_id")
    return rounded(out.select("vec_id", "t", F.get("rot", F.lit(0)).alias("m00"), F.get("rot", F.lit(1)).alias("m01"), *(F.get("transl", F.lit(i)).alias(f"t{i}") for i in range(3))))


@query("""WITH r AS (SELECT vec_id, embedding[1:3] AS p, [x * 0.0 + embedding[4], embedding[5], embedding[6]] AS d, label FROM (SELECT *, 0 AS x FROM embeddings)),
u AS (SELECT label, p[1]::DOUBLE AS px, p[2]::DOUBLE AS py, p[3]::DOUBLE AS pz, d[1] / n AS a, d[2] / n AS b, d[3] / n AS c FROM (SELECT *, sqrt(d[1]::DOUBLE*d[1]+d[2]::DOUBLE*d[2]+d[3]::DOUBLE*d[3]) AS n FROM r)),
s AS (SELECT label, sum(1-a*a) AS m00, sum(-a*b) AS m01, sum(-a*c) AS m02, sum(1-b*b) AS m11, sum(-b*c) AS m12, sum(1-c*c) AS m22,
  sum((1-a*a)*px - a*b*py - a*c*pz) AS v0, sum(-a*b*px + (1-b*b)*py - b*c*pz) AS v1, sum(-a*c*px - b*c*py + (1-c*c)*pz) AS v2 FROM u GROUP BY label),
k AS (SELECT *, m00*(m11*m22-m12*m12) - m01*(m01*m22-m12*m02) + m02*(m01*m12-m11*m02) AS det FROM s)
SELECT label, round((v0*(m11*m22-m12*m12) - m01*(v1*m22-m12*v2) + m02*(v1*m12-m11*v2)) / det, 4) AS x, round((m00*(v1*m22-m12*v2) - v0*(m01*m22-m12*m02) + m02*(m01*v2-v1*m02)) / det, 4) AS y,
  round((m00*(m11*v2-v1*m12) - m01*(m01*v2-v1*m02) + v0*(m01*m12-m11*m02)) / det, 4) AS z FROM k""")
def lookat_lsq(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", *embedding_dims(6))
    return rounded(scene.look_at_point(e, ["e0", "e1", "e2"], ["e3", "e4", "e5"], ["label"]), 4)


@query("""WITH f AS (SELECT range::INT AS frame, range / 9.0 AS s FROM range(10)), a AS (SELECT frame, radians(90) * (s - 0.5) AS a FROM f)
SELECT frame, round(-4 * sin(a), 5) AS x, 0::DOUBLE AS y, round(-4 * cos(a), 5) AS z FROM a""")
def arc_trajectory(spark, sf_dir):
    """Camera centres of an arc about the y axis, from their matrices."""
    t = scene.trajectory(spark, "arc", 10, (0.0, 0.0, -4.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0), degrees=90.0)
    c = g.translation_of(g.invert_rigid(g.unpack(F.col("w2c"), 16)))
    return t.select("frame", *((F.round(v, 5) + 0.0).alias(n) for n, v in zip("xyz", c, strict=True)))


@query(f"WITH {TRACKS_SQL} SELECT track_id, t, least(t, 39) AS time FROM tracks")
def replay_times(spark, sf_dir):
    return scene.replay_times(track_table(spark, sf_dir), "t", 40).select("track_id", "t", F.col("time").cast("long").alias("time"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 50.0 * 2 - 1, 5) AS nx, round(l_quantity * 256 / 51.0, 5) AS rx FROM lineitem")
def normalised_coordinates(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    q = F.col("l_quantity")
    return rounded(l.select("l_orderkey", "l_linenumber", "l_partkey", normalised_coordinate(q, F.lit(51)).alias("nx"), resized_coordinate(q, F.lit(51), F.lit(256)).alias("rx")))


# --- rasters ---------------------------------------------------------------------

_XY = "l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 50 AS vec_id, l_quantity / 50 * 7 AS x, l_discount * 70 AS y FROM lineitem)"


@query(f"""WITH {_XY}, c AS (SELECT l.*, embedding AS e, floor(x)::INT AS x0, floor(y)::INT AS y0, x - floor(x) AS fx, y - floor(y) AS fy FROM l JOIN embeddings USING (vec_id)),
v AS (SELECT *, e[y0*8 + x0 + 1]::DOUBLE AS a, e[y0*8 + least(x0+1, 7) + 1]::DOUBLE AS b, e[least(y0+1, 7)*8 + x0 + 1]::DOUBLE AS c, e[least(y0+1, 7)*8 + least(x0+1, 7) + 1]::DOUBLE AS d FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(a*(1-fx)*(1-fy) + b*fx*(1-fy) + c*(1-fx)*fy + d*fx*fy, 5) AS sampled FROM v""")
def raster_bilinear(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).alias("vec_id"), (F.col("l_quantity") / 50 * 7).alias("x"), (F.col("l_discount") * 70).alias("y"))  # noqa: E741
    j = l.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return rounded(j.select("l_orderkey", "l_linenumber", "l_partkey", bilinear(F.col("embedding"), F.col("x"), F.col("y"), F.lit(8), F.lit(8)).alias("sampled")))


def _rasters(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("v"))


_PIX = "px AS (SELECT vec_id AS frame, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i))"


_NORMALS = f"""WITH {_PIX}, d AS (SELECT frame, y, x, v + 2 AS d FROM px), p AS (SELECT frame, y, x, (x - 3.5) / 10 * d AS px, (y - 3.5) / 10 * d AS py, d AS pz FROM d),
n AS (SELECT frame, y, x, {', '.join(f'lead({c}) OVER h - lag({c}) OVER h AS a{c[1]}, lag({c}) OVER v - lead({c}) OVER v AS u{c[1]}' for c in ('px', 'py', 'pz'))} FROM p WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y)),
k AS (SELECT frame, y, x, ay*uz - az*uy AS cx, az*ux - ax*uz AS cy, ax*uy - ay*ux AS cz FROM n)"""


@query(_NORMALS + "SELECT frame, y, x, " + ", ".join(f"coalesce(round(c{a} / sqrt(cx*cx+cy*cy+cz*cz), 5), 0) AS n{a}" for a in "xyz") + " FROM k")
def raster_normals(spark, sf_dir):
    f = _rasters(spark, sf_dir).withColumn("depth", F.transform("v", lambda v: v + 2.0))
    n = rasters.normals(f, "depth", [F.lit(10.0), F.lit(10.0), F.lit(3.5), F.lit(3.5)])
    p = rasters.pixels(n, ["frame"], n=F.col("normals"))
    return rounded(p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "n.nx", "n.ny", "n.nz"))


@query(f"""WITH {_PIX}, g AS (SELECT frame, y, x, v, v * 0.9 + (x + y) % 3 * 0.01 AS t, (x * 8 + y) % 7 <> 0 AS m FROM px),
d AS (SELECT abs((lead(v) OVER h - v) - (lead(t) OVER h - t)) AS lx, m AND lead(m) OVER h AS mx, abs((lead(v) OVER w - v) - (lead(t) OVER w - t)) AS ly, m AND lead(m) OVER w AS my FROM g WINDOW h AS (PARTITION BY frame, y ORDER BY x), w AS (PARTITION BY frame, x ORDER BY y)),
q AS (SELECT quantile_cont(lx, 0.95) FILTER (mx) AS qx, quantile_cont(ly, 0.95) FILTER (my) AS qy FROM d)
SELECT round((SELECT avg(lx) FROM d, q WHERE mx AND lx < qx) + (SELECT avg(ly) FROM d, q WHERE my AND ly < qy), 6) AS loss""")
def raster_gradient_loss(spark, sf_dir):
    f = _rasters(spark, sf_dir).withColumns({
        "t": F.transform("v", lambda v, i: v * 0.9 + (i % 8 + F.floor(i / 8)) % 3 * 0.01),
        "m": F.transform("v", lambda v, i: (i % 8 * 8 + F.floor(i / 8)) % 7 != 0),
    })
    return rounded(rasters.gradient_loss(f, "v", "t", "m", 0.95), 6)


_MIRRORED = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(f"""WITH {_PIX}, o AS (SELECT i // 3 - 1 AS dy, i % 3 - 1 AS dx FROM range(9) r(i))
SELECT a.frame, a.y, a.x, quantile_disc(b.v, 0.5) AS med FROM px a, o, px b WHERE a.frame = b.frame AND b.x = {_MIRRORED.format('a.x + dx')} AND b.y = {_MIRRORED.format('a.y + dy')} GROUP BY ALL""")
def raster_median3(spark, sf_dir):
    m = rasters.median_filter(_rasters(spark, sf_dir), "v", 3)
    p = rasters.pixels(m, ["frame"], med=F.col("filtered"))
    return p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "med")


@query(f"""WITH {_PIX} SELECT a.frame, a.y, a.x, coalesce(quantile_disc(b.v, 0.5) FILTER (b.v > 0), 0) AS med FROM px a JOIN px b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def raster_masked_median(spark, sf_dir):
    m = rasters.masked_median(_rasters(spark, sf_dir).withColumn("m", F.transform("v", lambda v: v > 0)), "v", "m", 3)
    p = rasters.pixels(m, ["frame"], med=F.col("filtered"))
    return p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "med")


@query(f"""WITH {_PIX} SELECT a.frame, a.y, a.x, CASE WHEN bool_and(b.v > -0.1) THEN 1 WHEN bool_and(b.v <= -0.1) THEN -1 ELSE 0 END AS state FROM px a JOIN px b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def mask_erosion(spark, sf_dir):
    m = rasters.erode_to_tristate(_rasters(spark, sf_dir).withColumn("m", F.transform("v", lambda v: v > -0.1)), "m")
    p = rasters.pixels(m, ["frame"], state=F.col("tristate"))
    return p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "state")


@query("""WITH a AS (SELECT vec_id AS frame, list_transform(embedding, lambda d: 1 / least(greatest(d::DOUBLE, 1e-2), 1e6)) AS d FROM embeddings), t AS (SELECT quantile_disc(list_max(d), 0.5) * 0.5 AS lim FROM a)
SELECT frame, round(list_sum(list_transform(d, lambda v: least(v, lim))), 3) AS total, round(list_min(d), 4) AS nearest FROM a, t""")
def disparity_depth_clamp(spark, sf_dir):
    f = _rasters(spark, sf_dir).withColumn("d", rasters.disparity_to_depth(F.col("v"), 1e-2))
    c = rasters.clamp_depth(f, "d", 0.5)
    return c.select("frame", F.round(F.aggregate("d", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.round(F.array_min("d"), 4).alias("nearest"))


@query("SELECT vec_id AS frame, list_sum(list_transform(embedding, lambda v: floor((v::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE) * 65535)))::BIGINT AS total FROM embeddings")
def quantise_uint16(spark, sf_dir):
    return _rasters(spark, sf_dir).select("frame", F.aggregate(rasters.quantise_uint16(F.col("v")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""WITH m AS (SELECT user_id, avg(value) AS mean FROM events GROUP BY ALL) SELECT event_id, user_id FROM events JOIN m USING (user_id) WHERE event_id % 5 >= 2 AND value > 0.5 * mean""")
def depth_consistency(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seen", F.col("event_id") % 5)
    return rasters.consistent(e, "user_id", "seen", "value").select("event_id", "user_id")


@query("SELECT event_id, CASE WHEN value < (SELECT least(0.9, quantile_cont(value, 0.01)) FROM events) THEN 0 ELSE value END AS value FROM events")
def zero_small_disparity(spark, sf_dir):
    return rasters.zero_small(table(spark, sf_dir, "events").select("event_id", "value"), "value", 0.9)


@query(f"""WITH {_PIX} SELECT frame, count(*) AS n, round(sum(v), 5) AS total FROM px WHERE x < 6 AND y < 6 GROUP BY frame""")
def crop_to_multiple(spark, sf_dir):
    c = rasters.crop_to_multiple(_rasters(spark, sf_dir), "v", 3)
    return rounded(c.select("frame", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"""WITH {_PIX}, e AS (SELECT frame, y, x, exp(v * 4) AS v FROM px), t AS (SELECT frame, arg_max(x, v) AS tx, arg_max(y, v) AS ty FROM e GROUP BY frame)
SELECT frame, round(sum(v * x) / sum(v), 5) AS x, round(sum(v * y) / sum(v), 5) AS y FROM e JOIN t USING (frame) WHERE (x - tx)^2 + (y - ty)^2 < 9 GROUP BY frame""")
def soft_argmax(spark, sf_dir):
    f = _rasters(spark, sf_dir).withColumn("v", F.transform("v", lambda v: F.exp(v * 4)))
    return rounded(rasters.soft_argmax(f, "v", 3.0).select("frame", "x", "y"))


# --- lifting ---------------------------------------------------------------------


def _frames(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: v.cast("double") + 2.0).alias("depth"), F.transform("embedding", lambda v: (v > -0.25).cast("double")).alias("mask"))


def _frame_cameras(spark, sf_dir):
    f = F.col("frame")
    c2w = g.rigid([F.cos(f * 0.05), F.lit(0.0), F.sin(f * 0.05), F.lit(0.0), F.lit(1.0), F.lit(0.0), -F.sin(f * 0.05), F.lit(0.0), F.cos(f * 0.05)], [f * 0.1, F.lit(0.2), F.lit(-1.0)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame")).select("frame", F.lit(10.0).alias("fx"), F.lit(10.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"), g.pack(c2w).alias("c2w"))


_LIFT = f"""WITH {TRACKS_SQL}, o AS (SELECT track_id % 10 AS query_t, track_id AS point_id, t AS target_t, least(x / 40, 6.9) AS px, (event_id % 70) / 10.0 AS py, ((event_id * 7) % 11 - 8) * 0.6 AS occ, ((event_id * 3) % 13 - 10) * 0.5 AS dist FROM tracks),
f AS (SELECT vec_id AS target_t, list_transform(embedding, lambda v: v::DOUBLE + 2) AS d, list_transform(embedding, lambda v: (v > -0.25)::INT) AS m FROM embeddings),
c AS (SELECT *, floor(px)::INT AS x0, floor(py)::INT AS y0, px - floor(px) AS fx, py - floor(py) AS fy FROM o JOIN f USING (target_t)),
s AS (SELECT *, d[y0*8+x0+1]*(1-fx)*(1-fy) + d[y0*8+x0+2]*fx*(1-fy) + d[y0*8+x0+9]*(1-fx)*fy + d[y0*8+x0+10]*fx*fy AS dep,
  m[y0*8+x0+1]*(1-fx)*(1-fy) + m[y0*8+x0+2]*fx*(1-fy) + m[y0*8+x0+9]*(1-fx)*fy + m[y0*8+x0+10]*fx*fy = 1 AS inside, 1 - 1/(1+exp(-occ)) AS vi, 1 - 1/(1+exp(-dist)) AS co FROM c),
v AS (SELECT *, inside AND vi*co > 0.5 AS visible, inside AND (1-vi)*co > 0.5 AS invisible, CASE WHEN inside AND (vi*co > 0.5 OR (1-vi)*co > 0.5) THEN co ELSE 0 END AS confidence FROM s),
n AS (SELECT query_t, point_id, count(*) FILTER (visible) AS n, bool_or(inside AND target_t = query_t) AS qi FROM v GROUP BY ALL), q AS (SELECT query_t, least(5.0, quantile_cont(n, 0.1)) AS lim FROM n GROUP BY query_t),
k AS (SELECT query_t, point_id FROM n JOIN q USING (query_t) WHERE qi AND n >= lim),
w AS (SELECT *, (px-3.5)/10*dep AS a, (py-3.5)/10*dep AS b FROM v SEMI JOIN k USING (query_t, point_id))
SELECT query_t, point_id, target_t, round(cos(target_t*0.05)*a + sin(target_t*0.05)*dep + target_t*0.1, 4) AS x, round(b + 0.2, 4) AS y, round(cos(target_t*0.05)*dep - sin(target_t*0.05)*a - 1, 4) AS z, visible, invisible, round(confidence, 4) AS confidence FROM w"""


@query(_LIFT)
def lift_tracks(spark, sf_dir):
    t, i = track_table(spark, sf_dir), F.col("event_id")
    t2 = t.select((F.col("track_id") % 10).alias("query_t"), F.col("track_id").alias("point_id"), F.col("t").cast("long").alias("target_t"), F.least(F.col("x") / 40, F.lit(6.9)).alias("px"), (i % 70 / 10.0).alias("py"), (((i * 7) % 11 - 8) * 0.6).alias("occ_logit"), (((i * 3) % 13 - 10) * 0.5).alias("dist_logit"))
    return rounded(scene.lift_tracks(t2, _frames(spark, sf_dir), _frame_cameras(spark, sf_dir), 100), 4)


@query(f"""WITH {_PIX}, b AS (SELECT frame, y, x, v + 2 AS d, y * 8 + x AS point_id FROM px WHERE v <= -0.25),
r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (point_id % 2147483647) * 742938285 % 2147483647, point_id) AS k FROM b)
SELECT frame, point_id, round(cos(frame*0.05)*(x-3.5)/10*d + sin(frame*0.05)*d + frame*0.1, 4) AS x, round((y-3.5)/10*d + 0.2, 4) AS y, round(cos(frame*0.05)*d - sin(frame*0.05)*(x-3.5)/10*d - 1, 4) AS z FROM r WHERE k <= 5""")
def background_points(spark, sf_dir):
    return rounded(scene.background_points(_frames(spark, sf_dir), _frame_cameras(spark, sf_dir), 5), 4)


@query(f"""WITH {TRACKS_SQL}, kp AS (SELECT track_id, t AS frame, least(x / 40, 6.9) AS px, (event_id % 70) / 10.0 AS py, visible FROM tracks),
f AS (SELECT vec_id AS frame, list_transform(embedding, lambda v: CASE WHEN v > -0.25 THEN v::DOUBLE + 2 ELSE 0 END) AS d FROM embeddings),
c AS (SELECT *, floor(px)::INT AS x0, floor(py)::INT AS y0, px - floor(px) AS fx, py - floor(py) AS fy FROM kp JOIN f USING (frame)),
s AS (SELECT *, d[y0*8+x0+1] AS a, d[y0*8+x0+2] AS b, d[y0*8+x0+9] AS e, d[y0*8+x0+10] AS g FROM c),
v AS (SELECT *, visible AND (a<>0)::INT*(1-fx)*(1-fy) + (b<>0)::INT*fx*(1-fy) + (e<>0)::INT*(1-fx)*fy + (g<>0)::INT*fx*fy = 1 AS valid FROM s)
SELECT track_id, frame, valid, round(CASE WHEN valid THEN a*(1-fx)*(1-fy) + b*fx*(1-fy) + e*(1-fx)*fy + g*fx*fy ELSE 0 END, 5) AS depth_at FROM v""")
def keypoint_lift(spark, sf_dir):
    kp = track_table(spark, sf_dir).select("track_id", F.col("t").cast("long").alias("frame"), F.least(F.col("x") / 40, F.lit(6.9)).alias("px"), (F.col("event_id") % 70 / 10.0).alias("py"), "visible")
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: F.when(v > -0.25, v.cast("double") + 2.0).otherwise(0.0)).alias("depth"))
    return rounded(scene.keypoint_lift(kp, f).select("track_id", "frame", "valid", "depth_at"))


# --- point maps, volumes, padding ----------------------------------------------------


_DEPTH = f"{_PIX}, p AS (SELECT frame, y, x, v + 2 AS d FROM px)"


def _posed(spark, sf_dir):
    """Depth rasters with a camera for each, turned about y."""
    return _rasters(spark, sf_dir).withColumn("depth", F.transform("v", lambda v: v + 2.0)).join(_frame_cameras(spark, sf_dir).select("frame", "c2w"), "frame")


@query(f"""WITH {_DEPTH} SELECT frame, y, x, round(x / 7.0, 5) AS ux, round(cos(frame*0.05)*(x-3.5)/10*d + sin(frame*0.05)*d + frame*0.1, 4) AS wx, round((y-3.5)/10*d + 0.2, 4) AS wy, round(cos(frame*0.05)*d - sin(frame*0.05)*(x-3.5)/10*d - 1, 4) AS wz FROM p""")
def world_points(spark, sf_dir):
    f = _posed(spark, sf_dir)
    k = [F.lit(10.0), F.lit(10.0), F.lit(3.5), F.lit(3.5)]
    p = rasters.pixels(f, ["frame"], u=rasters.unit_points("depth"), world=rasters.world_point_map(f, "depth", k, g.unpack(F.col("c2w"), 16)))
    return p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("u.x", 5).alias("ux"), *(F.round(f"world.{a}", 4).alias(f"w{a}") for a in "xyz"))


@query(f"""WITH {_DEPTH}, q AS (SELECT frame, y, x, (x - 4.0) / 10 * d AS a, (y - 4.0) / 10 * d AS b, d FROM p),
w AS (SELECT frame, y, x, cos(frame*0.05)*a + sin(frame*0.05)*d AS px, b AS py, cos(frame*0.05)*d - sin(frame*0.05)*a AS pz FROM q),
n AS (SELECT frame, y, x, {', '.join(f'lead({c}) OVER h - lag({c}) OVER h AS r{c[1]}, lead({c}) OVER v - lag({c}) OVER v AS s{c[1]}' for c in ('px', 'py', 'pz'))} FROM w WINDOW h AS (PARTITION BY frame, y ORDER BY x), v AS (PARTITION BY frame, x ORDER BY y)),
k AS (SELECT frame, y, x, sy*rz - sz*ry AS cx, sz*rx - sx*rz AS cy, sx*ry - sy*rx AS cz FROM n)
SELECT frame, y, x, {', '.join(f'coalesce(round(c{a} / sqrt(cx*cx+cy*cy+cz*cz), 5), 0) AS n{a}' for a in 'xyz')} FROM k""")
def rendered_normals(spark, sf_dir):
    """The other convention: rays through the raster's middle, world axes, the step down crossed with the step right."""
    n = rasters.surface_normals(_posed(spark, sf_dir), "depth", (10.0, 10.0), g.unpack(F.col("c2w"), 16))
    p = rasters.pixels(n, ["frame"], n=F.col("normals"))
    return rounded(p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "n.nx", "n.ny", "n.nz"))


@query(f"""WITH {_PIX}, o AS (SELECT i AS k, i // 3 - 1 AS dy, i % 3 - 1 AS dx FROM range(9) r(i)),
e AS (SELECT a.frame, a.y, a.x, k, coalesce(b.v, 0.0) AS v, coalesce(b.v > 0, false) AS ok FROM px a CROSS JOIN o LEFT JOIN px b ON a.frame = b.frame AND b.x = a.x + dx AND b.y = a.y + dy),
m AS (SELECT *, min(v) OVER (PARTITION BY frame) AS lo, max(v) OVER (PARTITION BY frame) AS hi, sum((NOT ok)::INT) OVER (PARTITION BY frame ORDER BY y, x, k) AS turn FROM e)
SELECT frame, y, x, quantile_disc(CASE WHEN ok THEN v WHEN turn % 2 = 1 THEN lo ELSE hi END, 0.5) AS med FROM m GROUP BY ALL""")
def raster_filled_median(spark, sf_dir):
    """Invalid entries are set in turn to the least and the greatest value."""
    m = rasters.filled_median(_rasters(spark, sf_dir).withColumn("m", F.transform("v", lambda v: (v > 0).cast("int"))), "v", "m", 3)
    p = rasters.pixels(m, ["frame"], med=F.col("filtered"))
    return p.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "med")


_CORNERS = " + ".join(f"e[(z0+{k})*16 + (y0+{j})*4 + x0+{i} + 1]::DOUBLE*{'fz' if k else '(1-fz)'}*{'fy' if j else '(1-fy)'}*{'fx' if i else '(1-fx)'}" for k in (0, 1) for j in (0, 1) for i in (0, 1))


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 50 AS vec_id, l_quantity / 50 * 3 AS x, l_discount * 30 AS y, l_tax * 37.5 AS z FROM lineitem),
c AS (SELECT l.*, embedding AS e, least(floor(x), 2)::INT AS x0, least(floor(y), 2)::INT AS y0, least(floor(z), 2)::INT AS z0 FROM l JOIN embeddings USING (vec_id)), f AS (SELECT *, x - x0 AS fx, y - y0 AS fy, z - z0 AS fz FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round({_CORNERS}, 5) AS sampled FROM f""")
def volume_trilinear(spark, sf_dir):
    """A vector of 64 values as a volume of 4 x 4 x 4."""
    from ..functions.raster import trilinear

    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).alias("vec_id"), (F.col("l_quantity") / 50 * 3).alias("x"), (F.col("l_discount") * 30).alias("y"), (F.col("l_tax") * 37.5).alias("z"))  # noqa: E741
    j = l.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return rounded(j.select("l_orderkey", "l_linenumber", "l_partkey", trilinear(F.col("embedding"), F.col("x"), F.col("y"), F.col("z"), 4, 4, 4).alias("sampled")))


@query(f"WITH {_PIX} SELECT frame, 12 AS h, 12 AS w, 2 AS top, round(sum(v * ((y + 2) * 12 + x + 2)), 4) AS weighed, true AS restored FROM px GROUP BY frame")
def pad_round_trip(spark, sf_dir):
    f = _rasters(spark, sf_dir).withColumn("kept", F.col("v"))
    p = rasters.pad_to_multiple(f, "v", 6)
    held = p.withColumn("weighed", F.aggregate(F.transform("v", lambda v, i: v * i), F.lit(0.0), lambda a, x: a + x)).withColumns({"h1": F.col("h"), "w1": F.col("w"), "top1": F.col("top")})
    back = rasters.unpadded(held, "v", 8, 8)
    return rounded(back.select("frame", F.col("h1").alias("h"), F.col("w1").alias("w"), F.col("top1").alias("top"), "weighed", (F.col("v") == F.col("kept")).alias("restored")), 4)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 50 AS vec_id, l_quantity / 6 AS px, l_discount * 90 AS py, l_tax - 0.01 AS depth, (l_partkey % 10) / 10.0 AS opacity FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM l JOIN embeddings USING (vec_id) WHERE depth > 1e-6 AND px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7 AND embedding[(round_even(py, 0) * 8 + round_even(px, 0))::INT + 1] > 0 AND opacity >= 0.3""")
def visible_centres(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 50).alias("frame"), (F.col("l_quantity") / 6).alias("px"), (F.col("l_discount") * 90).alias("py"), (F.col("l_tax") - 0.01).alias("depth"), (F.col("l_partkey") % 10 / 10.0).alias("opacity"))  # noqa: E741
    f = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.transform("embedding", lambda v: (v > 0).cast("double")).alias("mask"))
    return scene.visible_centres(l, f, 0.3).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {_PIX} SELECT frame, y, x FROM px WHERE v + 0.5 > 0.4 AND (x + y) % 3 > 0 AND NOT (frame % 5 = 0 OR v = 0)")
def rendered_tracks(spark, sf_dir):
    p = rasters.pixels(_rasters(spark, sf_dir), ["frame"], v=F.col("v"))
    held = p.withColumns({"alpha": F.col("v") + 0.5, "mask": (F.col("x") + F.col("y")) % 3, "track": F.array(F.lit(0.0), F.when(F.col("frame") % 5 == 0, 0.0).otherwise(F.col("v")))})
    return scene.rendered_tracks(held, "alpha", "mask", "track", 0.4).select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query("""WITH n AS (SELECT n_nationkey * 0.1 AS a, n_nationkey * 0.2 AS tx FROM nation), c AS (SELECT avg(-(cos(a) * tx - sin(a) * 3)) AS px, avg(-0.5) AS py, avg(-(sin(a) * tx + cos(a) * 3)) AS pz, avg(-sin(a)) AS zx, avg(cos(a)) AS zz FROM n),
u AS (SELECT *, zx / sqrt(zx*zx + zz*zz) AS ux, zz / sqrt(zx*zx + zz*zz) AS uz FROM c)
SELECT round(uz, 5) AS r00, round(-ux, 5) AS r02, round(-(uz * px - ux * pz), 5) AS t0, round(-py, 5) AS t1, round(-(ux * px + uz * pz), 5) AS t2 FROM u""")
def mean_camera(spark, sf_dir):
    m = scene.mean_camera(_cameras(spark, sf_dir))
    return m.select(*(F.round(F.get("w2c", F.lit(i)), 5).alias(n) for n, i in (("r00", 0), ("r02", 2), ("t0", 3), ("t1", 7), ("t2", 11))))


@query("SELECT round(max(sqrt((x - cx)^2 + (y - cy)^2)), 5) AS radius FROM (SELECT s_acctbal AS x, s_nationkey * 10.0 AS y FROM supplier), (SELECT avg(s_acctbal) AS cx, avg(s_nationkey * 10.0) AS cy FROM supplier)")
def camera_radius(spark, sf_dir):
    from ..operators.robust import camera_radius as radius

    s = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 10.0).alias("y"))
    return rounded(radius(s, ["x", "y"]))


@query("SELECT event_id, (event_id + 1) % 30 AS shown FROM events")
def playback(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scene.replay(F.col("event_id"), 30).alias("shown"))


@query("""WITH n AS (SELECT n_nationkey AS i, n_nationkey * 0.1 AS a, n_nationkey * 0.2 AS tx FROM nation), l AS (SELECT *, lead(a) OVER w AS b, lead(tx) OVER w AS ux FROM n WINDOW w AS (ORDER BY i))
SELECT i AS cam, round(cos(b - a), 5) AS r00, round(sin(b - a), 5) AS r02, round(ux - (cos(b-a) * tx + sin(b-a) * 3), 5) AS t0, round(3 - (cos(b-a) * 3 - sin(b-a) * tx), 5) AS t2 FROM l WHERE b IS NOT NULL""")
def relative_poses(spark, sf_dir):
    """From each camera to the next one."""
    r = scene.relative_transforms(_cameras(spark, sf_dir).withColumn("seq", F.lit(0)), "seq", "cam")
    at = lambda i: F.round(F.get("relative", F.lit(i)), 5)
    return r.select("cam", at(0).alias("r00"), at(2).alias("r02"), at(3).alias("t0"), at(11).alias("t2"))


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2, least(greatest(0.5 + embedding[4]::DOUBLE, 1e-6), 1 - 1e-6) AS c FROM embeddings),
d AS (SELECT a.vec_id, sqrt((a.e0-b.e0)^2 + (a.e1-b.e1)^2 + (a.e2-b.e2)^2) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.e0-b.e0)^2 + (a.e1-b.e1)^2 + (a.e2-b.e2)^2, b.vec_id) AS k FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, avg(d) AS m FROM d WHERE k <= 3 GROUP BY vec_id), q AS (SELECT quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM m)
SELECT vec_id, round(e0, 5) AS x, round(ln(least(greatest(m, lo), hi)), 5) AS s, round(ln(c / (1 - c)), 4) AS red, round(ln(0.7 / 0.3), 5) AS opacity, 1.0::DOUBLE AS quat FROM m JOIN e USING (vec_id), q""")
def initial_gaussians(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *embedding_dims(3), (0.5 + F.get("embedding", F.lit(3)).cast("double")).alias("red"))
    out = scene.initial_gaussians(e, "vec_id", ["e0", "e1", "e2"], ["red"], 0.05)
    at = lambda c, i=0: F.get(c, F.lit(i))
    norm = F.aggregate("quat", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", F.round(at("mean"), 5).alias("x"), F.round(at("log_scale", 2), 5).alias("s"), F.round(at("colour_logit"), 4).alias("red"), F.round("opacity_logit", 5).alias("opacity"), F.round(norm, 5).alias("quat"))
