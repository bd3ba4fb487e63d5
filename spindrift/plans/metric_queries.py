"""Metric and loss queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses, metrics
from .bind import ORACLE_SQL, QUERIES, TRACKS_SQL, query, rounded, table, track_order, track_table

_LAGGED = f"""WITH {TRACKS_SQL}, p AS (
  SELECT *, lag(x) OVER w AS px, lag(visible) OVER w AS pvis FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t)
), d AS (SELECT *, (x - px) * (x - px) AS sq FROM p WHERE px IS NOT NULL), th AS (SELECT unnest([4.0, 8.0, 16.0, 32.0, 64.0])::DOUBLE AS threshold)"""


def _lagged(spark, sf_dir):
    t = track_table(spark, sf_dir)
    p = t.withColumns({"px": F.lag("x").over(track_order()), "pvis": F.lag("visible").over(track_order())})
    return p.withColumns({"sq": (F.col("x") - F.col("px")) ** 2, "evaluated": F.col("px").isNotNull()})


@query(f"""{_LAGGED}, g AS (
  SELECT threshold, track_id, count(*) FILTER (sq < threshold * threshold) AS n, count(*) AS c FROM d, th WHERE visible GROUP BY ALL)
SELECT threshold, round(sum(n)::DOUBLE / sum(c), 5) AS frac_correct, round(avg(n::DOUBLE / c), 5) AS mean_group_pck FROM g GROUP BY threshold""")
def pck_threshold_sweep(spark, sf_dir):
    return rounded(metrics.pck(_lagged(spark, sf_dir), "track_id", "sq", "visible", "evaluated"))


@query(f"""{_LAGGED}, j AS (
  SELECT threshold, count(*) FILTER (sq < threshold * threshold AND visible AND pvis)::DOUBLE
    / (count(*) FILTER (visible) + count(*) FILTER (pvis AND NOT (visible AND sq < threshold * threshold))) AS jaccard,
    count(*) FILTER (visible = pvis)::DOUBLE / count(*) AS occ FROM d, th GROUP BY threshold)
SELECT threshold, round(jaccard, 5) AS jaccard, round(avg(jaccard) OVER (), 5) AS average_jaccard, round(occ, 5) AS occlusion_accuracy FROM j""")
def tracking_jaccard_occlusion(spark, sf_dir):
    return rounded(metrics.jaccard(_lagged(spark, sf_dir), "sq", "visible", "pvis", "evaluated"))


@query("""SELECT l_returnflag, l_linestatus, round(-10 * log10(sum(((l_discount - l_tax)^2 + (l_discount - 0.5 * l_tax)^2 + (l_tax - 0.04)^2)
  * (l_quantity > 10)::INT) / (sum((l_quantity > 10)::INT) * 3.0)), 5) AS psnr FROM lineitem GROUP BY ALL""")
def psnr_mean_of_groups(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    mask = (F.col("l_quantity") > 10).cast("double")
    return rounded(metrics.psnr(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [d - t, d - 0.5 * t, t - 0.04], mask))


@query(f"""WITH {TRACKS_SQL}, d AS (SELECT track_id, t // 8 AS pair, abs(x - y) / 100 AS d FROM tracks WHERE visible AND z < 8),
g AS (SELECT avg(d) AS epe, count(*) FILTER (d < 0.1)::DOUBLE / count(*) AS p0, count(*) FILTER (d < 0.05)::DOUBLE / count(*) AS p1 FROM d GROUP BY track_id, pair)
SELECT round(avg(epe), 5) AS epe, round(avg(p0), 5) AS pck_0, round(avg(p1), 5) AS pck_1, count(*) AS pairs FROM g""")
def endpoint_error_pairs(spark, sf_dir):
    t = track_table(spark, sf_dir).withColumn("pair", F.floor(F.col("t") / 8))
    return rounded(metrics.endpoint_error(t, ["track_id", "pair"], F.abs(F.col("x") - F.col("y")) / 100, F.col("visible") & (F.col("z") < 8)))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (abs(value / 10 - (event_id % 40)) * 0.02 < 0.05) AS n_visible FROM events GROUP BY ALL""")
def depth_test_visibility(spark, sf_dir):
    e = metrics.depth_visibility(table(spark, sf_dir, "events"), F.col("value") / 10, F.col("event_id") % 40, 0.02)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("pred_visible").alias("n_visible"))


_POSES = """p AS (SELECT track_id, t, x / 10 AS x, y / 10 AS y, (event_id % 360) * 0.01 AS a, x / 10 + 0.01 * (event_id % 3) AS gx, y / 10 - 0.02 * (event_id % 5) AS gy, (event_id % 360) * 0.01 + 0.001 * (event_id % 7) AS ga FROM tracks)"""


@query(f"""WITH {TRACKS_SQL}, {_POSES}, s AS (
  SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(a) OVER w - a AS da, lead(gx) OVER w - gx AS ex, lead(gy) OVER w - gy AS ey, lead(ga) OVER w - ga AS ea
  FROM p WINDOW w AS (PARTITION BY track_id ORDER BY t)
), r AS (SELECT *, cos(a) * dx + sin(a) * dy AS px, cos(a) * dy - sin(a) * dx AS py, cos(ga) * ex + sin(ga) * ey AS qx, cos(ga) * ey - sin(ga) * ex AS qy FROM s)
SELECT track_id, round(avg(sqrt((x - gx)^2 + (y - gy)^2)), 5) AS ate, round(avg(sqrt((px - qx)^2 + (py - qy)^2)), 5) AS rpe_t,
  round(avg(degrees(acos(least(greatest(cos(da - ea), -1.0), 1.0)))), 4) AS rpe_r FROM r GROUP BY track_id""")
def pose_errors(spark, sf_dir):
    t = track_table(spark, sf_dir)
    a, i = (F.col("event_id") % 360) * 0.01, F.col("event_id")
    p = t.select("track_id", "t", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), a.alias("a"), (F.col("x") / 10 + 0.01 * (i % 3)).alias("gx"), (F.col("y") / 10 - 0.02 * (i % 5)).alias("gy"), (a + 0.001 * (i % 7)).alias("ga"))
    out = metrics.pose_errors(p, "track_id", "t")
    return out.select("track_id", F.round("ate", 5).alias("ate"), F.round("rpe_t", 5).alias("rpe_t"), F.round("rpe_r", 4).alias("rpe_r"))


@query("""WITH m AS (SELECT l.doc_id % 10 AS grp, l.quality = 1 AS a, l.toxic = 0 AS b FROM labels l JOIN documents d USING (doc_id))
SELECT grp, round((count(*) FILTER (a AND b) + 1e-6) / (count(*) FILTER (a OR b) + 1e-6), 5) AS iou,
  round(1 - (2 * count(*) FILTER (a AND b) + 1.0) / (count(*) FILTER (a) + count(*) FILTER (b) + 1.0), 5) AS dice_loss FROM m GROUP BY grp""")
def mask_iou_dice(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumn("grp", F.col("doc_id") % 10)
    return rounded(metrics.mask_overlap(d, ["grp"], F.col("quality") == 1, F.col("toxic") == 0))


@query("""WITH r AS (SELECT l_returnflag, abs(l_discount - l_tax) + l_orderkey * 1e-9 AS loss, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(l_discount - l_tax) + l_orderkey * 1e-9 DESC) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, round(avg(loss), 5) AS bootstrapped FROM r WHERE k <= floor(n * 0.15) GROUP BY ALL""")
def bootstrapped_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.abs(F.col("l_discount") - F.col("l_tax")) + F.col("l_orderkey") * 1e-9).alias("loss"))
    return rounded(metrics.bootstrapped_loss(rows, ["l_returnflag"], "loss", 0.15))


@query("""WITH p AS (SELECT l_orderkey AS pixel, l_linenumber AS obj, max(l_discount * 4 + 0.05) AS p FROM lineitem GROUP BY ALL),
b AS (SELECT *, exp(sum(ln(greatest(1 - p, 1e-300))) OVER (PARTITION BY pixel)) AS bg, least(greatest(p, 1e-7), 1 - 1e-7) / (1 - least(greatest(p, 1e-7), 1 - 1e-7)) AS o FROM p),
t AS (SELECT *, least(greatest(bg, 1e-7), 1 - 1e-7) / (1 - least(greatest(bg, 1e-7), 1 - 1e-7)) AS ob, sum(o) OVER (PARTITION BY pixel) AS s FROM b)
SELECT pixel, obj, round(o / (s + ob), 7) AS prob FROM t UNION ALL SELECT pixel, 0, round(any_value(ob) / (any_value(s) + any_value(ob)), 7) FROM t GROUP BY pixel""")
def soft_aggregate(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pixel"), F.col("l_linenumber").alias("obj")).agg(F.max(F.col("l_discount") * 4 + 0.05).alias("p"))
    return rounded(metrics.soft_aggregate(p, ["pixel"], "obj", "p"), 7)


@query()
def masked_ssim(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    image = F.transform("embedding", lambda v: v.cast("double") + 0.5)
    other = F.transform("embedding", lambda v, i: v.cast("double") * 0.9 + 0.5 + (i % 3) * 0.01)
    mask = F.transform("embedding", lambda v, i: (i % 9 != 0).cast("double"))
    return rounded(metrics.ssim(e.select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), image.alias("pred"), other.alias("target"), mask.alias("mask")), size=3))


# --- losses -----------------------------------------------------------------

_FIT = "f AS (SELECT l_extendedprice AS pred, 1000 * l_quantity AS gt, 1 - l_discount AS m FROM lineitem)"


def _fit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("pred"), (1000 * F.col("l_quantity")).alias("gt"), (1 - F.col("l_discount")).alias("m"))


def _trim_sql(loss: str, where: str = "") -> str:
    return f"WITH {_FIT}, l AS (SELECT {loss} AS l, m FROM f), t AS (SELECT quantile_cont(l, 0.98) AS th FROM l) SELECT round(sum(l * m) / (sum(m) + 1e-8), 3) AS loss FROM l, t WHERE l < th"


@query(_trim_sql("abs(pred - gt)"))
def masked_trimmed_l1(spark, sf_dir):
    return rounded(losses.masked_l1(_fit(spark, sf_dir), "pred", "gt", F.col("m"), 0.98), 3)


@query(f"WITH {_FIT}, l AS (SELECT (pred - gt) * (pred - gt) / 1e6 AS l, m FROM f), t AS (SELECT quantile_cont(l, 0.98) AS th FROM l) SELECT round(sum(l * m) / (sum(m) + 1e-8), 3) AS loss FROM l, t WHERE l < th")
def masked_mse(spark, sf_dir):
    scaled = _fit(spark, sf_dir).select((F.col("pred") / 1000).alias("pred"), (F.col("gt") / 1000).alias("gt"), "m")
    return rounded(losses.masked_mse(scaled, "pred", "gt", F.col("m"), 0.98), 3)


@query(f"WITH {_FIT} SELECT round(sum(m * CASE WHEN abs(pred - gt) <= 500 THEN 0.5 * (pred - gt)^2 ELSE 500 * (abs(pred - gt) - 250) END) / (sum(m) + 1e-8), 2) AS loss FROM f")
def masked_huber(spark, sf_dir):
    return rounded(losses.masked_huber(_fit(spark, sf_dir), "pred", "gt", 500.0, F.col("m")), 2)


@query(f"WITH {_FIT}, l AS (SELECT abs(pred - gt) AS l FROM f), t AS (SELECT quantile_cont(l, 0.9) AS th FROM l) SELECT round(avg(l), 3) AS loss FROM l, t WHERE l < th")
def trimmed_l1_mean(spark, sf_dir):
    return rounded(losses.masked_l1(_fit(spark, sf_dir), "pred", "gt", None, 0.9), 3)


@query(f"""WITH {_FIT}, a AS (SELECT abs(pred - gt) AS l, m FROM f), t AS (SELECT quantile_cont(l, 0.98) AS th FROM a),
x AS (SELECT 'track' AS name, 2.0 AS weight, (SELECT sum(l * m) / (sum(m) + 1e-8) FROM a, t WHERE l < th) AS loss
UNION ALL SELECT 'depth', 0.5, (SELECT sum(m * CASE WHEN abs(pred - gt) <= 500 THEN 0.5 * (pred - gt)^2 ELSE 500 * (abs(pred - gt) - 250) END) / (sum(m) + 1e-8) FROM f))
SELECT name, weight::DOUBLE AS weight, round(loss, 2) AS loss, round(sum(weight * loss) OVER (), 2) AS total FROM x""")
def weighted_total_loss(spark, sf_dir):
    f = _fit(spark, sf_dir)
    return rounded(losses.total_loss({"track": (2.0, losses.masked_l1(f, "pred", "gt", F.col("m"), 0.98)), "depth": (0.5, losses.masked_huber(f, "pred", "gt", 500.0, F.col("m")))}), 2)


@query("SELECT round(avg(var), 6) AS loss FROM (SELECT (SELECT var_samp(v) FROM (SELECT unnest([l_quantity, l_discount * 100, l_tax * 100]) AS v)) AS var FROM lineitem)")
def scale_variance(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    return rounded(losses.mean_scale_variance(s, ["a", "b", "c"]), 6)


@query("SELECT round(1 - avg(list_sum(list_transform(embedding, lambda c: c::DOUBLE * c::DOUBLE))), 6) AS loss FROM embeddings")
def coefficient_sparsity(spark, sf_dir):
    return rounded(losses.coefficient_sparsity(table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("c")), "c"), 6)


@query("""WITH r AS (SELECT l_returnflag AS f, l_discount * 12 - 0.2 AS d, l_tax * 10 AS r FROM lineitem), q AS (SELECT f, min(r) AS lo, quantile_cont(r, 0.98) AS hi FROM r GROUP BY f)
SELECT round(coalesce(avg(lo - d) FILTER (d < lo), 0) + coalesce(avg(d - hi) FILTER (d > hi), 0), 5) AS loss FROM r JOIN q USING (f)""")
def depth_range_hinge(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), (F.col("l_discount") * 12 - 0.2).alias("d"), (F.col("l_tax") * 10).alias("r"))
    return rounded(losses.depth_range_hinge(r, "f", "d", "r"))


@query(f"WITH {_FIT}, l AS (SELECT (pred - gt) * (pred - gt) / 1e6 AS l FROM f), t AS (SELECT quantile_cont(l, 0.9) AS th FROM l) SELECT round(avg(l), 3) AS loss FROM l, t WHERE l < th")
def trimmed_mse_mean(spark, sf_dir):
    scaled = _fit(spark, sf_dir).select((F.col("pred") / 1000).alias("pred"), (F.col("gt") / 1000).alias("gt"))
    return rounded(losses.masked_mse(scaled, "pred", "gt", None, 0.9), 3)


@query("SELECT event_id AS step, round(CASE WHEN event_id < 200 THEN 1.0 WHEN event_id > 700 THEN 0.15 ELSE 0.15 + 0.85 * (700 - event_id) / 500.0 END, 6) AS share FROM events")
def annealed_share(spark, sf_dir):
    """The share of hardest losses as it falls from step to step."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.round(metrics.annealed_share(F.col("event_id"), 200, 700, 0.15), 6).alias("share"))


def _about_y(a, x, y, z):
    c, s = F.cos(a), F.sin(a)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(c, zero, s, x, zero, one, zero, y, -s, zero, c, z, zero, zero, zero, one)


@query(f"""WITH {TRACKS_SQL}, p AS (SELECT track_id, t, x / 10 AS x, y / 10 AS y, z, event_id * 0.01 AS a, x / 10 + 0.01 * (event_id % 3) AS gx, y / 10 - 0.02 AS gy, z + 0.03 * (event_id % 4) AS gz, event_id * 0.01 + 0.001 * (event_id % 7) AS ga FROM tracks),
s AS (SELECT *, {', '.join(f'lead({c}) OVER w - {c} AS d{c}' for c in ('x', 'y', 'z', 'a', 'gx', 'gy', 'gz', 'ga'))} FROM p WINDOW w AS (PARTITION BY track_id ORDER BY t)),
r AS (SELECT *, cos(a) * dx - sin(a) * dz AS px, sin(a) * dx + cos(a) * dz AS pz, cos(ga) * dgx - sin(ga) * dgz AS qx, sin(ga) * dgx + cos(ga) * dgz AS qz FROM s)
SELECT track_id, round(avg(sqrt((x-gx)^2 + (y-gy)^2 + (z-gz)^2)), 5) AS ate, round(avg(sqrt((px-qx)^2 + (dy-dgy)^2 + (pz-qz)^2)), 5) AS rpe_t, round(avg(degrees(acos(least(greatest(cos(da - dga), -1.0), 1.0)))), 3) AS rpe_r FROM r GROUP BY track_id""")
def rigid_pose_errors(spark, sf_dir):
    """Whole camera poses, turned about y."""
    t, i = track_table(spark, sf_dir), F.col("event_id")
    p = t.select("track_id", "t", _about_y(i * 0.01, F.col("x") / 10, F.col("y") / 10, F.col("z")).alias("pred"), _about_y(i * 0.01 + 0.001 * (i % 7), F.col("x") / 10 + 0.01 * (i % 3), F.col("y") / 10 - 0.02, F.col("z") + 0.03 * (i % 4)).alias("target"))
    out = metrics.rigid_pose_errors(p, "track_id", "t")
    return out.select("track_id", F.round("ate", 5).alias("ate"), F.round("rpe_t", 5).alias("rpe_t"), F.round("rpe_r", 3).alias("rpe_r"))


@query(f"""WITH {TRACKS_SQL}, p AS (SELECT track_id % 10 AS pair, sqrt((0.01 * (event_id % 9))^2 + (0.02 * (event_id % 4))^2) AS d FROM tracks WHERE visible), g AS (SELECT pair, avg(d) AS epe, avg((d < 0.1 + 1e-9)::INT) AS a, avg((d < 0.05 + 1e-9)::INT) AS b FROM p GROUP BY pair)
SELECT round(avg(epe), 5) AS epe, round(avg(a), 5) AS pck_0, round(avg(b), 5) AS pck_1, count(*) AS pairs FROM g""")
def aligned_endpoint_error(spark, sf_dir):
    """Predictions in a frame that is turned, moved and 2.5 times as large: the cameras tell how."""
    from ..functions import geometry as g

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    centre = [F.col("n") * 1.0, F.col("n") % 5 * 2.0, F.col("n") % 3 * 1.5]
    away = lambda x, y, z: [(0.6 * x - 0.8 * z) / 2.5 - 1.0, y / 2.5 + 2.0, (0.8 * x + 0.6 * z) / 2.5 - 0.5]
    one = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    w2c = lambda c: g.pack(g.rigid(one, [-v for v in c]))
    cameras = n.select(w2c(centre).alias("w2c"), w2c(away(*centre)).alias("pred_w2c"))
    t, i = track_table(spark, sf_dir), F.col("event_id")
    moved = away(F.col("x") + 0.01 * (i % 9), F.col("y"), F.col("z") + 0.02 * (i % 4))
    p = t.select((F.col("track_id") % 10).alias("pair"), "visible", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), *(c.alias(a) for a, c in zip("xyz", moved, strict=True)))
    return rounded(metrics.aligned_endpoint_error(p, cameras, ["pair"], F.col("visible"), (0.1 + 1e-9, 0.05 + 1e-9)))


_WINDOW = "SELECT exp(-0.5 / 2.25) / (1 + 2 * exp(-0.5 / 2.25)) AS a, 1 / (1 + 2 * exp(-0.5 / 2.25)) AS b"
_FIVE = {"p": "p", "t": "t", "pp": "p * p", "tt": "t * t", "pt": "p * t"}


def _ssim_sql() -> str:
    """Windows of three: sums along x over the mask's share of them, then along y over the share of windows with any mask."""
    pixels = "px AS (SELECT vec_id AS frame, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE + 0.5 AS p, embedding[i + 1]::DOUBLE * 0.9 + 0.5 + i % 3 * 0.01 AS t, (i % 9 <> 0)::INT AS m FROM embeddings, range(64) r(i))"
    across = ", ".join(f"(a * ({v}) * m + b * lead(({v}) * m) OVER w + a * lead(({v}) * m, 2) OVER w) AS {n}" for n, v in _FIVE.items())
    held = ", ".join(f"CASE WHEN seen > 0 THEN {n} * 3 / seen ELSE 0 END AS {n}" for n in _FIVE)
    down = ", ".join(f"(a * {n} + b * lead({n}) OVER w + a * lead({n}, 2) OVER w) AS {n}" for n in _FIVE)
    kept = ", ".join(f"CASE WHEN seen > 0 THEN {n} * 3 / seen ELSE 0 END AS {n}" for n in _FIVE)
    return f"""WITH k AS ({_WINDOW}), {pixels},
h0 AS (SELECT frame, y, x, {across}, m + lead(m) OVER w + lead(m, 2) OVER w AS seen FROM px, k WINDOW w AS (PARTITION BY frame, y ORDER BY x)),
h AS (SELECT frame, y, x, {held}, (seen > 0)::INT AS m FROM h0 WHERE x <= 5),
v0 AS (SELECT frame, y, x, {down}, m + lead(m) OVER w + lead(m, 2) OVER w AS seen FROM h, k WINDOW w AS (PARTITION BY frame, x ORDER BY y)),
v AS (SELECT frame, {kept} FROM v0 WHERE y <= 5),
s AS (SELECT frame, p, t, greatest(pp - p * p, 0) AS vp, greatest(tt - t * t, 0) AS vt, pt - p * t AS c FROM v),
r AS (SELECT *, least(greatest(c, -sqrt(vp * vt)), sqrt(vp * vt)) AS cov FROM s),
ssim AS (SELECT frame, avg((2 * p * t + 1e-4) * (2 * cov + 9e-4) / ((p * p + t * t + 1e-4) * (vp + vt + 9e-4))) AS ssim FROM r GROUP BY frame)"""


ORACLE_SQL["masked_ssim"] = _ssim_sql() + " SELECT frame, round(ssim, 5) AS ssim FROM ssim"

_PSNR = "psnr AS (SELECT frame, -10 * log10(sum((p - t) * (p - t) * m) / greatest(sum(m), 1)) AS psnr FROM px GROUP BY frame)"


def _views(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    image = F.transform("embedding", lambda v: v.cast("double") + 0.5)
    other = F.transform("embedding", lambda v, i: v.cast("double") * 0.9 + 0.5 + (i % 3) * 0.01)
    mask = F.transform("embedding", lambda v, i: (i % 9 != 0).cast("double"))
    return e.select(F.col("vec_id").alias("frame"), F.lit(8).alias("h"), F.lit(8).alias("w"), image.alias("pred"), other.alias("target"), mask.alias("mask"))


@query(_ssim_sql() + f", {_PSNR} SELECT count(*) AS frames, round(avg(psnr), 4) AS psnr, round(avg(ssim), 5) AS ssim FROM psnr JOIN ssim USING (frame)")
def novel_view_report(spark, sf_dir):
    """Image metrics over what two views share, as means of the frames."""
    out = metrics.image_report(_views(spark, sf_dir), 3)
    return out.select("frames", F.round("psnr", 4).alias("psnr"), F.round("ssim", 5).alias("ssim"))


@query(_ssim_sql() + f""", {_PSNR}, {TRACKS_SQL}, k AS (SELECT (0.5 * (event_id % 30) + 0.1)^2 AS d FROM tracks WHERE visible)
SELECT 'psnr' AS metric, round((SELECT avg(psnr) FROM psnr), 4) AS value UNION ALL SELECT 'ssim', round((SELECT avg(ssim) FROM ssim), 4) UNION ALL SELECT 'pck_0', round((SELECT avg((d < 25)::INT) FROM k), 4) UNION ALL SELECT 'pck_1', round((SELECT avg((d < 100)::INT) FROM k), 4)""".replace(", k AS (SELECT (0.5", ", kp AS (SELECT (0.5").replace("FROM k)", "FROM kp)"))
def validation_report(spark, sf_dir):
    t = track_table(spark, sf_dir).select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + 0.5 * (F.col("event_id") % 30) + 0.1).alias("tx"), F.col("y").alias("ty"), "visible")
    return rounded(metrics.validation_report(_views(spark, sf_dir), t, 3), 4)


@query("SELECT event_type, round(avg(value), 5) AS value FROM events GROUP BY event_type")
def merged_means(spark, sf_dir):
    """Batches of events add to running means, merged afterwards."""
    e = table(spark, sf_dir, "events")
    parts = [metrics.partial_means(e.where(F.col("event_id") % 3 == i), ["event_type"], ["value"]) for i in range(3)]
    return rounded(metrics.merged_means(parts[0].unionAll(parts[1]).unionAll(parts[2]), ["event_type"], ["value"]))


_TERMS = {"track": (2.0, "masked_trimmed_l1"), "mask": (1.0, "masked_mse"), "depth": (0.5, "masked_huber"), "depth_grad": (1.0, "raster_gradient_loss"), "accel": (0.1, "accel_loss"), "scale_var": (0.01, "scale_variance"), "sparsity": (0.01, "coefficient_sparsity"), "range": (0.05, "depth_range_hinge")}
