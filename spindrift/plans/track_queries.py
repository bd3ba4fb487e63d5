"""Track, robust-statistics and sequence queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import robust, tracks
from .bind import TRACKS_SQL, embedding_dims, embedding_sql, query, rounded, table, track_table


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, 1 - 1 / (1 + exp(-(l_discount - 0.05) * 40)) AS s, 1 - 1 / (1 + exp(-(l_tax - 0.04) * 40)) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, s * c > 0.5 AS visible, (1 - s) * c > 0.5 AS invisible, round(CASE WHEN s * c > 0.5 OR (1 - s) * c > 0.5 THEN c ELSE 0 END, 5) AS confidence FROM v""")
def visibility_decode(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    out = tracks.decode_visibility(l, (F.col("l_discount") - 0.05) * 40, (F.col("l_tax") - 0.04) * 40)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "visible", "invisible", "confidence"))


@query(f"""WITH {TRACKS_SQL}, c AS (SELECT track_id, count(*) FILTER (visible) AS visible_count FROM tracks GROUP BY ALL)
SELECT track_id, visible_count FROM c WHERE visible_count >= (SELECT least(50.0, quantile_cont(visible_count, 0.1)) FROM c)""")
def track_valid_filter(spark, sf_dir):
    return tracks.valid_tracks(track_table(spark, sf_dir), 1000)


_FILL = """i AS (SELECT *, last_value(CASE WHEN visible THEN t END IGNORE NULLS) OVER b AS t0, last_value(CASE WHEN visible THEN x END IGNORE NULLS) OVER b AS x0,
  first_value(CASE WHEN visible THEN t END IGNORE NULLS) OVER a AS t1, first_value(CASE WHEN visible THEN x END IGNORE NULLS) OVER a AS x1 FROM tracks
  WINDOW b AS (PARTITION BY track_id{p} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track_id{p} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, t, round(CASE WHEN t0 IS NULL THEN x1 WHEN t1 IS NULL THEN x0 WHEN t0 = t1 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END, 5) AS filled FROM i"""


@query(f"WITH {TRACKS_SQL}, {_FILL.format(p='')}")
def masked_interpolation(spark, sf_dir):
    return rounded(tracks.interpolate_masked(track_table(spark, sf_dir), "x", "visible").select("track_id", "t", "filled"))


@query(f"WITH {TRACKS_SQL}, {_FILL.format(p=', t // 64')}")
def masked_interpolation_blocks(spark, sf_dir):
    return rounded(tracks.interpolate_masked(track_table(spark, sf_dir), "x", "visible", block=64).select("track_id", "t", "filled"))


@query(f"""WITH {TRACKS_SQL}, v AS (SELECT track_id, t, CASE WHEN visible THEN x END AS v FROM tracks),
o AS (SELECT track_id, t, last_value(v IGNORE NULLS) OVER (PARTITION BY track_id, t >= 20 ORDER BY abs(t - 20) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own,
  max(CASE WHEN t = 20 THEN v END) OVER (PARTITION BY track_id) AS origin FROM v)
SELECT track_id, t, coalesce(own, origin) AS carried FROM o""")
def carry_previous_outward(spark, sf_dir):
    t = track_table(spark, sf_dir)
    return tracks.carry_outward(t, F.when(F.col("visible"), F.col("x")), F.lit(20), ["track_id"]).select("track_id", "t", "carried")


@query(f"""WITH {TRACKS_SQL}, a AS (SELECT sqrt((2*x - lag(x) OVER w - lead(x) OVER w)^2 + (2*y - lag(y) OVER w - lead(y) OVER w)^2 + (2*z - lag(z) OVER w - lead(z) OVER w)^2) AS l FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t))
SELECT round(avg(l), 4) AS loss FROM a""")
def accel_loss(spark, sf_dir):
    return rounded(tracks.accel_loss(track_table(spark, sf_dir), ["x", "y", "z"], ["track_id"]), 4)


@query(f"""WITH {TRACKS_SQL}, a AS (SELECT sqrt((2*x - lag(x) OVER w - lead(x) OVER w)^2 + (2*y - lag(y) OVER w - lead(y) OVER w)^2) AS r, abs(2*z - lag(z) OVER w - lead(z) OVER w) AS s FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t))
SELECT round(avg(r) + 2 * avg(s), 4) AS loss FROM a""")
def se3_smoothness(spark, sf_dir):
    return rounded(tracks.smoothness_loss(track_table(spark, sf_dir), ["x", "y"], ["z"], ["track_id"]), 4)


@query(f"""WITH {TRACKS_SQL}, v AS (SELECT track_id, t, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, z - lag(z) OVER w AS vz FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t))
SELECT track_id, t, round(vx / (sqrt(vx*vx + vy*vy + vz*vz) + 1e-5), 5) AS u_x, round(vy / (sqrt(vx*vx + vy*vy + vz*vz) + 1e-5), 5) AS u_y, round(vz / (sqrt(vx*vx + vy*vy + vz*vz) + 1e-5), 5) AS u_z FROM v WHERE vx IS NOT NULL""")
def velocity_dirs(spark, sf_dir):
    return rounded(tracks.velocity_directions(track_table(spark, sf_dir), ["x", "y", "z"]))


@query(f"""WITH {TRACKS_SQL}, r AS (SELECT track_id, t, x, y, z, sqrt(x*x + y*y + (z - 1)*(z - 1)) AS n FROM tracks),
d AS (SELECT ((x - lag(x) OVER w) * x + (y - lag(y) OVER w) * y + (z - lag(z) OVER w) * (z - 1)) / n AS b, ((lead(x) OVER w - x) * x + (lead(y) OVER w - y) * y + (lead(z) OVER w - z) * (z - 1)) / n AS a FROM r WINDOW w AS (PARTITION BY track_id ORDER BY t))
SELECT round(avg(b * b) + avg(a * a), 3) AS loss FROM d WHERE a IS NOT NULL AND b IS NOT NULL""")
def ray_velocity_penalty(spark, sf_dir):
    return rounded(tracks.ray_velocity_penalty(track_table(spark, sf_dir), ["x", "y", "z"], [F.lit(0.0), F.lit(0.0), F.lit(1.0)], ["track_id"]), 3)


@query(f"WITH {TRACKS_SQL}, c AS (SELECT t, count(*) FILTER (visible) AS n FROM tracks GROUP BY t) SELECT t AS frame, n AS visible_count FROM c ORDER BY n DESC, t LIMIT 1")
def canonical_frame(spark, sf_dir):
    return tracks.canonical_frame(track_table(spark, sf_dir))


@query(f"""WITH {TRACKS_SQL} SELECT track_id, t, round(avg(x) OVER w, 8) AS trail_x, round(avg(y) OVER w, 8) AS trail_y, count(*) OVER w AS trail_n FROM tracks
WINDOW w AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def trailing_window(spark, sf_dir):
    return rounded(tracks.trailing_window(track_table(spark, sf_dir), ["x", "y"]).select("track_id", "t", "trail_x", "trail_y", "trail_n"), 8)


@query(f"""WITH {TRACKS_SQL}, r AS (SELECT track_id, t, x FROM tracks UNION ALL SELECT track_id, (SELECT max(t) FROM tracks b WHERE b.track_id = a.track_id) + 1, x FROM tracks a WHERE t = 0),
w AS (SELECT track_id, t, CASE WHEN t = 0 THEN 0 ELSE x END AS s FROM r) SELECT track_id, t, round(sum(s) OVER (PARTITION BY track_id ORDER BY t), 4) AS at FROM w""")
def camera_path_cumsum(spark, sf_dir):
    t = track_table(spark, sf_dir).select("track_id", F.col("t").cast("long").alias("t"), "x")
    return rounded(tracks.cumulative_times(t, "track_id", "t", "x", loop=True).select("track_id", "t", "at"), 4)


@query(f"""WITH {TRACKS_SQL}, a AS (SELECT track_id, avg(x) AS d, bool_or(visible) AS seen FROM tracks GROUP BY ALL)
SELECT track_id, round(d, 5) AS d FROM a WHERE seen AND d < (SELECT quantile_cont(d, 0.95) FROM a)""")
def outlier_cut(spark, sf_dir):
    return rounded(robust.outlier_cut(track_table(spark, sf_dir), "track_id", "x", "visible"))


# --- robust statistics -----------------------------------------------------------

_AXES = "SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem"


def _axes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


@query(f"""WITH a AS ({_AXES}) SELECT round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, round(avg(z), 4) AS cz,
  round(greatest((quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / 2, (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2, (quantile_cont(z, 0.95) - quantile_cont(z, 0.05)) / 2), 4) AS scale FROM a""")
def scene_norm(spark, sf_dir):
    return rounded(robust.spread(_axes(spark, sf_dir), ["x", "y", "z"]), 4)


@query("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), u AS (SELECT vec_id, a / sqrt(a*a+b*b+c*c) AS x, b / sqrt(a*a+b*b+c*c) AS y, c / sqrt(a*a+b*b+c*c) AS z FROM v)
SELECT vec_id, round(1 - x*x / (1 - y), 5) AS r00, round(x, 5) AS r01, round(-x * z / (1 - y), 5) AS r02, round(-y, 5) AS r11 FROM u""")
def up_rotation(spark, sf_dir):
    r = robust.up_rotation(g.unpack(F.col("embedding"), 3))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", r[0].alias("r00"), r[1].alias("r01"), r[2].alias("r02"), r[4].alias("r11")))


@query("""WITH c AS (SELECT l_linestatus AS k, l_quantity AS m, l_extendedprice AS r, median(l_quantity) OVER w AS m0, median(l_extendedprice) OVER w AS r0 FROM lineitem WINDOW w AS (PARTITION BY l_linestatus)),
s AS (SELECT *, median((r - r0 + 1e-8) / (m - m0 + 1e-8)) OVER (PARTITION BY k) AS scale FROM c) SELECT k, round(any_value(scale), 3) AS scale, round(median(r - scale * m), 3) AS shift FROM s GROUP BY k""")
def depth_align_scale_shift(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), F.col("l_quantity").alias("m"), F.col("l_extendedprice").alias("r"))  # noqa: E741
    return rounded(robust.align_scale_shift(l, "k", "m", "r"), 3)


@query("""WITH f AS (SELECT l_suppkey AS f, median(l_extendedprice / l_quantity) AS r, count(*) AS n FROM lineitem WHERE l_quantity > 1 GROUP BY ALL) SELECT round(coalesce(median(r), 1), 4) AS scale FROM f WHERE n > 20""")
def pose_scale(spark, sf_dir):
    return rounded(robust.nested_median_ratio(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_quantity") > 1, 20), 4)


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *embedding_dims(3))


_EMB = f"e AS (SELECT vec_id, label, {embedding_sql(3)} FROM embeddings)"


@query(f"WITH {_EMB} SELECT label, quantile_disc(e0, 0.5) AS e0, quantile_disc(e1, 0.5) AS e1, quantile_disc(e2, 0.5) AS e2, count(*) AS n FROM e GROUP BY label HAVING count(*) > 40")
def cluster_lower_median(spark, sf_dir):
    return robust.cluster_centres(_labelled(spark, sf_dir), "label", ["e0", "e1", "e2"], 40)


@query(f"""WITH {_EMB}, m AS (SELECT label, quantile_disc(e0, 0.5) AS a, quantile_disc(e1, 0.5) AS b, quantile_disc(e2, 0.5) AS c FROM e GROUP BY label),
d AS (SELECT vec_id, label, sqrt((e0-a)^2 + (e1-b)^2 + (e2-c)^2) AS raw FROM e JOIN m USING (label)), q AS (SELECT label, quantile_disc(raw, 0.5) AS mid FROM d GROUP BY label),
r AS (SELECT vec_id, label, raw / mid AS dist FROM d JOIN q USING (label)), w AS (SELECT *, exp(-dist) / (avg(exp(-dist)) OVER (PARTITION BY label) + 1e-6) AS w FROM r)
SELECT vec_id, label, round(dist, 5) AS dist, round(CASE WHEN dist > (SELECT quantile_cont(dist, 0.9) FROM w) THEN 0 ELSE w END, 5) AS weight FROM w""")
def procrustes_weights(spark, sf_dir):
    return rounded(robust.centre_weights(_labelled(spark, sf_dir), "label", ["e0", "e1", "e2"]).select("vec_id", "label", "dist", "weight"))


@query("SELECT round(quantile_cont(l_extendedprice, 0.37), 4) AS q37, round(quantile_cont(l_extendedprice, 0.999), 4) AS q999 FROM lineitem")
def exact_quantile_histogram(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a, b = (robust.exact_quantile(l, "l_extendedprice", q) for q in (0.37, 0.999))
    return spark.range(1).select(F.round(F.lit(a), 4).alias("q37"), F.round(F.lit(b), 4).alias("q999"))


@query(f"WITH a AS ({_AXES}) SELECT min(x) AS min_x, max(x) AS max_x, round(min(y), 8) AS min_y, round(max(y), 8) AS max_y, round((max(x) - min(x)) * 1.25, 8) AS size_x, round((max(y) - min(y)) * 1.25, 8) AS size_y FROM a")
def camera_bounds(spark, sf_dir):
    return rounded(robust.bounding_box(_axes(spark, sf_dir), ["x", "y"]), 8)


@query(f"WITH a AS ({_AXES}) SELECT round(avg(x), 4) AS mean_x, median(x) AS median_x, round(avg(y), 4) AS mean_y, round(median(y), 4) AS median_y FROM a")
def intrinsics_summary(spark, sf_dir):
    return rounded(robust.intrinsics(_axes(spark, sf_dir), ["x", "y"]), 4)


@query(f"WITH {TRACKS_SQL} SELECT event_id, (1 - 1 / (1 + exp(-((event_id % 9) - 4.0)))) * (1 - 1 / (1 + exp(-((event_id % 7) - 3.0)))) > 0.5 AS visible FROM tracks")
def occlusion_decode(spark, sf_dir):
    """The earlier rule of visibility."""
    t = track_table(spark, sf_dir)
    return tracks.decode_occlusion(t, F.col("event_id") % 9 - 4.0, F.col("event_id") % 7 - 3.0).select("event_id", "visible")


@query(f"WITH {TRACKS_SQL}, q AS (SELECT track_id, x AS qx, y AS qy FROM tracks WHERE t = 3) SELECT track_id, round(max(sqrt((x - qx)^2 + (y - qy)^2)), 5) AS score FROM tracks JOIN q USING (track_id) GROUP BY track_id ORDER BY max(sqrt((x - qx)^2 + (y - qy)^2)) DESC, track_id LIMIT 20")
def top_motion(spark, sf_dir):
    """The tracks that go farthest from where they are in a query frame."""
    from ..operators.sampling import top_k

    return rounded(top_k(tracks.motion_scores(track_table(spark, sf_dir), 3, ["x", "y"]), "score", "track_id", 20))


@query(f"WITH {TRACKS_SQL} SELECT track_id, t, round(CASE WHEN t = track_id % 4 THEN 7.0 ELSE x END, 5) AS x, round(y, 5) AS y FROM tracks")
def pinned_query_points(spark, sf_dir):
    t = track_table(spark, sf_dir)
    q = t.where("t = track_id % 4").select("track_id", "t", F.lit(7.0).alias("x"), "y")
    return rounded(tracks.pin_query_points(t, q, ["x", "y"]).select("track_id", "t", "x", "y"))


@query("SELECT event_id, CASE WHEN p > 0 AND p < 1 THEN round(ln(p / (1 - p)), 5) END AS logit FROM (SELECT event_id, value / 100 AS p FROM events)")
def logit_values(spark, sf_dir):
    from ..functions.stats import logit

    return rounded(table(spark, sf_dir, "events").select("event_id", logit(F.col("value") / 100).alias("logit")))


@query("SELECT p_partkey, round(p_size / 255.0 * 2 - 1, 6) AS signed, round((p_size / 50.0 * 2 - 1) * p_retailprice, 4) AS clip_x, round((1 - p_size / 25.0 * 2) * p_retailprice, 4) AS clip_y FROM part")
def range_transforms(spark, sf_dir):
    from ..functions.raster import byte_to_signed, pixel_to_clip

    p = table(spark, sf_dir, "part")
    clip = pixel_to_clip(F.col("p_size"), F.col("p_size"), F.col("p_retailprice"), F.lit(50), F.lit(25))
    return p.select("p_partkey", F.round(byte_to_signed(F.col("p_size")), 6).alias("signed"), F.round(clip[0], 4).alias("clip_x"), F.round(clip[1], 4).alias("clip_y"))
