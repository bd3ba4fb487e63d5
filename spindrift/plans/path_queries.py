"""Path, schedule and report queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paths, scene
from .bind import TRACKS_SQL, query, rounded, table, track_table


@query("SELECT event_id, round(exp(least(event_id, 5000) / 5000.0 * ln(0.00016 / 0.01)) * 0.01, 8) AS rate FROM events")
def exponential_schedule(spark, sf_dir):
    return rounded(paths.exponential_schedule(table(spark, sf_dir, "events").select("event_id"), "event_id", 0.01, 0.00016, 5000), 8)


@query(f"WITH {TRACKS_SQL} SELECT track_id, t, 1 AS direction, t - 7 AS ord FROM tracks WHERE t >= 7 UNION ALL SELECT track_id, t, -1, 7 - t FROM tracks WHERE t <= 7")
def bidirectional_order(spark, sf_dir):
    return paths.both_ways(track_table(spark, sf_dir).select("track_id", "t"), "t", 7).withColumnRenamed("order", "ord")


@query("SELECT event_id, user_id, ntile FROM (SELECT event_id, user_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) e, LATERAL (SELECT ceil(n / 16)::BIGINT AS k) a, LATERAL (SELECT CASE WHEN i < n % k * (n // k + 1) THEN i // (n // k + 1) ELSE n % k + (i - n % k * (n // k + 1)) // (n // k) END AS ntile) b")
def point_chunks(spark, sf_dir):
    return paths.chunks(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 16).withColumnRenamed("chunk", "ntile")


@query("""WITH s AS (SELECT l_returnflag AS seq, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1)
SELECT seq, round(q, 5) AS q, round(d, 5) AS d FROM s UNION ALL SELECT '(all)', round(avg(q), 5), round(avg(d), 5) FROM s""")
def sequence_report(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("seq"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))  # noqa: E741
    return rounded(paths.sequence_report(l, "seq", ["q", "d"]))


@query("""SELECT event_id, CASE least(greatest(floor(least(greatest(value / 100, 0), 1) * 2 + 0.5), 0), 2) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS red FROM events""")
def colour_lookup(spark, sf_dir):
    out = paths.colour_lookup(table(spark, sf_dir, "events"), F.col("value") / 100, [(0.0, 0.0, 1.0), (0.5, 1.0, 0.5), (1.0, 0.0, 0.0)])
    return out.select("event_id", F.get("colour", F.lit(0)).alias("red"))


@query(f"WITH {TRACKS_SQL} SELECT track_id, t, 9::BIGINT AS time FROM tracks")
def fixed_times(spark, sf_dir):
    return scene.fixed_time(track_table(spark, sf_dir), 11, 10).select("track_id", "t", F.col("time").cast("long").alias("time"))


@query()
def camera_path_frames(spark, sf_dir):
    t = track_table(spark, sf_dir)
    k = t.select(F.col("track_id").alias("path"), F.col("t").alias("idx"), (F.col("x") / 100 + 0.1).alias("seconds"), F.array("x", "y", "z").alias("position"), F.array(F.lit(1.0), F.col("x") / 500, F.lit(0.1), F.col("t") * 0.1).alias("wxyz"), (0.5 + F.col("t") * 0.05).alias("fov"))
    out = paths.interpolate_path(k, 10.0)
    return rounded(out.select("path", "frame", F.get("position", F.lit(0)).alias("x"), F.get("wxyz", F.lit(0)).alias("w"), "fov"), 4)


@query(f"""WITH u AS (SELECT p_partkey, {', '.join(f'(p_partkey % 2147483647 * {m} + 7) % 2147483647 / 2147483647.0::DOUBLE AS u{i}' for i, m in enumerate(paths.SCATTER))} FROM part)
SELECT p_partkey, round(sqrt(1 - u0) * sin(2 * pi() * u1), 5) AS w, round(sqrt(1 - u0) * cos(2 * pi() * u1), 5) AS x, round(sqrt(u0) * sin(2 * pi() * u2), 5) AS y, round(sqrt(u0) * cos(2 * pi() * u2), 5) AS z FROM u""")
def random_quaternions(spark, sf_dir):
    q = paths.random_unit_quaternions(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7)
    return rounded(q.select("p_partkey", *(F.get("wxyz", F.lit(i)).alias(n) for i, n in enumerate("wxyz"))))


@query()
def camera_axes(spark, sf_dir):
    out = paths.camera_axes(track_table(spark, sf_dir), ["x", "y", "z"])
    return rounded(out.select(*(F.get("mean", F.lit(i)).alias(f"m{i}") for i in range(3)), *(F.get("axes", F.lit(i)).alias(f"a{i}") for i in range(9))), 4)
